"""Photo-event analytics as plain PySpark DataFrame functions."""
