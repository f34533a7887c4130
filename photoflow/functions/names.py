"""Photo file names: timestamps, stems, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def _at(date: Column, time: Column, fraction: Column | None = None) -> Column:
    text = F.concat(date, time, *([F.lit("."), F.rpad(fraction, 6, "0")] if fraction is not None else []))
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss" + (".SSSSSS" if fraction is not None else "")))


def photo_ts(filename: Column) -> Column:
    """Timestamp in a photo's name, else null.

    Forms: date_time, date_time_fraction (right-padded to microseconds), IMG_date_time, and any name whose
    first part has 8 characters and whose second begins with 6 that make a time.
    """
    s = stem(filename)
    part = lambda rx, n: F.regexp_extract(s, rx, n)
    whole, fine, img = r"^(\d{8})_(\d{6})$", r"^(\d{8})_(\d{6})_(\d{1,6})$", r"^IMG_(\d{8})_(\d{6})$"
    loose = r"^(\d{8})_(\d{6})"
    return F.coalesce(
        F.when(s.rlike(whole), _at(part(whole, 1), part(whole, 2))),
        F.when(s.rlike(fine), _at(part(fine, 1), part(fine, 2), part(fine, 3))),
        F.when(s.rlike(img), _at(part(img, 1), part(img, 2))),
        F.when(s.rlike(loose), _at(part(loose, 1), part(loose, 2))),
    )


def photo_ts_v1(filename: Column) -> Column:
    """The older form only: date_time.milliseconds, which are dropped."""
    rx = r"^(\d{8})_(\d{6})\.(\d{3})"
    return F.when(filename.rlike(rx), _at(F.regexp_extract(filename, rx, 1), F.regexp_extract(filename, rx, 2)))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in pattern)
    return f"^{out}$"


def split_time(line: Column, day: Column) -> Column:
    """A manual split time: `date time`, `HH:MM:SS` or `HHMMSS` on the given day; comments and other lines are null."""
    t = F.trim(line)
    on = lambda x: F.try_to_timestamp(F.concat(F.date_format(day, "yyyyMMdd"), F.regexp_replace(x, ":", "")), F.lit("yyyyMMddHHmmss"))
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(~t.startswith("#"), F.coalesce(full, F.when(t.rlike(r"^\d{2}:\d{2}:\d{2}$|^\d{6}$"), on(t))))


def duration_fmt(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h = F.floor(s / 3600)
    return F.concat_ws(":", F.when(h > 99, h.cast("string")).otherwise(two(h)), two(F.floor(s % 3600 / 60)), two(s % 60))


def throughput(n: Column, seconds: Column) -> Column:
    """Items per second, 0 where no time passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))
