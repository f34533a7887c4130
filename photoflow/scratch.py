"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a table and reading it again, so that a lost executor
costs a re-read and not a recomputation. The folder is the one named in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    Where ``spark.checkpoint.dir`` is unset, a temporary folder is taken on one machine (tests); a cluster
    raises, as its executors would not see each other's files.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="photoflow-")
        base = f"file://{_LOCAL[app]}"
    return f"{base.rstrip('/')}/photoflow-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the cut in the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it once results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
