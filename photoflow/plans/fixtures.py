"""Photo tables derived from the given ones: each as a DataFrame and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    name = F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(".jpg"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("photo_id"), F.col("event_type").alias("source"), ts.alias("ts"), name.alias("filename"), "user_id")


PHOTOS = """photos AS (SELECT event_id AS photo_id, event_type AS source, ts, user_id,
  strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '.jpg' AS filename FROM events)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as image",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) as bigint) as ord",
        "cast(l_partkey % 50 as double) as x", "cast(l_suppkey % 50 as double) as y", "20 + l_quantity as w", "20 + l_quantity as h",
        "0.2 + 8 * l_discount as confidence", "l_returnflag as method", "l_linestatus as resolution", "concat(l_returnflag, l_linestatus) as class",
    )


DETECTIONS = """detections AS (SELECT l_orderkey AS image,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS ord,
  CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y, 20 + l_quantity AS w, 20 + l_quantity AS h,
  0.2 + 8 * l_discount AS confidence, l_returnflag AS method, l_linestatus AS resolution, l_returnflag || l_linestatus AS class FROM lineitem)"""


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as photo",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) as bigint) as ord",
        "cast(l_partkey % 256 as int) as r", "cast(l_suppkey * 7 % 256 as int) as g", "cast(l_linenumber * 40 % 256 as int) as b", "l_discount * 10 as percentage",
    )
    return d


COLORS = """colors AS (SELECT l_orderkey AS photo,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS ord,
  CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey * 7 % 256 AS INTEGER) AS g, CAST(l_linenumber * 40 % 256 AS INTEGER) AS b, l_discount * 10 AS percentage FROM lineitem)"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id as image", "event_type as op", "value < 100 as success", "value / 100 as processing_time", "props as payload", "ts", "user_id", "value")


OPERATIONS = "operations AS (SELECT event_id AS image, event_type AS op, value < 100 AS success, value / 100 AS processing_time, props AS payload, ts, user_id, value FROM events)"


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per image; every 97th is cut off."""
    doc = F.format_string(
        '{"sidecar_info":{"operation_type":"%s","created_at":"c%d"},"%s":{"success":%s,"count":%d,"metadata":{"processing_time":%d}}}',
        F.when(F.col("event_id") % 5 == 0, "bogus").otherwise(F.col("event_type")), "event_id", "event_type", F.when(F.col("value") < 100, "true").otherwise("false"), F.col("event_id") % 6, F.floor("value"),
    )
    cut = F.when(F.col("event_id") % 97 == 0, F.substring(doc, 1, 25)).otherwise(doc)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("image"), F.concat(F.lit("shoot/IMG_"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), cut.alias("doc"))


SIDECARS = """full_docs AS (SELECT event_id AS image, 'shoot/IMG_' || event_id || '.json' AS path,
  printf('{"sidecar_info":{"operation_type":"%s","created_at":"c%d"},"%s":{"success":%s,"count":%d,"metadata":{"processing_time":%d}}}',
    CASE WHEN event_id % 5 = 0 THEN 'bogus' ELSE event_type END, event_id, event_type, CASE WHEN value < 100 THEN 'true' ELSE 'false' END, event_id % 6, CAST(floor(value) AS BIGINT)) AS doc FROM events),
sidecars AS (SELECT image, path, CASE WHEN image % 97 = 0 THEN substr(doc, 1, 25) ELSE doc END AS doc FROM full_docs)"""
