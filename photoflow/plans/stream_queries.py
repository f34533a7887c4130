"""Documents, games and tracks on streams of the given tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.plans import fixtures as X
from photoflow.plans.registry import query
from photoflow.plans.session_queries import _games_sql
from photoflow.plans.table_queries import TRACK_SQL, TYPES_SQL, balls, customer_documents
from photoflow.scratch import new_path
from photoflow.sources.sidecars import spread, write_files
from photoflow.streaming import streams


@query("k2_sessionize_stream", f"WITH {_games_sql(30, 30)} SELECT source, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time, photo_count FROM games")
def k2(spark, sf_dir) -> DataFrame:
    schema = X.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    photos = events.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    out = new_path(spark, "games")
    games = streams.sessionize_stream(photos, ["source"], 30, 30)
    streams.run_available(games, f"{out}-checkpoint", lambda b, _: b.write.mode("overwrite").parquet(out), mode="complete")
    return spark.read.parquet(out).select("source", F.unix_micros("start_time").alias("start_time"), F.unix_micros("end_time").alias("end_time"), "photo_count")


@query("k1_ingest_sidecars", "SELECT c_custkey AS image, 'face_detection' AS op, true AS success FROM customer WHERE c_custkey % 7 <> 0")
def k1(spark, sf_dir) -> DataFrame:
    """A document per customer as a file; two runs take all of them once, broken ones give no row."""
    out = new_path(spark, "ingest")
    write_files(customer_documents(spark, sf_dir).withColumn("name", spread(F.col("name"))), f"{out}/in", "name", F.col("doc"))
    for _ in range(2):
        streams.ingest_sidecars(spark, f"{out}/in", f"{out}/operations", f"{out}/checkpoint")
    return streams.ingested(spark, f"{out}/operations").select(F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("long").alias("image"), "op", "success")


_LATE = "event_id % 50 = 3 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query("k2_sessionize_late", f"WITH {_games_sql(30, 30).replace('FROM events', f'FROM (SELECT * FROM events WHERE NOT ({_LATE}))')} SELECT source, epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time, photo_count FROM games")
def k2_late(spark, sf_dir) -> DataFrame:
    """Games in append mode from files out of order: photos that come after the watermark has closed their time are dropped."""
    photos = X.photos(spark, sf_dir).select("photo_id", "source", "ts")
    middle = photos.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).first()[0]
    late = (F.col("photo_id") % 50 == 3) & (F.col("ts") < middle)
    out = new_path(spark, "late")
    # a file for each batch: photos in time in two parts that interleave, late ones, and one that closes all games;
    # a batch drops what the watermark of the batch before it has passed
    last = photos.agg(F.max("ts")).first()[0]
    end = spark.sql("select -1L as photo_id, 'end' as source").select("*", F.lit(last + timedelta(days=400)).alias("ts"))
    first = F.col("photo_id") % 2 == 0
    for part in (photos.where(~late & first), photos.where(~late & ~first), photos.where(late), end):
        part.select("source", "ts").coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema("source string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    games = streams.sessionize_stream(stream, ["source"], 30, 30, watermark="1 hour")
    streams.run_available(games, f"{out}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/games/batch={n}"))
    return spark.read.parquet(f"{out}/games").select("source", F.unix_micros("start_time").alias("start_time"), F.unix_micros("end_time").alias("end_time"), "photo_count")


@query("k3_track_stream", f"""{TRACK_SQL}, {TYPES_SQL} SELECT ball_id, coalesce(prev_id, -1) AS prev_id, round(coalesce(dx, 0), 6) AS dx, round(coalesce(dy, 0), 6) AS dy, t AS tracked_type
FROM f LEFT JOIN m USING (ball_id) JOIN r USING (ball_id)""")
def k3(spark, sf_dir) -> DataFrame:
    """The given events as balls on a stream, in three batches that all frames span."""
    out = new_path(spark, "tracks")
    b = balls(spark, sf_dir)
    columns = ["source", "ts", "ball_id", "cx", "cy", "ball_type"]
    span = b.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    for k in range(3):
        b.where(F.col("ball_id") % 3 == k).select(*columns).write.mode("append").parquet(f"{out}/balls")
    b.limit(1).select(F.lit("end").alias("source"), F.lit(span.last + timedelta(days=2) + 2 * (span.last - span.first)).alias("ts"), *[F.lit(None).cast(t).alias(c) for c, t in b.select(*columns[2:]).dtypes]).write.mode("append").parquet(f"{out}/balls")
    stream = spark.readStream.schema(b.select(*columns).schema).option("maxFilesPerTrigger", b.rdd.getNumPartitions()).parquet(f"{out}/balls")
    tracks = streams.track_stream(stream, watermark=f"{int((span.last - span.first).total_seconds()) + 1} seconds")
    with streams.rocksdb_state(spark):
        streams.run_available(tracks, f"{out}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/found/batch={n}"))
    t = spark.read.schema(streams.TRACKED).parquet(f"{out}/found")
    return t.select("ball_id", F.coalesce("prev_id", F.lit(-1)).alias("prev_id"), F.round(F.coalesce("dx", F.lit(0.0)), 6).alias("dx"), F.round(F.coalesce("dy", F.lit(0.0)), 6).alias("dy"), "tracked_type")
