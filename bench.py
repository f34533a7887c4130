"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from photoflow.operators import sessions
from photoflow.plans import fixtures, registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["b1_photo_ts", "b20_overall_score", "b24_upper_body_box", "d7_overlap_pairs", "d12_merge_sidecars", "f3_sidecar_stats", "f9_benchmark_accuracy", "g9_greedy_leaders", "g10_reconcile_faces", "g2_dbscan_cosine", "a4_explode_operations"]


def e1(spark, sf_dir):
    photos = fixtures.photos(spark, sf_dir).withColumn("source", (F.col("user_id") % 50).cast("string"))
    return sessions.sessionize(photos, ["source"], 30, 30)


def e2(spark, sf_dir):
    photos = fixtures.photos(spark, sf_dir).withColumn("source", (F.col("user_id") % 50).cast("string"))
    return sessions.sessionize_adaptive(photos, ["source"], 60, 30, 50)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.codegen.hugeMethodLimit", "8000").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = {"e1_sessions_50_sources": e1, "e2_adaptive_50_sources": e2} | {n: registry.queries()[n] for n in NAMES}
    e1(spark, SF_DIR).write.format("noop").mode("overwrite").save()  # start the workers
    took = {}
    for name, fn in run.items():
        began = time.time()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
