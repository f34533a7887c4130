import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.llm import topk


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q, x in {i: v for i, v in ok if i % every == 0}.items():
        s = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(y) == len(x)))[:k]
        out |= {(q, n + 1, i, -v) for n, (v, i) in enumerate(s)}
    return out


def test_table_against_brute_force(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = topk.search(t, F.col("vec_id") % 100 == 0)
    assert set(map(tuple, got.collect())) == brute([(r.vec_id, r.embedding) for r in t.collect()])


def test_blocks_lengths_and_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(8) * rng.choice([0.01, 1, 30])]) for i in range(600)]
    rows += [(700, None), (800, [1.0] * 7 + [None]), (900, [1.0] * 7 + [float("nan")]), (1000, [0.0] * 8), (1001, [1.0, 2.0]), (1100, [3.0, 4.0]), (None, [1.0] * 8), (1200, []), (1300, [])]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank", "3 as id")
    got = topk.search(t, F.col("vec_id") % 100 == 0)
    assert set(map(tuple, got.collect())) == brute(rows)
    assert topk.search(t.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_long_vectors_and_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(5_000) * 900).tolist()) for i in range(0, 220, 20)]
    rows += [(1, [2_000_000.0, 1.0]), (100, [-1_999_999.0, 2.0]), (200, [2.0, 2_000_000.0])]
    rows = [(i if len(v) > 2 else i + 1000, v) for i, v in rows]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(map(tuple, topk.search(t, F.col("vec_id") % 100 == 0).collect())) == brute(rows)
    far = spark.createDataFrame([(0, [1.0, 1e7]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        topk.search(far, F.col("vec_id") % 100 == 0).collect()
