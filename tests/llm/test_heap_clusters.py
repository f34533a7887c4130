"""Clusters by heaps of bounds against plain rounds of assignment and floor means."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from photoflow.llm import heap_clusters, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(x: np.ndarray, start: list[list[int]], rounds: int) -> tuple[list[int], list[int], list[list[int]]]:
    centers = [list(c) for c in start]
    x = x.astype(object)
    for done in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers] for v in x]
        own = [min(range(len(centers)), key=lambda k: (row[k], k)) for row in d]
        if done < rounds:
            for k in range(len(centers)):
                mine = [v for v, o in zip(x, own, strict=True) if o == k]
                if mine:
                    centers[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return own, [row[o] for row, o in zip(d, own, strict=True)], centers


def table(spark, x: np.ndarray):
    return spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, x array<long>")


def check(spark, x, start, rounds, block, log=None):
    out, centers = heap_clusters.cluster(table(spark, x), start, rounds, x.shape[1], block, log)
    own, distance, want = plain(x, start, rounds)
    got = {r.vec_id: (r.cluster, r.distance) for r in out.collect()}
    assert got == {i: (o, d) for i, (o, d) in enumerate(zip(own, distance, strict=True))}
    assert centers == want


def test_rounds(spark):
    rng = np.random.default_rng(3)
    middles = rng.integers(-300, 300, (8, 6))
    x = middles[rng.integers(0, 8, 900)] + rng.integers(-40, 40, (900, 6))
    log = []
    check(spark, x, x[:12].tolist(), 5, 64, log)
    assert log[0] == 900 and len(log) == 6
    assert sum(log[1:]) < 0.5 * 900 * 5  # most bounds hold


def test_ties_and_equal_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (400, 3))  # a handful of different vectors
    check(spark, x, x[:9].tolist(), 5, 50)
    check(spark, np.ones((30, 3), int), [[1, 1, 1], [1, 1, 1], [5, 5, 5]], 3, 7)  # two centroids in one place, one that stays empty


def test_large_components(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-heap_clusters.LARGEST, heap_clusters.LARGEST + 1, (60, 64))
    check(spark, x, x[:5].tolist(), 3, 16)
    x[7, 3] = heap_clusters.LARGEST + 1
    with pytest.raises(Exception, match="beyond"):
        heap_clusters.cluster(table(spark, x), x[:5].tolist(), 1, 64)


def test_a_round_joins_its_buckets_without_a_shuffle(spark, monkeypatch):
    plans = []
    kept = heap_clusters._bucketed
    monkeypatch.setattr(heap_clusters, "_bucketed", lambda df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, n))
    x = np.arange(300).reshape(100, 3)
    check(spark, x, x[:4].tolist(), 2, 8)
    rounds = [p for p in plans if "Join" in p]
    assert len(rounds) == 2 and not any("Exchange" in p for p in rounds)


def test_heaps_keep_their_order():
    rng = np.random.default_rng(6)
    heaps = heap_clusters.Heaps(3)
    gaps = rng.random(200)
    heaps.push(np.arange(200), rng.integers(0, 2, 200), gaps)
    for until in (0.1, 0.3, 0.31, 0.9, 2.0):
        offsets, places, kept = heaps.stored()
        heaps = heap_clusters.Heaps(3, np.frombuffer(offsets, np.int32), np.frombuffer(places, np.int32), np.frombuffer(kept))
        left = set(np.frombuffer(places, np.int32).tolist())
        assert {p for p, _ in heaps.expired(np.full(3, until))} == {p for p in left if gaps[p] <= until}


def test_odd_rows(spark):
    one = [float(i) for i in range(64)]
    rows = [(1, one, 0, "x"), (1, one, 0, "x"), (2, None, None, None), (3, [], 1, "x"), (4, one[:-1], 1, "x"), (5, [*one[:-1], None], 1, "x"), (6, [*one[:-1], math.nan], 1, "x")]
    rows += [(7, [*one[:-1], math.inf], 1, "x"), (None, [-c for c in one], 1, "x"), (8, [0.0009, *one[1:]], 1, "x"), (8, [-0.0009, *one[1:]], 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = heap_clusters.digest(docs).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 1, 8, 8]
    assert {r.distance for r in got} == {0} and {r.inertia for r in got} == {0}
    first = [-1, *(256 * i for i in range(1, 64))]
    assert hashlib.sha256(",".join(map(str, first)).encode()).hexdigest() in {r.centroid_sha256 for r in got if r.vec_id == 8}
    assert heap_clusters.digest(docs.where("vec_id = 2")).count() == 0
    assert heap_clusters.digest(docs.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_query_and_sql(spark):
    got = sorted(tuple(r) for r in queries.queries()["op11_heap_clusters"](spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    assert got == sorted(con.sql(queries.oracle_sql()["op11_heap_clusters"]).fetchall())
