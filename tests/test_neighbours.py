"""Near vectors by pivots, and the clusterings on them, against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.operators import cluster, neighbours


def frame(spark, x, f=None):
    return spark.createDataFrame([(i, [float(c) for c in v], int(f[i]) if f is not None else 1) for i, v in enumerate(x)], "id long, v array<double>, f long")


def labels(near: np.ndarray, least: int) -> dict[int, int]:
    core, label, no = near.sum(1) >= least, {}, 0
    for i in np.flatnonzero(core):
        if i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in label:
                    label[j] = no
                    stack += np.flatnonzero(near[j] & core).tolist()
            no += 1
    out = dict(label)
    for i in np.flatnonzero(~core):
        mine = [label[j] for j in np.flatnonzero(near[i] & core)]
        out[i] = min(mine, default=-1)
    return out


def blobs(rng, groups: int, each: int, size: int, spread: float) -> np.ndarray:
    return np.concatenate([rng.normal(0, 1, size) * 3 + rng.normal(0, spread, (each, size)) for _ in range(groups)])


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_density_clusters_over_many_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    rng = np.random.default_rng(7)
    x = np.concatenate([blobs(rng, 6, 40, 5, 0.15), rng.normal(0, 2, (150, 5)), np.zeros((2, 5))])
    x = np.concatenate([x, x[:30]])  # equal vectors
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = 1 - unit @ unit.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    eps = 0.02 if metric == "cosine" else 0.5
    near = d <= eps
    same = (x[:, None] == x[None]).all(2)
    want = labels(near | same, 6)
    got = {r.id: r.label for r in cluster.dbscan(frame(spark, x).drop("f"), eps, 6, metric).collect()}
    assert got == want and len(set(want.values())) > 4


def test_one_dense_cell_writes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    x = np.random.default_rng(1).normal(0, 1e-3, (700, 4)) + 1
    c = neighbours.cells(frame(spark, x), "cosine")
    placed = neighbours.guests(c, c.reach(0.1))
    core = spark.range(700)
    homes = neighbours.links(c, placed, core, 0.1).count()
    assert homes < 700 * 700 / 20
    assert {r.label for r in cluster.dbscan(frame(spark, x).drop("f"), 0.1, 5).collect()} == {0}


def test_pivots_leave_out_most_pairs(spark):
    x = blobs(np.random.default_rng(3), 30, 200, 16, 0.05)
    met, every = neighbours.compared(neighbours.cells(frame(spark, x), "cosine"), 0.01)
    assert met < every / 10


def test_vectors_that_cannot_be_compared_are_noise(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(5)] + [(10, None), (11, [math.nan, 1.0]), (12, [math.inf, 1.0]), (13, [None, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    assert {r.id: r.label for r in cluster.dbscan(v, 0.1, 3).collect()} == {i: 0 if i < 5 else -1 for i, _ in rows}
    assert {r.label for r in cluster.dbscan(v.where("id > 9"), 0.1, 3).collect()} == {-1}
    assert cluster.dbscan(v.limit(0), 0.1, 3).count() == 0
    assert cluster.hierarchical_faces(v, 2).count() == cluster.kmeans_faces(v, 2).count() == 5


def test_kth_distance(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(9)
    x = np.concatenate([blobs(rng, 5, 30, 3, 0.2), rng.normal(0, 4, (40, 3))])
    f = rng.integers(1, 4, len(x))
    whole = np.repeat(x, f, axis=0)
    d = np.sort(np.sqrt(((x[:, None] - whole[None]) ** 2).sum(2)), axis=1)
    for k in (1, 4, 9):
        got = {r.id: r.d for r in neighbours.kth_distance(frame(spark, x, f), k).collect()}
        assert len(got) == len(x) and max(abs(got[i] - d[i, k - 1]) for i in got) < 1e-6
    few = neighbours.kth_distance(frame(spark, x[:2]), 4).collect()
    assert all(abs(r.d - np.linalg.norm(x[0] - x[1])) < 1e-6 for r in few) and len(few) == 2


def groups(rows) -> list[set[int]]:
    out = {}
    for r in rows:
        out.setdefault(r.label, set()).add(r.id)
    return list(out.values())


def test_agglomeration_of_equal_vectors_and_of_a_grid(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 40)
    log = []
    v = spark.range(5000).select("id", F.array(F.lit(0.6), F.lit(0.8)).alias("v"))
    got = groups(cluster.hierarchical_faces(v, 1000, log=log).collect())
    assert log == [] and len(got) == 5 and sum(map(len, got)) == 5000
    side = 18
    grid = spark.createDataFrame([(i, [float(i % side), float(i // side)]) for i in range(side * side)], "id long, v array<double>")
    assert len(groups(cluster.hierarchical_faces(grid, 60, "ward", log=log).collect())) == side * side // 60
    # a constant share merges in each round
    assert log[0] == side * side and len(log) <= 12 and all(b <= 0.9 * a for a, b in zip(log, log[1:], strict=False))


def test_means_level_by_level(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(cluster, "BRANCHES", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    x = np.concatenate([blobs(np.random.default_rng(4), 24, 30, 6, 0.5), np.ones((200, 6))])
    v = frame(spark, x).drop("f")

    def inertia(rows) -> float:
        own = [np.array(sorted(g)) for g in groups(rows)]
        return sum(((x[g] - x[g].mean(0)) ** 2).sum() for g in own)

    rows = cluster.kmeans_faces(v, 23).collect()
    k = len(groups(rows))
    assert len(rows) == len(x) and 36 <= k <= 40 and {r.label for r in rows} == set(range(k))
    data = v.select("id", array_to_vector("v").alias("features"))
    plain = KMeans(k=k, seed=1, maxIter=20).fit(data).transform(data).select("id", F.col("prediction").alias("label")).collect()
    assert inertia(rows) < 1.05 * inertia(plain)
    assert len({r.label for r in rows if r.id >= 720}) == 1  # equal vectors stay together


def test_small_cells_settle_in_one_pass(spark, monkeypatch):
    """The rounds of small cells write no centres, and give the clusters of rounds over blocks."""
    written = []
    monkeypatch.setattr(cluster, "materialize", lambda t, name, keep=cluster.materialize: written.append(name) or keep(t, name))
    monkeypatch.setattr(cluster, "BRANCHES", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    x = np.concatenate([blobs(np.random.default_rng(7), 20, 25, 5, 0.5), np.ones((30, 5))])
    v = frame(spark, x).drop("f")
    whole = groups(cluster.kmeans_faces(v, 25).collect())
    assert written.count("centres") <= 3 and "level-blocks" not in written
    for most in (0, 600):  # all cells by blocks; the first level by blocks
        monkeypatch.setattr(cluster, "WHOLE", most)
        assert sorted(map(sorted, groups(cluster.kmeans_faces(v, 25).collect()))) == sorted(map(sorted, whole))
    assert "level-blocks" in written


def test_a_vector_goes_once_to_a_part_where_pivots_save_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    monkeypatch.setattr(neighbours, "PER_CELL", 5)
    x = np.random.default_rng(5).normal(0, 1, (800, 24))  # no groups: every vector can reach every cell
    c = neighbours.cells(frame(spark, x), "cosine")
    placed = neighbours.guests(c, c.reach(0.68))
    assert len(c.pivots) == 160 and placed.agg(F.sum(F.size("parts"))).first()[0] <= 8 * len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for eps in (0.5, 0.68):
        got = {r.id: r.label for r in cluster.dbscan(frame(spark, x).drop("f"), eps, 4).collect()}
        assert got == labels(1 - unit @ unit.T <= eps, 4)


def test_kth_distance_over_the_cells_of_one_part(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_CELL", 10)
    x = np.random.default_rng(6).normal(0, 1, (300, 8))
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 3]
    got = {r.id: r.d for r in neighbours.kth_distance(frame(spark, x), 4).collect()}
    assert max(abs(got[i] - d[i]) for i in range(300)) < 1e-6


def test_a_cluster_is_sent_once_to_each_pair_of_parts(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 5)
    rng = np.random.default_rng(6)
    x, w = rng.integers(0, 6, (300, 3)).astype(float), rng.integers(1, 4, 300)
    v = spark.createDataFrame([(i, int(w[i]), r.tolist()) for i, r in enumerate(x)], "id long, w long, v array<double>")
    sent = cluster._block_pairs(v.select("id", "v"), 300).select("pair", F.explode("m.id").alias("id"))
    assert sent.count() == sent.distinct().count() == 300 * cluster.PARTS
    d = np.round(np.sqrt(cluster._linkage(x, w.astype(float), x, w.astype(float), "ward")), 12)
    np.fill_diagonal(d, np.inf)
    ids = np.arange(300)
    tie = cluster._pair_hash(ids[:, None], ids[None])
    want = {int(i): int(min(np.flatnonzero(d[i] == d[i].min()), key=lambda j: tie[i, j])) for i in ids}
    assert {r.id: r.other for r in cluster._nearest(v, "ward", 300).collect()} == want
