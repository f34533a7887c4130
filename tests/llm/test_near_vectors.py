import numpy as np

from photoflow.llm import near_vectors, queries


def brute(rows, limit=0.93):
    ok = [i for i, (d, v, lab) in enumerate(rows) if d is not None and lab is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[x][1], float) / np.abs(rows[x][1]).max() for x in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= limit:
                    n[i] += 1
                    n[j] += 1
                    parent[root(i)] = root(j)
    low = {}
    for i in range(len(rows)):
        low.setdefault(root(i), []).append(rows[i][0])
    return [(rows[i][0], n[i], min((x for x in low[root(i)] if x is not None), default=None)) for i in range(len(rows))]


def sample(seed, n=300, d=16):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(d).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, (np.array(rows[i % 40][1]) + rng.standard_normal(d) * 0.15).tolist(), rows[i % 40][2]) for i in range(200)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(25)]
    rows += [(2000, None, 1), (2001, [0.0] * d, 1), (2002, [float("nan")] * d, 1), (2003, rows[0][1], None), (2004, [None] * d, 1), (None, rows[0][1], 0), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1), (2008, [1e-200] * d, 2), (2009, [1e200] * d, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as key", "2 as n_links").repartition(3)


def test_one_cluster_is_exact(spark):
    rows = sample(1)
    got = near_vectors.components(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)
    assert near_vectors.components(frame(spark, rows).limit(0)).count() == 0


def test_overlapping_clusters_recall(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CLUSTER", 60)
    monkeypatch.setattr(near_vectors, "BLOCK", 50)
    rows = sample(2)
    got = {r.vec_id: r for r in near_vectors.components(frame(spark, rows)).collect()}
    want = brute(rows)
    assert sum(got[d].n_links for d, *_ in want) >= 0.9 * sum(n for _, n, _ in want)
    assert all(got[d].n_links <= n for d, n, _ in want if d is not None)


def test_the_search_leaves_its_cluster(spark, monkeypatch):
    """Chains of near vectors through many small clusters: most links cross, and are found over the united graph."""
    monkeypatch.setattr(near_vectors, "CLUSTER", 40)
    monkeypatch.setattr(near_vectors, "BLOCK", 30)
    monkeypatch.setattr(near_vectors, "OVERLAP", 2)
    monkeypatch.setattr(near_vectors, "DEGREE", 8)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(3):
        at = rng.standard_normal(8)
        for i in range(60):
            at = at / np.linalg.norm(at) + rng.standard_normal(8) * 0.07
            rows.append((k * 60 + i, at.tolist(), 1))
    reached = []
    beyond = near_vectors._beyond

    def watched(asked, *rest):
        out = beyond(asked, *rest)
        reached.append(out.count())
        return out

    monkeypatch.setattr(near_vectors, "_beyond", watched)
    got = {r.vec_id: r for r in near_vectors.components(frame(spark, rows)).collect()}
    want = brute(rows)
    links, true = sum(got[d].n_links for d, *_ in want), sum(n for _, n, _ in want)
    print("links", true, "found", links, "beyond", reached)
    assert all(got[d].n_links <= n for d, n, _ in want)
    assert links >= 0.95 * true and reached[0] > 0.02 * true


def test_long_vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((12, 5_000))
    rows = [(i, (x[i % 6] + (0.05 * x[i] if i >= 6 else 0)).tolist(), 1) for i in range(12)]
    got = near_vectors.components(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))


def test_table_and_audit(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = near_vectors.components(t)
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == sorted(brute(rows))
    a = near_vectors.audit(t, got).first()
    assert a.found == a.true
    q = queries.near_vectors_audit(spark, "/root/testdata/sf0.01").first()
    assert (q.found, q.true) == (a.found, a.true)


def test_a_tight_group_is_compared_whole(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    x = np.concatenate([base / np.linalg.norm(base) + rng.standard_normal((4000, 64)) * 0.03, rng.standard_normal((300, 64))])
    x[4100:4110] = x[5]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    t = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in near_vectors.components(t).collect()}
    assert len(got) == len(x) and want.sum() > 1_000_000
    assert all(got[i].n_links <= n for i, n in enumerate(want))
    recall = sum(r.n_links for r in got.values()) / want.sum()
    print(f"links {want.sum()}, recall {recall:.4f}")
    assert recall == 1
    assert {got[i].component_id for i in range(4000) if want[i]} == {min(i for i in range(4000) if want[i])}


def test_links_at_the_rim_of_whole_clusters(spark, monkeypatch):
    """A tight group larger than a cluster among others, and two such groups side by side: links across the rim count for both."""
    monkeypatch.setattr(near_vectors, "CLUSTER", 300)
    monkeypatch.setattr(near_vectors, "BLOCK", 100)
    rng = np.random.default_rng(21)
    one, two = np.array([1.0, 0, 0, 0, 0]), np.array([np.cos(0.45), np.sin(0.45), 0, 0, 0])
    x = np.concatenate([one + rng.standard_normal((500, 5)) * 0.06, two + rng.standard_normal((400, 5)) * 0.06, rng.standard_normal((500, 5))])
    every = []
    kept = near_vectors.clusters
    monkeypatch.setattr(near_vectors, "clusters", lambda nodes: every.append(kept(nodes)) or every[-1])
    got = {r.vec_id: r for r in near_vectors.components(frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).collect()}
    assert every[0].where("whole and home").count() > 300
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    short = {i: (got[i].n_links, n) for i, n in enumerate(want) if got[i].n_links != n}
    print("links", want.sum(), "vectors short", len(short), short)
    assert all(n <= w for n, w in short.values())
    assert not short


def test_audit_of_nothing(spark):
    none = frame(spark, [(1, [1.0, 0.0], 1)]).limit(0)
    assert tuple(near_vectors.audit(none, near_vectors.components(none)).first()) == (0, 0)


def test_audit_by_blocks(spark, monkeypatch):
    """Every block of the rows that ask meets every block of their label; what components leaves out has no links here either."""
    monkeypatch.setattr(near_vectors, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3, 6))
    rows = [(i, (base[i % 3] + rng.standard_normal(6) * 0.2).tolist(), i % 2) for i in range(130)]
    rows += [(140, [0.0] * 6, 0), (160, [float("nan")] + [1.0] * 5, 0), (180, [float("inf")] * 6, 0), (200, None, 0), (220, [None] * 6, 0), (240, [1e200] * 6, 0), (260, [1e-200] * 6, 0), (280, [1.0] * 6, None), (300, [1.0] * 5, 0)]
    t = frame(spark, rows)
    want = [(i, n) for i, n, _ in brute(rows) if i % 20 == 0]
    result = spark.createDataFrame([(i, 1) for i in range(0, 320, 10)], "vec_id long, n_links long")
    assert tuple(near_vectors.audit(t, result).first()) == (16, sum(n for _, n in want)) and any(n for _, n in want)
