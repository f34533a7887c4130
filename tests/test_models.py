"""Order-dependent operators against plain sequential models on random input."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoflow.operators import cluster, graph, joins, sessions

BASE = datetime(2025, 9, 20)


def photos(spark, seed, n=900, sources=3):
    rng = random.Random(seed)
    rows, k = [], 0
    for s in range(sources):
        t = BASE
        for _ in range(rng.randrange(1, n)):
            t += timedelta(minutes=rng.choice([0, 0.2, 0.5, 1, 1, 2, 11, 12, 14, 24, 26, 31, 55]) if rng.random() < 0.2 else 0.3)
            rows.append((k, f"s{s}", t))
            k += 1
    return rows, spark.createDataFrame(rows, "photo_id long, source string, ts timestamp")


def adaptive(ts, gap=10, duration=30, least=50):
    n, out, start = len(ts), [], 0
    minutes = lambda a, b: (a - b).total_seconds() / 60
    if n < least:
        return out
    for i in range(1, n):
        g = minutes(ts[i], ts[i - 1])
        ahead = max((minutes(ts[j], ts[j - 1]) for j in range(i + 1, min(i + min(100, n - i), n))), default=0)
        if i - start < least:
            need = max(gap * 2, 30)
        elif minutes(ts[i - 1], ts[start]) >= duration:
            need = gap
        elif ahead > g * 2 and g < 30:
            need = max(gap * 1.5, 25)
        elif start < 200 and ahead > 50:
            need = max(gap * 2, 25)
        else:
            need = gap
        if g >= need:
            if minutes(ts[i - 1], ts[start]) >= duration and i - start >= least:
                out.append((start, i - 1))
            start = i
    if start < n - 1 and minutes(ts[-1], ts[start]) >= duration and n - start >= least:
        out.append((start, n - 1))
    return out


def test_adaptive_sessions(spark):
    for seed in range(6):
        rows, df = photos(spark, seed)
        want = {(s, a, b) for s in {r[1] for r in rows} for a, b in adaptive([r[2] for r in rows if r[1] == s])}
        got = {(r.source, r.start_idx, r.end_idx) for r in sessions.sessionize_adaptive(df, ["source"]).collect()}
        assert got == want, seed


def test_adaptive_sessions_over_chunks_and_one_source(spark, monkeypatch):
    monkeypatch.setattr(sessions, "CHUNK", 100)
    rows, df = photos(spark, 21, n=700)
    by = {s: [r[2] for r in rows if r[1] == s] for s in {r[1] for r in rows}}
    unknown = df.withColumn("source", F.when(F.col("source") != "s1", F.col("source")))
    want = {(None if s == "s1" else s, a, b) for s, ts in by.items() for a, b in adaptive(ts)}
    assert want and {(r.source, r.start_idx, r.end_idx) for r in sessions.sessionize_adaptive(unknown, ["source"]).collect()} == want
    assert sessions.sessionize_adaptive(df.limit(0), ["source"]).count() == 0


def test_sessions_by_range_equal_windows(spark):
    _, df = photos(spark, 11)
    one = df.withColumn("source", F.lit("all"))
    for d in (df, one):
        a = {(r.photo_id, r.session) for r in sessions.mark_sessions(d, ["source"], 10).collect()}
        assert a == {(r.photo_id, r.session) for r in sessions.mark_sessions_by_range(d, ["source"], 10).collect()}


def test_single_photo_is_a_game_and_splits_are_closed(spark):
    df = spark.createDataFrame([(1, "a", BASE), (2, "b", BASE), (3, "b", BASE + timedelta(minutes=5))], "photo_id long, source string, ts timestamp")
    assert [r.source for r in sessions.sessionize(df, ["source"]).collect()] == ["a"]
    many = spark.createDataFrame([(i, "a", BASE + timedelta(minutes=i)) for i in range(61)], "photo_id long, source string, ts timestamp")
    games = sessions.number_games(sessions.sessionize(many, ["source"]), ["source"])
    split = spark.createDataFrame([(BASE + timedelta(minutes=30),)], "split_ts timestamp")
    got = sessions.apply_manual_splits(games, many, split, ["source"], min_photos=10).orderBy("game_id").collect()
    assert [r.photo_count for r in got] == [31, 31]


def test_games_over_several_days_keep_their_photos_and_splits(spark):
    rows = [(i, "ab"[i % 2], BASE + timedelta(hours=i)) for i in range(150)] + [(150, "a", None)]
    df = spark.createDataFrame(rows, "photo_id long, source string, ts timestamp")
    games = sessions.number_games(sessions.sessionize(df, ["source"], min_gap=121), ["source"])
    assert {(r.source, r.game_id, r.photo_id) for r in sessions.game_photos(df, games, ["source"]).collect()} == {(s, 1, i) for i, s, t in rows if t}
    at = [BASE + timedelta(hours=h) for h in (24, 73)]
    split = spark.createDataFrame([(t,) for t in [*at, at[0], BASE - timedelta(days=9), None]], "split_ts timestamp")
    got = sessions.apply_manual_splits(games, df, split, ["source"], min_photos=1).orderBy("source", "game_id").collect()
    want = [(s, sum(a <= t <= b for _, o, t in rows if t and o == s)) for s, first, last in (("a", 0, 148), ("b", 1, 149)) for a, b in zip([BASE + timedelta(hours=first), *at], [*at, BASE + timedelta(hours=last)], strict=True)]
    assert [(r.source, r.photo_count) for r in got] == want


def test_greedy_leaders(spark):
    for seed in range(4):
        rng = random.Random(seed)
        pairs = {(g, *sorted(rng.sample(range(30), 2))) for g in range(3) for _ in range(60)}
        items = spark.createDataFrame([(g, i) for g in range(3) for i in range(30)], "g long, ord long")
        got = {(r.g, r.ord): r.leader for r in cluster.greedy_leaders(items, spark.createDataFrame(list(pairs), "g long, a long, b long"), ["g"]).collect()}
        for g in range(3):
            leaders = []
            for i in range(30):
                mine = next((x for x in leaders if (g, x, i) in pairs), None)
                if mine is None:
                    leaders.append(i)
                assert got[(g, i)] == (i if mine is None else mine)


def test_components_and_running_total(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    vals = [(f"s{rng.randrange(3)}" if rng.random() < 0.9 else None, k, rng.randrange(9)) for k in range(300)]
    t = graph.running_total(spark.createDataFrame(vals, "s string, k long, v long"), ["s", "k"], {"run": "v"}, within=["s"])
    for r in t.collect():
        assert r.run == sum(v for s, k, v in vals if s == r.s and k < r.k)


def test_dbscan(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.3, (40, 4)) for c in ([5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 1])] + [rng.normal(0, 3, (30, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = 1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    near, label, no = d <= 0.05, {}, 0
    core = near.sum(1) >= 5
    for i in np.flatnonzero(core):
        if i in label:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if j in label:
                continue
            label[j] = no
            if core[j]:
                stack += [k for k in np.flatnonzero(near[j]) if k not in label]
        no += 1
    got = {r.id: r.label for r in cluster.dbscan(df, 0.05, 5).collect()}
    assert got == {i: label.get(i, -1) for i in range(len(x))}


def test_detectors(spark):
    d = joins.Detectors()

    def fn(batch, config):
        if (batch["image"] == 3).any():
            raise ValueError("broken")
        return batch.assign(n=config["n"])[["image", "n"]]

    d.register("x", fn, "image long, n long", n=2)
    images = spark.range(6).withColumnRenamed("id", "image")
    got = {r.image: (r.success, r.n, r.error) for r in d.run("x", images, n=5, extra=1).collect()}
    assert got[3] == (False, None, "broken") and got[1] == (True, 5, None)
    assert not d.run("y", images).first().success


def linked(x, k, linkage):
    """One-by-one agglomeration into k clusters, distances of clusters taken over all pairs of their members."""
    groups = [[i] for i in range(len(x))]

    def between(a, b):
        if linkage == "average":
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            return np.mean([1 - u[i] @ u[j] for i in a for j in b])
        return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))

    while len(groups) > k:
        _, i, j = min((between(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("block", [15, 1000])
def test_hierarchical_faces(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.4, (n, 5)) + rng.normal(0, 1, 5) for n in (12, 5, 9, 14)])
    x[3] = x[2]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for linkage, most, k in (("average", None, 5), ("ward", None, 5), ("ward", 3, 3)):
        got = cluster.hierarchical_faces(v, 8, linkage, most).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.label, set()).add(r.id)
        assert len(got) == len(x) and sorted(groups) == list(range(k))
        assert {frozenset(g) for g in groups.values()} == linked(x, k, linkage), linkage
    assert {r.label for r in cluster.hierarchical_faces(v.limit(5), 8).collect()} == {0}
    assert cluster.hierarchical_faces(v.limit(0), 8).count() == 0


@pytest.mark.parametrize("linkage", ["average", "ward"])
def test_one_by_one_merges_need_no_round_each(spark, monkeypatch, linkage):
    """One cluster takes in the next nearest again and again, so a round has a single pair of mutual nearest."""
    monkeypatch.setattr(cluster, "BLOCK", 25)
    far = 0.001 * 1.12 ** np.arange(60)
    x = np.stack([np.cos(far), np.sin(far)], 1) if linkage == "average" else far[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    groups, log = {}, []
    for r in cluster.hierarchical_faces(v, 12, linkage, log=log).collect():
        groups.setdefault(r.label, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == linked(x, 5, linkage)
    assert log[0] == 60 and len(log) <= 4


@pytest.mark.parametrize("linkage", ["average", "ward"])
def test_tiles_find_the_nearest_at_any_scale(linkage):
    """Bounds of single precision leave out no nearest cluster, whatever the size of the components and their offset."""
    rng = np.random.default_rng(4)
    for scale, offset in ((1, 0), (1, 5000), (1e-12, 0), (1e12, 3), (1e25, 0)):
        x, w = (rng.normal(0, 1, (240, 6)) + offset) * scale, rng.integers(1, 9, 240).astype(float)
        x[7], x[200], x[31] = x[3], x[3], 0
        if linkage == "average":
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids = rng.permutation(1000)[:240]
        a, b = (cluster._Tile(ids[s], x[s], w[s], linkage) for s in (slice(0, 110), slice(110, 240)))
        alone = a.rows(np.array([5]))
        for one, other in ((a, a), (b, b), (a, b), (alone, alone)):
            one.meet(other)
        assert alone.other[0] == -1 and np.isinf(alone.d[0])
        for i in range(240):
            rest = np.flatnonzero(np.arange(240) != i)
            d = cluster._apart(np.repeat(x[i : i + 1], 239, 0), np.repeat(w[i], 239), x[rest], w[rest], linkage)
            want = min(zip(d, cluster._pair_hash(np.repeat(ids[i], 239), ids[rest]), ids[rest], strict=True))
            t, k = (a, i) if i < 110 else (b, i - 110)
            assert (t.d[k], t.tie[k], t.other[k]) == want


def test_kmeans_faces(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, (30, 4)) + c for c in ([0, 0, 0, 0], [5, 0, 0, 0], [0, 5, 0, 5])])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for kw, k in (({}, 3), ({"most": 50}, 3), ({"most": 2}, 2)):
        got = {r.id: r.label for r in cluster.kmeans_faces(v, 30, **kw).collect()}
        assert len(got) == 90 and len(set(got.values())) == k
        if k == 3:
            assert all(len({got[i] for i in range(s, s + 30)}) == 1 for s in (0, 30, 60))
    assert (cluster.clusters_wanted(1000, 5, 50), cluster.clusters_wanted(6, 5, 50), cluster.clusters_wanted(1000, 5), cluster.clusters_wanted(3, 5)) == (50, 2, 200, 1)


def test_dominant_colors(spark):
    rng = np.random.default_rng(6)
    rows = [(im, *(np.array(c) + rng.integers(-3, 4, 3)).tolist()) for im in (1, 2) for c, n in (((200, 20, 20), 60), ((20, 200, 20), 30), ((20, 20, 200), 10)) for _ in range(n)]
    got = cluster.dominant_colors(spark.createDataFrame(rows, "image long, r int, g int, b int"), k=3).collect()
    for im in (1, 2):
        own = sorted((r for r in got if r.image == im), key=lambda r: r.cluster)
        assert abs(sum(r.share for r in own) - 1) < 1e-9 and [r.share for r in own] == sorted((r.share for r in own), reverse=True)
        # every pixel counts for the nearest centre, and each centre is the mean of its pixels
        p = np.array([x[1:] for x in rows if x[0] == im], float)
        c = np.array([(r.r, r.g, r.b) for r in own])
        near = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for k, r in enumerate(own):
            assert abs((near == k).mean() - r.share) < 1e-9 and np.allclose(p[near == k].mean(0), c[k])


def test_leaders_of_boxes_by_one_shuffle(spark, monkeypatch):
    rng = random.Random(8)
    row = lambda g, i: (g, i, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(0, 30)), float(rng.randrange(5, 30)), rng.random(), rng.choice("ab"), "r")
    rows = [row(g, i) for g in range(6) for i in range(rng.randrange(1, 40))] + [(None, 1, 0.0, 0.0, 9.0, 9.0, 0.5, "a", "r"), (9, 1, None, 0.0, 9.0, 9.0, 0.9, "a", "r"), (9, 2, 0.0, 0.0, 9.0, 9.0, 0.9, "a", "r")]
    d = spark.createDataFrame(rows, "image long, ord long, x double, y double, w double, h double, confidence double, method string, resolution string").repartition(3)
    for strict, t in ((False, 0.3), (True, 0.0)):
        old = cluster.greedy_leaders(d.select("image", "ord"), joins.overlap_pairs(d, t, strict=strict), ["image"]).where("image is not null")
        want, whole = sorted(map(tuple, old.collect())), sorted(map(str, cluster.reconcile(d, old).collect()))
        for small in (200, 20, 0):
            monkeypatch.setattr(cluster, "SMALL", small)
            led = cluster.overlap_leaders(d, t, strict=strict)
            assert sorted(map(tuple, led.select("image", "ord", "leader").collect())) == want
            assert len(cluster.reconcile(led, None).collect()) == len(whole)
        monkeypatch.setattr(cluster, "SMALL", 200)
    plan = cluster.reconcile(cluster.overlap_leaders(d, 0.3), None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_leaders_by_fold_and_by_rounds(spark, monkeypatch):
    rng = random.Random(4)
    items = [(g, i) for g in range(4) for i in range(rng.randrange(1, 40))]
    pairs = [(g, a, b) for g, a in items for h, b in items if g == h and a < b and rng.random() < 0.2]
    t, p = spark.createDataFrame(items, "g long, ord long"), spark.createDataFrame(pairs, "g long, a long, b long")
    folded = sorted(map(tuple, cluster.greedy_leaders(t, p, ["g"]).collect()))
    for small in (0, 20):
        monkeypatch.setattr(cluster, "SMALL", small)
        assert sorted(map(tuple, cluster.greedy_leaders(t, p, ["g"]).collect())) == folded
    for g in range(4):
        led = []
        for _, i in sorted(x for x in items if x[0] == g):
            before = [a for h, a, b in pairs if h == g and b == i and a in led]
            if not before:
                led.append(i)
            assert (g, i, min(before, default=i)) in folded


def test_inherited_types(spark):
    rng = random.Random(2)
    rows = []
    for s in "ab":
        for f in range(30):
            for k in range(4):
                rows.append((f"{s}{f}-{k}", s, f, f"{s}{f - 1}-{rng.randrange(5)}" if f and rng.random() < 0.9 else None, rng.choice(["unknown", "unknown", "football", "tennis"])))
    known = {}
    for i, _, _, prev, kind in sorted(rows, key=lambda r: r[2]):
        before = known.get(prev, "unknown") if prev else "unknown"
        known[i] = before if before != "unknown" else kind
    t = spark.createDataFrame(rows, "ball_id string, source string, frame int, prev_id string, ball_type string")
    assert {r.ball_id: r.tracked_type for r in joins.inherit_types(t).collect()} == known


def test_neighbouring_photos_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(sessions, "CHUNK", 40)
    rows, df = photos(spark, 31, n=400)
    df = df.union(spark.createDataFrame([(10_000 + k, "s1", None) for k in range(3)], df.schema))
    df = df.withColumn("source", F.when(F.col("source") != "s2", F.col("source")))  # an unknown source too
    by = {}
    for i, s, t in [*rows, *((10_000 + k, "s1", None) for k in range(3))]:
        by.setdefault(None if s == "s2" else s, []).append((t is not None, t or BASE, i))
    want, around = {}, {}
    for s, own in by.items():
        own.sort()
        gap = [None if not k or not own[k - 1][0] else (own[k][1] - own[k - 1][1]).total_seconds() / 60 for k in range(len(own))]
        for k, (_, _, i) in enumerate(own):
            want[i] = (gap[k], max((g for g in gap[k + 1 : k + 1 + 25] if g is not None), default=0.0))
            around[i] = tuple(own[j][1] if 0 <= j < len(own) and own[j][0] else None for j in (k - 1, k + 1))
    got = {r.photo_id: (r.gap, r.lookahead) for r in sessions.lookahead_gap(df, ["source"], 25).collect()}
    assert got.keys() == want.keys()
    for i, (g, ahead) in want.items():
        assert (got[i][0] is None) == (g is None) and abs((got[i][0] or 0) - (g or 0)) < 1e-9 and abs(got[i][1] - ahead) < 1e-9
    known = df.where("source is not null and ts is not null")
    marked = sessions.mark_sessions(known, ["source"], 10)
    games = sessions.photo_gaps(marked, sessions.sessionize(known, ["source"], 10, 0, marked), ["source"]).collect()
    members = {}
    for r in marked.collect():
        members.setdefault((r.source, r.session), []).append((r.ts, r.photo_id))
    for g in games:
        own = sorted(members[(g.source, g.session)])
        before, after = around[own[0][1]][0], around[own[-1][1]][1]
        seconds = lambda a, b: None if a is None or b is None or a == b else (a - b).total_seconds()
        assert (g.gap_before_s, g.gap_after_s) == (seconds(g.start_time, before), seconds(after, g.end_time))


def test_nearest_ball_by_cells(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice("ab"), BASE + timedelta(seconds=rng.randrange(40) ** 2), rng.uniform(-200, 200), rng.uniform(-200, 200), "unknown") for k in range(600)]
    rows += [(600, "a", BASE, None, 1.0, "unknown"), (601, "a", BASE, 50.0, 0.0, "unknown"), (602, "a", BASE + timedelta(seconds=1), 0.0, 0.0, "unknown")]
    df = spark.createDataFrame(rows, "ball_id long, source string, ts timestamp, cx double, cy double, ball_type string")
    frames = {s: sorted({t for _, o, t, *_ in rows if o == s}) for s in "ab"}
    at = lambda r: frames[r[1]].index(r[2]) + 1
    got = {r.ball_id: r for r in joins.track_nearest(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        near = [(np.hypot(r[3] - p[3], r[4] - p[4]), p[0]) for p in rows if p[1] == r[1] and at(p) == at(r) - 1 and None not in (p[3], r[3])]
        best = min((n for n in near if n[0] < 50), default=(None, None))
        assert got[r[0]].frame == at(r) and got[r[0]].prev_id == best[1]


@pytest.mark.parametrize("space", ["hsv", "lab"])
def test_dominant_colors_in_other_spaces(spark, space):
    rng = np.random.default_rng(8)
    rows = [(1, *np.clip(np.array(c) + rng.integers(-4, 5, 3), 0, 255).tolist()) for c, n in (((200, 30, 30), 60), ((30, 190, 40), 30), ((40, 40, 210), 10)) for _ in range(n)]
    pixels = spark.createDataFrame(rows, "image long, r int, g int, b int")
    own = sorted(cluster.dominant_colors(pixels, k=3, color_space=space).collect(), key=lambda r: r.cluster)
    assert [round(r.share, 2) for r in own] == sorted((round(r.share, 2) for r in own), reverse=True) and abs(sum(r.share for r in own) - 1) < 1e-9
    if space == "hsv":  # the way back is exact, but for hues around red
        near = [min(np.abs(np.array([r.r, r.g, r.b]) - c).max() for c in ((200, 30, 30), (30, 190, 40), (40, 40, 210))) for r in own]
        assert sum(n < 15 for n in near) >= 2
    with pytest.raises(ValueError):
        cluster.dominant_colors(pixels, color_space="cmyk")


def test_equal_colours_of_a_photo_are_compared_once(spark):
    rng = np.random.default_rng(2)
    photo, l, a, bb = ([int(x) for x in rng.integers(0, 3, 60)] for _ in range(4))  # noqa: E741
    rows = [(p, i, i, *(float(9 * x) for x in c), 1.0) for i, (p, *c) in enumerate(zip(photo, l, a, bb, strict=True))] + [(7, 60, 60, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "photo long, ord long, seq long, l double, a double, bb double, percentage double")
    few = df.groupBy("photo", "l", "a", "bb").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    plain = {}
    for p in set(photo):
        c = [np.array(r[3:6]) for r in rows if r[0] == p]
        d = [np.sqrt(((x - y) ** 2).sum()) / 100 for i, x in enumerate(c) for y in c[i + 1 :]]
        plain[p] = min(sum(d) / len(d) / 0.15, 1)
    for given in (df, few):
        got = {r.photo: r.separation for r in cluster.color_separation(given).collect()}
        assert set(got) == set(plain) and all(abs(got[p] - plain[p]) < 1e-9 for p in plain)


def test_equally_near_balls_tie(spark):
    from photoflow.streaming.streams import _nearest

    first, second = (1.0, 3.95), (2.0, 3.55)  # equal by the square root of the sum; by the JVM's hypot the second is nearer
    assert np.sqrt(1.0 + 3.95 * 3.95) == np.sqrt(4.0 + 3.55 * 3.55)
    t = datetime(2024, 1, 1)
    prev, now = [(1, *first), (2, *second)], (9, 0.0, 0.0)
    rows = [("s", t, *p, "unknown") for p in prev] + [("s", t + timedelta(hours=1), *now, "unknown")]
    df = spark.createDataFrame(rows, "source string, ts timestamp, ball_id long, cx double, cy double, ball_type string")
    assert {r.ball_id: r.prev_id for r in joins.track_nearest(df).collect()} == {1: None, 2: None, 9: 1}
    assert _nearest([(1, *now, "unknown")], [(0, *p, "unknown") for p in prev], 50)[0][1] == 1


def test_nearest_of_a_frame_before(spark):
    from photoflow.streaming.streams import _nearest

    rng = random.Random(3)
    ball = lambda i: (0, i, float(rng.randrange(400)), float(rng.randrange(90)), "x")
    prev, frame = [ball(i) for i in range(300)], [ball(i) for i in range(500, 900)]
    want = [min(((d, p[1]) for p in prev if (d := np.sqrt((b[2] - p[2]) ** 2 + (b[3] - p[3]) ** 2)) < 9), default=(0, None))[1] for b in frame]
    assert [h and h[1] for h in _nearest(frame, prev, 9)] == want and None in want
