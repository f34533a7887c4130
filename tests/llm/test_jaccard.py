import random
import re
from collections import defaultdict

import numpy as np

from photoflow.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k=4, pct=85):
    """rows of (id, text) -> sorted (id, set size, component)."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        n = defaultdict(int)
        for g in s:
            for j in lists[g]:
                n[j] += 1
            lists[g].append(i)
        for j, both in n.items():
            if 100 * both >= pct * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    pick = {r: min((d for d in ds if d is not None), default=None) for r, ds in low.items()}
    return sorted(((d, len(s), pick[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(docs, **kw):
    return sorted(map(tuple, jaccard.components(docs, **kw).collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def continuum(n, seed):
    """Near copies at all distances of a few originals, exact copies, shared passages, edge cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [[word() for _ in range(rng.choice([30, 60, 200]))] for _ in range(4)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(int(len(t) * rng.choice([0, 0.01, 0.03, 0.05, 0.1]))):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t = [word() for _ in range(300)] + passage
        if rng.random() < 0.1:
            t = t[: rng.randrange(6)]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in t)))
    return [*rows, (None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (n + 1, None), (n + 2, ""), (n + 3, "One"), (n + 4, "one"), (n + 5, "a b\tc d"), (n + 6, "x " * 50_000)]


def test_short_and_long_lists(spark, monkeypatch):
    rows = continuum(260, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as sig").repartition(3)
    want = brute(rows)
    assert found(docs) == want
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 20_000)
    monkeypatch.setattr(jaccard, "HOT", 4)
    assert found(docs) == want
    assert found(docs.limit(0)) == []


def test_long_words(spark):
    rng = random.Random(9)
    long = [rng.choice("abcdefgh") for _ in range(140_000)]
    swapped, upper = list(long), list(long)
    swapped[10], swapped[10 + 65_536] = "x", "y"
    long[10], long[10 + 65_536] = "y", "x"
    upper[10], upper[10 + 65_536] = "Y", "X"
    other = [*long[65_536:131_072], *long[:65_536], *long[131_072:]]
    short = "q" * 256
    rows = [(1, "".join(long)), (2, "".join(swapped)), (3, "".join(upper)), (4, "".join(other)), (5, short), (6, short + "q"), (7, short + "q" + " " * 400), (8, f"{short}qq one two"), (9, f"{short}qQ one\u00a0two"), (10, f" {short}QQ ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)
    assert {(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (7, 1, 6)} <= set(found(docs))


def test_search_between_blocks():
    """The merge and the probes find what counting all shared shingles finds."""
    rng = np.random.default_rng(4)
    for pct, size in ((85, 60), (80, 7), (90, 300)):
        base = np.unique(rng.integers(0, 1 << 60, size, dtype=np.uint64))
        sets = []
        for _ in range(40):
            own = base.copy()
            own[rng.random(len(own)) < rng.choice([0, 0.02, 0.06, 0.1])] = rng.integers(0, 1 << 60)
            sets.append(np.unique(np.append(own[: rng.integers(len(own) * 9 // 10, len(own) + 1)], rng.integers(0, 1 << 60, rng.integers(0, 4), dtype=np.uint64))))
        block = lambda at: (np.array(at), np.array(at), np.array([len(sets[i]) for i in at]), np.concatenate([sets[i] for i in at]))
        x, y = jaccard._links_of_blocks(block(list(range(20))), block(list(range(20, 40))), pct)
        got, want = list(range(40)), list(range(40))

        def root(p, i):
            while p[i] != i:
                i = p[i]
            return i

        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            got[root(got, i)] = root(got, j)
        for i in range(20):
            for j in range(20, 40):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                    want[root(want, i)] = root(want, j)
        part = lambda p: {frozenset(i for i in range(40) if root(p, i) == r) for r in {root(p, i) for i in range(40)}}
        assert part(got) == part(want) and len(x) > 0


def test_names_are_chosen_anew(spark, monkeypatch):
    """Should two sets share a name, another seed is taken."""
    rows = continuum(60, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = jaccard._signature

    def narrow(s, seed):
        return clash(s, seed) if seed else min(len(s), 1)

    monkeypatch.setattr(jaccard, "_signature", narrow)
    assert found(docs) == brute(rows)
