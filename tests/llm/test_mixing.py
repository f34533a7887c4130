import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from photoflow.llm import mixing


def levels(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    left = total
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeats * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(docs, got):
    size = {}
    per = defaultdict(int)
    for r in docs.collect():
        per[r.source] += len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    want = levels(per)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == per[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1.001, (s, taken[s], t)
    return size


def test_targets_and_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    out, slices = mixing.mix(docs)
    got = out.collect()
    assert len(got) == docs.count()
    check(docs, got)
    again = mixing.mix(docs.repartition(7))[0].select("doc_id", "taken").collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert slices.selectExpr("sum(end - first)").first()[0] == sum(r.taken for r in got)


def test_edges(spark):
    rows = [(1, "a b c", None, 1), (2, None, "x", 1), (3, "", "y", 1), (4, "w " * 3000, "big", 1), (4, "w " * 3000, "big", 1), (None, "one two", "small", 1), (6, "q", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs)[0].collect()
    assert len(got) == len(rows)
    check(docs, got)
    assert mixing.mix(docs.limit(0))[0].count() == 0
    assert mixing.mix(docs.where("text is null"))[0].first().taken == 0


def counted(docs):
    """Words and the largest document of each source."""
    words, most = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        n = len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
        words[r.source] += n
        most[r.source] = max(most[r.source], n)
    return words, most


def test_repeated_documents_follow_the_schedule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, most = counted(docs)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    after, _ = counted(out)
    want = levels(before)
    for s, t in want.items():
        assert abs(after[s] - t) <= most[s] / 2 + 1, (s, after[s], t)
    # the order is that of the first slots, each of which belongs to one source
    docs_of, slices = mixing.mix(docs)
    own = slices.join(docs_of.select("row", "source", "size"), "row").groupBy("row", "pass", "source", "size").agg(F.min("slot").alias("slot"), F.sum(F.col("end") - F.col("first")).alias("got"))
    assert [r.source for r in rows] == [r.source for r in own.where("got * 2 >= size").orderBy("slot").collect()]
    # and the schedule spreads a source: every tenth of the slots holds a tenth of its slices' words
    total = sum(want.values())
    for s in sorted(want, key=lambda x: (-want[x], x))[:3]:
        tenths = Counter()
        for r in slices.join(docs_of.where(F.col("source") == s).select("row"), "row").groupBy(F.floor(F.col("slot") / 200).alias("t")).agg(F.sum(F.col("end") - F.col("first")).alias("n")).collect():
            tenths[r.t] = r.n
        assert all(0.8 < tenths[t] / want[s] * slices.select("slot").distinct().count() / 200 < 1.2 for t in range(10)), (s, tenths, total)
    assert max(Counter(r.doc_id for r in rows).values()) <= 3


def test_repeated_edges(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "y"), (4, "w " * 30_000, "big"), (4, "w " * 30_000, "big"), (None, "one two", "small"), (6, "q", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _times", "2 as _copy", "3 as slot", "4 as slots", "5 as id", "6 as doc", "7 as text_hash", "8 as row", "9 as size")
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.source, r._copy, r.slot, r.doc, r.size) for r in out.collect())
    assert set(got.values()) <= {1, 2, 3, 4, 6} and {k[2:] for k in got} == {(2, 3, 6, 9)}
    assert {k[0] for k in got} >= {1, None, 6} and not {2, 3} & {k[0] for k in got}
    assert got[(4, "big", 2, 3, 6, 9)] % 2 == 0
    assert mixing.repeated(docs.limit(0)).count() == 0 and mixing.repeated(docs.where("text is null")).count() == 0


def test_points_are_exact(spark):
    slots = [0, 1, 2, 10**6 + 7, 10**9 + 9, 2**40 - 1, 2**41 + 12345]
    got = spark.createDataFrame([(s,) for s in slots], "s long").select(mixing.point(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == [s * mixing.PHI % (1 << mixing.BITS) for s in slots]
