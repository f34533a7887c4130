"""Exact join of documents by the Jaccard similarity of their word shingles, as a T-occurrence search.

Two sets that reach the similarity share so many shingles that they also share T of those with the
smallest hashes (a fifth or so of each set, the sample). DivideSkip leaves out the L longest inverted lists
of a sample, L growing with T and shrinking with the length of the longest, and merges the short ones: a
document that occurs in T - L of them is a candidate, whose sorted set is then probed by binary search for
everything that the merge left out. Between machines the merge is Spark's sort-merge by shingle with a count
of each pair's occurrences. Lists that many classes share are not turned into pairs: their members are dealt
into blocks, and every set of one block is searched in the inverted lists of the other in the same manner.
Texts with equal sets are one class throughout, and links are searched between components, not within them,
so a group of copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.llm.words import SPACED, mix, shingles, slices, words
from photoflow.operators.graph import connected_components, running_total
from photoflow.scratch import materialize, partitions

#: share of a set by which its sample exceeds what the similarity alone asks for
SLACK = 0.06
#: postings of one bucket, about
BUCKET = 200_000
#: a shingle that so many classes of one slice share is dealt out over salted buckets
HOT = 64
MARK = np.uint64(0)
FREQUENT = 1 << 40
#: classes of an inverted list up to which its pairs are rows; longer lists are compared block by block
SHORT = 32
#: shingles (and 500 for each class) of a block
BLOCK = 200_000
#: how much costlier a probe of a long list is than a step of the merge; decides how many lists are long
MU = 0.0085
#: ids up to which the list of candidates is broadcast (8 bytes each); beyond, the join shuffles
BROADCAST_IDS = 500_000


def _sample_size(n, pct: int):
    return np.minimum(n, n - -(-pct * n // 100) + np.ceil(SLACK * n).astype(np.int64))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, data, off in slices(column):
        yield at, list(shingles(*words(data, off, SPACED), k))


def _signature(s: np.ndarray, seed: int) -> int:
    """Name of a set, never 0; equal sets have equal names."""
    with np.errstate(over="ignore"):
        own = mix(s + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        h = mix(np.array([own.sum(dtype=np.uint64) + np.uint64(len(s))]))[0] | np.uint64(1)
    return int(h.astype(np.int64)) if len(s) else 0


def _named(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, n, sig, twin) of every row, twin being a second name; both are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _sets(b.column(1), k):
                n = np.array([len(s) for s in sets])
                names = [pa.array(np.array([_signature(s, x) for s in sets], np.int64), mask=n == 0) for x in (seed, -1 - seed)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array(n, pa.int64()), *names], names=["id", "n", "sig", "twin"])

    return docs.mapInArrow(run, "id long, n long, sig long, twin long")


def _classes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their names, classes, seed): different sets have different names, or another seed is taken."""
    for seed in count():
        named = materialize(_named(docs, k, seed), "classes-of-rows")
        held = named.where("sig is not null").groupBy("sig").agg(F.min("n").alias("n"), F.min("id").alias("id"), F.min("twin").alias("low"), F.max("twin").alias("high"))
        held = materialize(held, "classes")
        if held.where("low <> high").isEmpty():
            return named.drop("twin"), held.select("sig", "n", "id"), seed
    raise AssertionError


def _postings(docs: DataFrame, k: int, pct: int, buckets: int, seed: int) -> DataFrame:
    """Samples of all sets as (bucket, h, sig), packed; the lists of one bucket meet in one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, b in enumerate(batches):
            for at, sets in _sets(b.column(0), k):
                sigs, samples = [], []
                for s in sets:
                    sig = _signature(s, seed)
                    if len(s) and sig not in seen:  # a copy in the same task adds nothing
                        seen.add(sig)
                        sigs.append(sig)
                        samples.append(s[: int(_sample_size(np.int64(len(s)), pct))])
                if len(seen) > 200_000:
                    seen.clear()
                if not sigs:
                    continue
                h = np.concatenate(samples)
                sig = np.repeat(np.array(sigs, np.int64).astype(np.uint64), [len(x) for x in samples])
                bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
                value, first, count = np.unique(h, return_inverse=True, return_counts=True)
                hot = count >= HOT
                if hot.any():
                    bucket = np.where(hot[first], -1 - (bucket + part + at) % buckets, bucket)
                    v = value[hot]
                    h, sig = np.append(h, v), np.append(sig, np.full(len(v), MARK))
                    bucket = np.append(bucket, (mix(v) % np.uint64(buckets)).astype(np.int64))
                order = np.argsort(bucket, kind="stable")
                bucket, h, sig = bucket[order], h[order], sig[order]
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(bucket))
                pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]]), pa.array([h[i:j].tobytes() for i, j in pairs], pa.binary()), pa.array([sig[i:j].tobytes() for i, j in pairs], pa.binary())], names=["bucket", "h", "sig"]
                )

    return docs.mapInArrow(run, "bucket long, h binary, sig binary")


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket, the (h, sig, df) whose shingle at least two classes hold."""
    h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64)
    salted = table.column("bucket")[0].as_py() < 0
    order = np.lexsort((sig, h))
    h, sig = h[order], sig[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
    h, sig = h[new], sig[new]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    lens = np.diff(np.append(starts, len(h)))
    hot = sig[starts] == MARK  # the smallest of a list
    df = np.repeat(np.where(hot | salted, FREQUENT, lens), lens)
    keep = (df > 1) & (sig != MARK)
    return pa.table({"h": h[keep].view(np.int64), "sig": sig[keep].view(np.int64), "df": df[keep]})


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what is counted and small."""
    return F.broadcast(df) if df.count() <= rows else df


def _reach(a: Column, b: Column, pct: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * pct


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity, by probing one sorted set with the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                good.append(100 * both >= pct * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    a, b = sets.select(F.col("sig").alias("a"), F.col("set").alias("sa")), sets.select(F.col("sig").alias("b"), F.col("set").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _packed(table: pa.Table) -> pa.Table:
    """One row for the classes of a block, the sets as bytes one after another."""
    own = [x for x in table.column("set").to_pylist()]
    cols = {c: [table.column(c).to_numpy().tobytes()] for c in ("sig", "comp", "n")}
    return pa.table({"center": table.column("center")[:1], "blk": table.column("blk")[:1], **{c: pa.array(v, pa.binary()) for c, v in cols.items()}, "sets": pa.array([b"".join(own)], pa.binary())})


def _long_lists(t, longest):
    """DivideSkip's number of lists that are probed and not merged, for an overlap t; less than t."""
    return np.minimum(np.floor(t / (MU * np.log2(np.maximum(longest, 2)) + 1)), t - 1).astype(np.int64)


def _links_of_blocks(a: tuple, b: tuple, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between components of two blocks, as few as connect all that is linked.

    Every set of the first block is a query to the inverted lists of the second: its short lists are merged,
    what occurs often enough is probed in the long ones, and the total decides.
    """
    (sa, ca, na, ha), (sb, cb, nb, hb) = a, b
    names, local = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    la, lb = local[: len(ca)], local[len(ca) :]
    root = np.arange(len(names))
    doc = np.repeat(np.arange(len(nb)), nb)
    order = np.argsort(hb, kind="stable")
    shingle, start = np.unique(hb[order], return_index=True)
    length = np.diff(np.append(start, len(hb)))
    posting = doc[order]
    place = np.repeat(np.arange(len(shingle)), length) * len(nb) + posting  # ascending
    off = np.append(0, np.cumsum(na))
    x, y = [], []
    for q in range(len(na)):
        t = -(-pct * int(na[q]) // 100)
        open_ = (root[lb] != root[la[q]]) & (100 * nb >= pct * na[q]) & (100 * na[q] >= pct * nb)
        if not open_.any():
            continue
        h = ha[off[q] : off[q + 1]]
        at = np.searchsorted(shingle, h)
        at = at[shingle[np.minimum(at, len(shingle) - 1)] == h]
        if len(at) < t:
            continue
        at = at[np.argsort(length[at], kind="stable")]
        skip = int(_long_lists(t, length[at[-1]]))
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        size = length[short]
        merged = posting[np.repeat(start[short] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        hits = np.bincount(merged, minlength=len(nb))
        live = np.flatnonzero(open_ & (hits >= t - skip))
        if not len(live):
            continue
        total = hits[live]
        if skip:
            probe = long[:, None] * len(nb) + live[None]
            where = np.minimum(np.searchsorted(place, probe), len(place) - 1)
            total = total + (place[where] == probe).sum(0)
        for d in live[100 * total >= pct * (na[q] + nb[live] - total)].tolist():
            one, other = root[la[q]], root[lb[d]]
            if one != other:
                root[root == one] = other
                x.append(q)
                y.append(d)
    return sa[np.array(x, int)], sb[np.array(y, int)]


def _between_blocks(lists: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Links across components within long lists (h, sig, n, comp), found block by block.

    Long lists of a group of near copies hold nearly the same classes, so lists are gathered under the
    class that occurs in most of them; its followers are dealt into blocks, and one block is searched
    in the lists of another. Blocks of one component, or too unlike in size, are not compared.
    """
    degree = lists.groupBy("sig").agg(F.count("*").alias("deg"))
    center = lists.join(degree, "sig").groupBy("h").agg(F.max(F.struct("deg", "sig"))["sig"].alias("center"))
    center = materialize(center, "centers-of-lists")  # so that a list with many members can be dealt over tasks
    members = lists.join(center, "h").select("center", "comp", "sig", "n").distinct().withColumn("w", F.col("n") + 500)
    members = running_total(members, ["center", "comp", "sig"], {"at": "w"}, "members", within=["center"]).withColumn("blk", F.floor(F.col("at") / BLOCK))
    meta = members.groupBy("center", "blk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("small"), F.max("n").alias("large"))
    i, j = (meta.select("center", *[F.col(c).alias(f"{c}_{x}") for c in ("blk", "lo", "hi", "small", "large")]) for x in "ij")
    plan = i.join(j, "center").where("blk_i <= blk_j and not (lo_i = hi_j and hi_i = lo_j)").where((F.col("large_i") * 100 >= F.col("small_j") * pct) & (F.col("large_j") * 100 >= F.col("small_i") * pct)).select("center", "blk_i", "blk_j")
    packed = members.select("center", "blk", "sig", "comp", "n").join(sets, "sig").groupBy("center", "blk").applyInArrow(_packed, "center long, blk long, sig binary, comp binary, n binary, sets binary")
    packed = materialize(packed, "blocks")
    side = lambda x: packed.select("center", *[F.col(c).alias(f"{c}_{x}") for c in ("blk", "sig", "comp", "n", "sets")])
    pairs = plan.join(side("i"), ["center", "blk_i"]).join(side("j"), ["center", "blk_j"])
    cols = [f"{c}_{x}" for x in "ij" for c in ("sig", "comp", "n", "sets")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                v = [np.frombuffer(b.column(c)[row].as_buffer(), np.uint64 if c.startswith("sets") else np.int64) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _links_of_blocks(tuple(v[:4]), tuple(v[4:]), pct)], names=["a", "b"])

    spread = pairs.repartition(partitions(lists.sparkSession), "center", "blk_i", "blk_j")
    return spread.select(*cols).mapInArrow(run, "a long, b long")


def _fetch_sets(docs: DataFrame, wanted: DataFrame, k: int, seed: int) -> DataFrame:
    """(sig, set) of the wanted classes, computed again from one text of each; wanted is (id, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(1).to_pylist()
            for at, sets in _sets(b.column(0), k):
                own = [(_signature(s, seed), s.tobytes()) for s in sets]
                own = [x for x, w in zip(own, want[at : at + len(own)], strict=True) if x[0] == w]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.binary())], names=["sig", "set"])

    w = _checked(wanted.withColumnRenamed("id", "_id"), BROADCAST_IDS)
    return docs.join(w, F.col("id").eqNullSafe(F.col("_id"))).select("text", "sig").mapInArrow(run, "sig long, set binary").dropDuplicates(["sig"])


def components(docs: DataFrame, k: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per input row; exact for every similarity of pct/100 or more.

    Shingles are compared by 64-bit hashes: two sets of s and t shingles are misjudged with a chance of
    about s * t / 2^64. Names of sets are checked by a second name, and chosen anew should two sets share one.

    Words are lower-cased in A-Z and split at ASCII white space. component_id is the smallest id
    reachable by links; texts without words (and null texts) are linked with nothing and are their own
    component. Null ids never become a component's id unless all of it are null. Repeated rows are
    nodes of their own with equal sets. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named, classes, seed = _classes(d, k)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * ((100 - pct) / 100 + SLACK)
    buckets = max(8 * partitions(spark), int(total // BUCKET))
    packed = _postings(d.select("text"), k, pct, buckets, seed)
    shared = packed.groupBy("bucket").applyInArrow(_shared, "h long, sig long, df long").dropDuplicates(["h", "sig"])
    # a partner of x has at least pct/100 * n shingles, and shares SLACK of these with x's sample: T
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * F.lit(pct) / 100) * SLACK))
    lists = shared.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("e")).join(classes.select("sig", "n"), "sig")
    lists = lists.withColumn("need", need).where(F.size("e") >= F.col("need"))
    longest = F.log2(F.element_at("e", -1)["df"].cast("double"))
    # the L longest lists are not merged; partners occur together in T - L of the others
    left = F.least(F.floor(F.col("need") / (F.lit(MU) * longest + 1)), F.col("need") - 1)
    lists = lists.withColumn("occurs", F.col("need") - left)
    merged = F.slice("e", F.lit(1), (F.size("e") - F.col("need") + F.col("occurs")).cast("int"))
    index = lists.select("sig", "n", "occurs", F.explode(merged).alias("x")).select("sig", "n", "occurs", F.col("x.h").alias("h"))
    index = materialize(index, "index")
    centers = index.groupBy("h").agg(F.min(F.struct("n", "sig")).alias("c"), F.count("*").alias("len")).where("len > 1").select("h", "len", F.col("c.sig").alias("c"), F.col("c.n").alias("cn"))
    centers = materialize(centers, "centers")  # so that a list with many members can be dealt over tasks
    # first each document against the first of its lists ...
    stars = index.join(centers, "h").where(F.col("sig") != F.col("c")).where(_reach(F.col("n"), F.col("cn"), pct))
    stars = stars.groupBy(F.col("sig").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("hits"))
    # (the two that it meets most often; any other link is found below)
    most = Window.partitionBy("a").orderBy(F.desc("hits"), "b")
    stars = materialize(stars.withColumn("place", F.row_number().over(most)).where("place <= 2").select("a", "b"), "stars")
    members = index.join(centers.select("h"), "h", "left_semi").select("sig").distinct()
    sets = materialize(_fetch_sets(d, classes.join(members, "sig", "left_semi").select("id", "sig"), k, seed), "sets")
    links = materialize(_verified(stars.select("a", "b"), sets, pct), "links")
    # ... then everything in lists that still hold several components, across components
    comp = materialize(connected_components(links), "components")
    placed = index.join(comp, F.col("sig") == F.col("node"), "left").select("h", "sig", "n", "occurs", F.coalesce("component", "sig").alias("comp"))
    placed = materialize(placed, "placed")
    open_lists = placed.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("len")).where("low <> high").select("h", "len")
    where = placed.join(materialize(open_lists, "open"), "h")
    # what is long here is not merged either: of the occurrences, as many may be missing
    long = where.where(F.col("len") > SHORT).groupBy("sig").agg(F.count("*").alias("long"))
    where = materialize(where.join(long, "sig", "left").withColumn("occurs", F.col("occurs") - F.coalesce("long", F.lit(0))).drop("long"), "open-lists")
    short = where.where(F.col("len") <= SHORT)
    side = lambda x: short.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("sig", "n", "comp", "occurs")])
    rest = side("a").join(side("b"), "h").where("a_sig < b_sig and a_comp <> b_comp").where(_reach(F.col("a_n"), F.col("b_n"), pct))
    rest = rest.groupBy(F.col("a_sig").alias("a"), F.col("b_sig").alias("b")).agg(F.count("*").alias("hits"), F.least(F.first("a_occurs"), F.first("b_occurs")).alias("occurs"))
    rest = rest.where("hits >= occurs").select("a", "b")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, sets, pct).unionByName(_between_blocks(where.where(F.col("len") > SHORT), sets, pct)).unionByName(links)
    more = materialize(more, "all-links")
    comp = materialize(connected_components(more), "final-components")
    placed = classes.join(comp, F.col("sig") == F.col("node"), "left").select("sig", "id", F.coalesce("component", "sig").alias("comp"))
    lowest = materialize(placed.groupBy("comp").agg(F.min("id").alias("low")), "lowest-of-components")
    found = materialize(placed.join(lowest, "comp").select("sig", "low"), "lowest")
    return named.join(found, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))
