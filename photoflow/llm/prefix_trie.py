"""The trie of conversation prefixes: how many conversations share which first turns, and what that would save.

A prefix is named by a digest that is a sum over its turns, so the digests of a conversation are running
totals and one conversation may fill many tasks. A count-min sketch of all digests is small enough for
every task. It never counts too few, so a digest with an estimate of one belongs to a single conversation:
its node is complete where its row is. Only prefixes that may be shared are shuffled and grouped exactly.

Conversations that share a node share all nodes above it, and a node belongs to its smallest member. Those
that a conversation owns are the last ones of its path, and sums over a subtree are sums over the members
of what each owns there. No step follows the trie level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.operators.graph import running_total
from photoflow.scratch import materialize, partitions

#: turns that a rebuilt conversation takes from the first of its family, less one; conversations of a family
HEAD, FAMILY = 9, 5
#: hash functions of the sketch, bits of its smallest and largest width, counters of a block
ROWS, LEAST_BITS, MOST_BITS, BLOCK = 4, 16, 25, 1 << 16
#: ids of a chunk of the list of conversations that end at a node
CHUNK = 1 << 16
KEY = ["k1", "k2"]


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn_hash, bytes): the turns of each conversation numbered from 1 by turn, null first.

    A null role or text is empty. Equal turn numbers are ordered by role and then text; repeated rows all
    count. Rows without conversation id are left out, other columns ignored, whatever their names.
    """
    cols = [F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col)]
    own = conversations.select(cols[0].cast("long").alias("conv_id"), cols[1].alias("turn"), F.coalesce(cols[2], F.lit("")).alias("role"), F.coalesce(cols[3], F.lit("")).alias("text"))
    named = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    own = own.where("conv_id is not null").withColumn("turn_hash", named)
    rows = own.select("conv_id", "turn", "turn_hash", F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "turns")
    # different turns of one number: only their texts are compared
    tied = rows.groupBy("conv_id", "turn").agg(F.min("turn_hash").alias("a"), F.max("turn_hash").alias("b")).where("a <> b").select("conv_id", "turn")
    tied = materialize(tied, "tied-turns")
    if tied.isEmpty():
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
    else:
        same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
        texts = own.alias("o").join(tied.alias("t"), same("o", "t", ["conv_id", "turn"]), "left_semi").distinct().withColumn("one", F.lit(1))
        ranked = running_total(texts, ["conv_id", "turn", "role", "text"], {"tie": "one"}, "tied-texts", within=["conv_id", "turn"])
        found = rows.alias("r").join(ranked.alias("k"), same("r", "k", ["conv_id", "turn", "turn_hash"]), "left")
        rows = found.select("r.*", F.coalesce("k.tie", F.lit(0).cast("long")).alias("tie"))
    placed = running_total(rows.withColumn("one", F.lit(1)), ["conv_id", "turn", "tie", "row"], {"before": "one"}, "ordered-turns", within=["conv_id"])
    return placed.select("conv_id", (F.col("before") + 1).alias("pos"), "turn_hash", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does: (turns, conversations).

    Conversation c takes the first h turns of c - c % FAMILY (all if fewer, none if there is no such
    conversation) and then its own after its first h, where h is crc32(c) % HEAD. The second table is
    (conv_id, length, total) with the number of turns, which may be 0, and the bytes of their texts.
    """
    turns = materialize(turns, "numbered-turns")
    first = F.when(F.col("pos") < HEAD, F.struct("pos", "turn_hash", "bytes"))  # HEAD - 1 turns at most
    per = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"), F.array_sort(F.collect_list(first)).alias("first"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = materialize(per.select("*", taken.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")), "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    joined = convs.join(bases, "base", "left").withColumn("base_first", F.coalesce("base_first", F.slice("first", 1, 0)))
    size = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda s, x: s + x["bytes"])
    joined = joined.withColumn("base_first", F.slice("base_first", 1, F.col("h"))).withColumn("gone", size(F.slice("first", 1, F.col("h"))))
    own = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = joined.select(
        "conv_id", "h", "base_first", (F.size("base_first") - F.col("h")).alias("shift"), (F.size("base_first") + own).alias("length"), (F.col("all_bytes") - F.col("gone") + size("base_first")).alias("total")
    )
    convs = materialize(convs, "rebuilt-conversations")
    ends = ["length", "total"]
    heads = convs.select("conv_id", *ends, F.explode("base_first").alias("x")).select("conv_id", F.col("x.pos").alias("pos"), "x.turn_hash", "x.bytes", *ends)
    tails = turns.join(convs.select("conv_id", "h", "shift", *ends), "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn_hash", "bytes", *ends)
    return heads.unionByName(tails), convs.select("conv_id", *ends)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, pos, turn_hash, bytes, length, total) with the digest of their prefix (k1, k2) and the one before it (p1, p2), and the bytes before."""
    halves = [F.xxhash64(F.lit(k), "turn_hash", "pos") for k in (1, 2)]
    lanes = {f"l{i}": x for i, x in enumerate(y for h in halves for y in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)))}
    summed = running_total(turns.withColumns(lanes), ["conv_id", "pos"], {f"s{i}": f"l{i}" for i in range(4)} | {"before": "bytes"}, "prefixes", within=["conv_id"])
    up_to = [F.col(f"s{i}") + F.col(f"l{i}") for i in range(4)]
    above = [F.col(f"s{i}") for i in range(4)]
    depth = F.col("pos")
    digest = lambda k, sums, d: F.xxhash64(F.lit(k), *sums, d)
    return summed.select(
        "conv_id", depth.alias("depth"), "length", "total", "bytes", "before",
        digest(11, up_to, depth).alias("k1"), digest(12, up_to, depth).alias("k2"), digest(11, above, depth - 1).alias("p1"), digest(12, above, depth - 1).alias("p2"),
    )


def _places(k1: np.ndarray, k2: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The counter of each key in every row of a sketch of 2^bits counters a row."""
    a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    for r in range(ROWS):
        yield (((a + np.uint64(r) * b) >> np.uint64(64 - bits)) + np.uint64(r << bits)).astype(np.int64)


def _add(counts: np.ndarray, places: np.ndarray) -> None:
    """Counters stop at two, which means more than one."""
    at, n = np.unique(places, return_counts=True)
    counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def sketch(keys: DataFrame, n: int, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """(bit for each counter that is exactly one, bits of the width) of a count-min sketch of n keys (k1, k2).

    A row has the least power of two of at least 4 n counters, from 2^LEAST_BITS to 2^most_bits; the result is at
    most ROWS * 2^most_bits / 8 bytes (16 MB by default). With more keys than that estimates are larger, so
    more prefixes are grouped exactly; none is lost. Each task counts its own keys, and the blocks of all
    tasks are summed by block, one after the other.
    """
    bits = min(max((4 * n - 1).bit_length(), LEAST_BITS), most_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = np.zeros(ROWS << bits, np.uint8), False
        for batch in batches:
            any_row |= batch.num_rows > 0
            for places in _places(*_longs(batch, *KEY), bits):
                _add(counts, places)
        if any_row:
            for block, part in enumerate(counts.reshape(-1, min(BLOCK, 1 << bits))):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [part.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(0, np.uint8)

        def bit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([last], pa.int32()), "ones": [np.packbits(total == 1, bitorder="little").tobytes()]})

        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.uint8)
                if block == last:
                    total = np.minimum(total + part, 2)
                    continue
                if last is not None:
                    yield bit()
                last, total = block, part
        if last is not None:
            yield bit()

    spark = keys.sparkSession
    counted = keys.select(*KEY).mapInArrow(count, "block int, counts binary").repartition(partitions(spark), "block").sortWithinPartitions("block")
    size = min(BLOCK, 1 << bits) // 8
    ones = np.zeros((ROWS << bits) // 8, np.uint8)
    for row in counted.mapInArrow(merge, "block int, ones binary").toLocalIterator():  # bounded by the width
        ones[row.block * size : (row.block + 1) * size] = np.frombuffer(row.ones, np.uint8)
    return ones, bits


def screened(rows: DataFrame, ones: np.ndarray, bits: int) -> DataFrame:
    """rows with `alone` and `parent_alone`: whether their digest, and the one before, is proved to occur once."""
    shared = rows.sparkSession.sparkContext.broadcast(ones)
    names = rows.columns

    def once(k1: np.ndarray, k2: np.ndarray) -> pa.Array:
        found = np.zeros(len(k1), bool)
        for at in _places(k1, k2, bits):
            found |= (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pa.array(found)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, once(*_longs(batch, "k1", "k2")), once(*_longs(batch, "p1", "p2"))], names=[*names, "alone", "parent_alone"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(probe, f"{fields}, alone boolean, parent_alone boolean")


def lists_sha256(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the decimal conv_ids of each key, ascending and joined by commas.

    Ranges of the sorted ids are joined into chunks, and the chunks of a key are hashed one after the other,
    so no task holds more than one chunk of a key, however many ids it has.
    """
    spark = ends.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: tuple, ids: list[int]) -> tuple:
            return (*key, ids[0], ",".join(map(str, ids)))

        def chunks() -> Iterator[tuple]:
            last, ids = None, []
            for a, b, conv in keyed(batches):
                if ids and (last != (a, b) or len(ids) == chunk):
                    yield made(last, ids)
                    ids = []
                last = a, b
                ids.append(conv)
            if ids:
                yield made(last, ids)

        yield from _batches(chunks(), [*KEY, "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.large_string()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple]:
            last, state = None, None
            for a, b, _, ids in keyed(batches):
                if last != (a, b):
                    if state is not None:
                        yield (*last, state.hexdigest())
                    last, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if state is not None:
                yield (*last, state.hexdigest())

        yield from _batches(sums(), [*KEY, "ends_sha256"], [pa.int64(), pa.int64(), pa.string()])

    order = [*KEY, "conv_id"]
    ranged = ends.select(*order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    joined = ranged.mapInArrow(join, "k1 long, k2 long, first long, ids string")
    return joined.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `most` bytes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += 64 + len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def trie(turns: DataFrame, convs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each node of the prefix trie, the root included: NODE.

    turns is (conv_id, pos, turn_hash, bytes, length, total), positions 1 to length; convs is (conv_id, length,
    total), also those without turns. Without any conversation there is no node.
    """
    spark = turns.sparkSession
    rows = materialize(prefixes(turns), "prefixes")
    every = convs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("turns"), F.min("conv_id").alias("root"), F.count_if(F.col("length") > 0).alias("begun")).first()
    seen = screened(rows, *sketch(rows, every.turns, most_bits))
    root = F.lit(every.root).cast("long")
    ended = F.col("depth") == F.col("length")

    # prefixes that may be shared, grouped exactly
    maybe = materialize(seen.where("not alone").select("conv_id", "depth", "length", "total", "bytes", "before", *KEY), "maybe-shared")
    nodes = maybe.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.count_if(ended).alias("ends"), F.first("depth").alias("at"), F.first("bytes").alias("last_bytes"))
    nodes = materialize(nodes, "nodes")
    placed = materialize(maybe.join(nodes.select(*KEY, "n", "low", "ends"), KEY), "placed")
    others = F.col("low") < F.col("conv_id")
    of_conv = placed.groupBy("conv_id").agg(
        F.count_if(others).alias("unowned"), F.max(F.when(others, F.col("before") + F.col("bytes"))).alias("unowned_bytes"),
        F.max(F.when(others, F.struct("depth", "low")))["low"].alias("above"), F.max(F.when(ended, ~others & (F.col("n") == F.col("ends")))).alias("leaf"),
    )
    of_conv = materialize(of_conv, "owners")
    at = placed.join(of_conv, "conv_id")
    owns = ~others
    parent = F.when(F.col("depth") == 1, root).when(F.col("depth") == F.col("unowned") + 1, F.col("above")).otherwise(F.col("conv_id"))
    below = F.col("total") - F.when(owns, F.col("before")).otherwise(F.col("unowned_bytes"))
    shared = at.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max(F.when(owns, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.count_if((F.col("depth") < F.col("length")) & (F.col("depth") >= F.col("unowned"))).alias("n_children"), F.count_if(F.coalesce("leaf", F.lit(True))).alias("n_leaves"),
        (F.sum(F.col("total") - F.col("before")) - F.sum(below)).alias("saved_tokens"),
    )
    nobody = lambda c: F.lit(0).cast("long").alias(c)
    turnless = convs.where("length = 0").select(nobody("k1"), nobody("k2"), "conv_id")
    ends = lists_sha256(placed.where(ended).select(*KEY, "conv_id"))
    shared = shared.join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    # proved single: complete where they are, but for the parent of the first of them
    single = seen.where("alone").select("conv_id", "depth", "length", "parent_alone")
    inner = (F.col("depth") == 1) | F.col("parent_alone")
    local = single.where(inner).withColumn("parent_conv_id", F.when(F.col("depth") == 1, root).otherwise(F.col("conv_id")))
    first = single.where(~inner).join(of_conv.select("conv_id", "unowned", "above"), "conv_id")
    first = first.withColumn("parent_conv_id", F.when(F.col("unowned") == F.col("depth") - 1, F.col("above")).otherwise(F.col("conv_id")))
    more = F.col("depth") < F.col("length")
    tails = local.select("conv_id", "depth", "length", "parent_conv_id").unionByName(first.select("conv_id", "depth", "length", "parent_conv_id"))
    one = F.lit(1).cast("long")
    tails = tails.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), more.cast("long").alias("n_children"), one.alias("n_leaves"), nobody("saved_tokens"),
        F.when(more, F.lit(NO_ENDS)).otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256"),
    )
    return tails.unionByName(shared.select(*NODE)).unionByName(_root(spark, every, maybe, nodes, lists_sha256(turnless)))


def _root(spark, every, maybe: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The row of the root, of which every conversation is a member; none without conversations."""
    count = lambda c: F.count_if(c).alias
    single = maybe.agg(count(F.col("depth") == 1)("first"), count(F.col("depth") == F.col("length"))("last")).first()
    shared = nodes.agg(count(F.col("at") == 1)("first"), count(F.col("n") == F.col("ends"))("leaves"), F.coalesce(F.sum((F.col("n") - 1) * F.col("last_bytes")), F.lit(0)).alias("saved")).first()
    leaves = every.begun - single.last + shared.leaves
    long: dict[str, int | None] = {
        "k1": 0, "k2": 0, "conv_id": every.root, "depth": 0, "parent_conv_id": None, "n_convs": every.n, "n_children": every.begun - single.first + shared.first,
        "n_leaves": leaves or 1, "saved_tokens": shared.saved,
    }
    row: list[Column] = [F.lit(v).cast("long").alias(c) for c, v in long.items()]
    top = spark.range(1 if every.n else 0).select(*row)
    return top.join(ends, KEY, "left").select(*NODE[:-1], F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
