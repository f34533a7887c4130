"""Exact k-means in integers, its vectors rescanned only when a bound on a heap expires.

Vectors lie in blocks. A block keeps, for each cluster, a heap of its vectors by the gap between the distance
to the nearest centroid and the second nearest. Centroids that move may shrink a gap by the sum of their
movements at most; that sum is added up for each cluster, and a gap is stored with the sum at its time, so
nothing is touched until the sum reaches the top of a heap. What is popped is compared with all centroids.

The blocks are written once, bucketed by their number; what a round changes is a small row for each block in
a table of the same buckets, so a round joins the two without a shuffle and rewrites no vector. Between
rounds the driver holds the sums of the clusters only.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.scratch import materialize, new_path, partitions

#: vectors of a block
BLOCK = 4096
#: largest absolute component: squared distances of 64 of them stay below 2^63
LARGEST = 1 << 27
STATE = "block long, offsets binary, places binary, gaps binary, scanned long, changes array<struct<cluster:int,n:long,s:array<long>>>"
_CHANGES = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, x): vectors of exactly `size` finite components, each as floor(scale * component); the others are left out."""
    v = F.col(f"`{vec_col}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda c: c.cast("double")).alias("x"))
    kept = own.where((F.size("x") == size) & F.forall("x", finite))
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def first_centroids(kept: DataFrame, k: int, salt: str = "2") -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `salt:vec_id`, in its order; equal ids by components, null ids last; all if fewer."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r.x for r in kept.select("x", name.alias("at")).orderBy(F.col("at").asc_nulls_last(), "x").limit(k).collect()]


def _blocks(kept: DataFrame, block: int) -> DataFrame:
    """(block, ids, xs): up to `block` vectors of a task in each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, made = [], 0, TaskContext.get().partitionId() << 32

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, n, made
            if n < least:
                return
            whole = pa.Table.from_batches(waiting).combine_chunks()
            x = whole.column(1).combine_chunks().flatten().to_numpy().reshape(len(whole), -1)
            if len(x) and max(abs(int(x.min())), abs(int(x.max()))) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} in integers; exact distances would not fit 64 bits")
            end = len(x) // least * least if least > 1 else len(x)
            for s in range(0, end, block):
                part = x[s : min(s + block, end)]
                ids = whole.column(0).slice(s, len(part)).combine_chunks()
                yield pa.RecordBatch.from_pydict({"block": pa.array([made]), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "xs": [part.astype("<i4").tobytes()]})
                made += 1
            waiting, n = whole.slice(end).to_batches(), len(x) - end

        for b in batches:
            waiting.append(b)
            n += b.num_rows
            yield from rows(block)
        yield from rows(1)

    return kept.mapInArrow(cut, "block long, ids array<long>, xs binary")


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """df as a table of n buckets by `block`, in the shared folder; the name in the catalogue is its own and not kept."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").sortBy("block").option("path", new_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay where they are
    return table


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors: in double precision where no sum can pass 2^53, else in 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centers).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    x, c = x.astype(kind), centers.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller on ties; how much farther the second is, never too much)."""
    d = squared(x, centers)
    near = d.argmin(1)
    if len(centers) == 1:
        return near, np.full(len(x), np.inf)
    rows = np.arange(len(x))
    first = d[rows, near].copy()
    d[rows, near] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64))
    return near, second - np.sqrt(first.astype(np.float64)) - 1e-9 * (1 + second)


class Heaps:
    """The heaps of a block: for each cluster the gaps and places of its vectors, each in the order of a heap.

    A heap is unpacked when it is first popped from or pushed to; the others stay as they were stored.
    """

    def __init__(self, k: int, offsets: np.ndarray | None = None, places: np.ndarray | None = None, gaps: np.ndarray | None = None):
        self.k, self.places, self.gaps = k, places, gaps
        self.offsets = np.zeros(k + 1, np.int32) if offsets is None else offsets
        self.open: dict[int, list[tuple[float, int]]] = {}

    def heap(self, c: int) -> list[tuple[float, int]]:
        if c not in self.open:
            a, b = self.offsets[c], self.offsets[c + 1]
            self.open[c] = list(zip(self.gaps[a:b].tolist(), self.places[a:b].tolist(), strict=True)) if b > a else []
        return self.open[c]

    def expired(self, drift: np.ndarray) -> list[tuple[int, int]]:
        """Pop (place, cluster) of every gap that the cluster's drift has reached."""
        out = []
        filled = np.flatnonzero(self.offsets[1:] > self.offsets[:-1])
        tops = self.gaps[self.offsets[filled]]
        for c in filled[tops <= drift[filled]].tolist():
            heap, until = self.heap(c), drift[c]
            while heap and heap[0][0] <= until:
                out.append((heapq.heappop(heap)[1], c))
        return out

    def push(self, places: np.ndarray, clusters: np.ndarray, gaps: np.ndarray) -> None:
        for c in np.unique(clusters).tolist():
            mine, heap = clusters == c, self.heap(c)
            new = list(zip(gaps[mine].tolist(), places[mine].tolist(), strict=True))
            if len(new) > len(heap) // 8:
                heap += new
                heapq.heapify(heap)
            else:
                for entry in new:
                    heapq.heappush(heap, entry)

    def stored(self) -> tuple[bytes, bytes, bytes]:
        places, gaps = [], []
        for c in range(self.k):
            a, b = self.offsets[c], self.offsets[c + 1]
            mine = self.open.get(c)
            places.append(self.places[a:b] if mine is None and b > a else np.array([p for _, p in mine or []], np.int32))
            gaps.append(self.gaps[a:b] if mine is None and b > a else np.array([g for g, _ in mine or []], np.float64))
        offsets = np.cumsum([0, *map(len, places)]).astype(np.int32)
        return offsets.tobytes(), np.concatenate(places).astype(np.int32).tobytes(), np.concatenate(gaps).astype(np.float64).tobytes()


def _changes(x: np.ndarray, was: np.ndarray, now: np.ndarray) -> list[dict]:
    """What moved vectors add to each cluster's number and sum; was is -1 for vectors of no cluster yet."""
    moved = was != now
    out = {}
    for c in np.union1d(was[moved], now[moved]).tolist():
        if c >= 0:
            came, went = x[moved & (now == c)].astype(np.int64), x[moved & (was == c)].astype(np.int64)
            out[c] = {"cluster": c, "n": len(came) - len(went), "s": (came.sum(0) - went.sum(0)).tolist()}
    return list(out.values())


def _round(blocks: DataFrame, state: DataFrame | None, size: int, centers: np.ndarray, drift: np.ndarray, n: int) -> DataFrame:
    """The blocks' heaps after an assignment to `centers`, with what it changed."""
    k = len(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(j)[i].as_buffer() for j in range(1, batch.num_columns)]
                x = np.frombuffer(raw[0], "<i4").reshape(-1, size)
                if len(raw) == 1:  # nothing is assigned yet
                    heaps, popped = Heaps(k), [(p, -1) for p in range(len(x))]
                else:
                    heaps = Heaps(k, np.frombuffer(raw[1], np.int32), np.frombuffer(raw[2], np.int32), np.frombuffer(raw[3], np.float64))
                    popped = heaps.expired(drift)
                changes = []
                if popped:
                    places, was = (np.array(p, np.int64) for p in zip(*popped, strict=True))
                    now, gap = nearest(x[places], centers)
                    heaps.push(places, now, gap + drift[now])
                    changes = _changes(x[places], was, now)
                offsets, order, gaps = heaps.stored()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *(pa.array([v], pa.binary()) for v in (offsets, order, gaps)), pa.array([len(popped)], pa.int64()), pa.array([changes], _CHANGES)],
                    names=["block", "offsets", "places", "gaps", "scanned", "changes"],
                )

    held = blocks.select("block", "xs") if state is None else blocks.select("block", "xs").join(state.select("block", "offsets", "places", "gaps").hint("merge"), "block")
    return _bucketed(held.mapInArrow(run, STATE), n)


def _floor_means(state: DataFrame, numbers: list[int], sums: list[list[int]], centers: list[list[int]]) -> list[list[int]]:
    """Add a round's changes to the clusters' numbers and sums, and return the centroids; those without vectors stay."""
    changed = state.select(F.explode("changes").alias("c")).select("c.*")
    for r in changed.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        numbers[r["cluster"]] += r["n"]
    parts = changed.select("cluster", F.posexplode("s").alias("d", "v")).groupBy("cluster", "d").agg(F.sum("v").alias("v"))
    for r in parts.collect():  # clusters times components
        sums[r["cluster"]][r["d"]] += r["v"]
    return [[s // n for s in total] if n else old for n, total, old in zip(numbers, sums, centers, strict=True)]


def cluster(vectors: DataFrame, start: list[list[int]], rounds: int, size: int, block: int = BLOCK, log: list[int] | None = None) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), centroids) of vectors (vec_id, x) after `rounds` updates and one more assignment.

    Ties go to the smaller number. A centroid becomes the floor of its vectors' mean, exactly. Repeated rows count
    each; ids are only carried. `log` takes the number of vectors that each assignment compared with all
    centroids. Components beyond LARGEST are refused.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], schema), []
    n = partitions(spark)
    blocks = _bucketed(_blocks(vectors, block).repartition(n, "block"), n)
    centers, k = [list(c) for c in start], len(start)
    numbers, sums, drift = [0] * k, [[0] * size for _ in start], np.zeros(k)
    state = None
    for done in range(rounds + 1):
        state = _round(blocks, state, size, np.array(centers, np.int64), drift.copy(), n)
        if log is not None:
            log.append(state.agg(F.sum("scanned")).first()[0] or 0)
        if done == rounds:
            break
        moved = _floor_means(state, numbers, sums, centers)
        if moved == centers:
            break  # nothing will change any more
        way = np.sqrt(np.array([float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) for p, q in zip(moved, centers, strict=True)])) * (1 + 1e-12)
        others = np.array([max([0.0, *np.delete(way, c)]) for c in range(k)])
        drift, centers = drift + way + others, moved
    last = np.array(centers, np.int64)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), "<i4").reshape(-1, size)
                offsets, places = (np.frombuffer(batch.column(j)[i].as_buffer(), np.int32) for j in (3, 4))
                own = np.zeros(len(x), np.int32)
                own[places] = np.repeat(np.arange(k, dtype=np.int32), np.diff(offsets))
                away = x.astype(np.int64) - last[own]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(own), pa.array((away * away).sum(1))], names=["vec_id", "cluster", "distance"])

    both = blocks.join(state.select("block", "offsets", "places").hint("merge"), "block")
    return both.select("block", "ids", "xs", "offsets", "places").mapInArrow(result, schema), centers


def digest(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per kept vector its cluster, squared distance, the inertia of its cluster and of all, and the sha256 of its centroid.

    Vectors that are null, of another size or hold null or non-finite components are left out; so are other columns.
    """
    kept = whole_vectors(vectors, id_col, vec_col, size, scale)
    assigned, centers = cluster(kept, first_centroids(kept, k), rounds, size)
    assigned = materialize(assigned, "assigned")
    names: Column = F.element_at(F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centers] or [F.lit(None).cast("string")]), F.col("cluster") + 1)
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row for each cluster
    total = per.agg(F.sum("cluster_inertia").alias("s")).first().s
    per = F.broadcast(per.select("cluster", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), names.alias("centroid_sha256")))
    return assigned.join(per, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
