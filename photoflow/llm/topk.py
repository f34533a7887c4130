"""Exact top-k inner products over norm-sorted blocks.

Candidates are numbered by descending length and dealt into blocks of equal size. The longest block gives
every query a first k-th score. The others follow in waves of rising size, each with the scores of all
before it: a block is read for a block of queries only if length times length can reach some query's
score (Cauchy-Schwarz), and the search ends with the first wave that needs no block. Within a block, vectors are rotated by the singular
vectors of a bounded sample, the products over the first axes are summed, and what the rest can add is
bounded by the product of the residual lengths; only pairs that can still reach the k-th score are
multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.operators.graph import running_total
from photoflow.scratch import materialize, partitions

#: vectors of a candidate block and of a query block; rows of the sample that the rotation is fitted on
BLOCK, QUERIES, SAMPLE = 1024, 512, 4096
#: length of the longest vector: no inner product of two such, nor any part of its sum, passes 2^63
LONGEST = 3.03e9
#: candidate blocks from one wave's start to the next one's, as a factor
WAVE = 8
#: share of the axes that is summed before a pair may be given up
FIRST_AXES = 0.5


def integers(docs: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x, dim, norm): x is floor(scale * component); rows with a null or non-finite component are left out, vectors beyond LONGEST refused."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    t = docs.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    t = t.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    t = t.select("id", "x", F.size("x").alias("dim"), norm.alias("norm"))
    refused = F.raise_error(F.lit(f"a vector is longer than {LONGEST:.0f} in integers; its inner products would not fit 64 bits")).cast("double")
    return t.withColumn("norm", F.when(F.col("norm") <= LONGEST, F.col("norm")).otherwise(refused))


def _rotations(t: DataFrame) -> dict[int, np.ndarray]:
    """Singular vectors, largest first, for the most frequent lengths of vectors in a bounded sample; others stay as they are."""
    rows = t.select("x", "dim").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    out = {}
    for d in {r.dim for r in rows if r.dim}:
        x = np.array([r.x for r in rows if r.dim == d], np.float64)
        out[d] = np.linalg.svd(x, full_matrices=True)[2].T
    return out


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: ids, lengths, thresholds and the matrix, as bytes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("norm", "descending"), ("id", "ascending")])
        flat = table.column("x").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        cols = {k: [table.column(k)[0].as_py()] for k in keys}
        for name in ("id", "norm", "least"):
            cols[name] = [table.column(name).to_numpy().tobytes()]
        return pa.table(cols | {"x": [flat.flatten().to_numpy().astype("<i8").tobytes()]}, schema=pa.schema([(k, pa.int64()) for k in keys] + [(c, pa.binary()) for c in ("id", "norm", "least", "x")]))

    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} long" for k in keys) + ", id binary, norm binary, least binary, x binary")


def _best(q: tuple, c: tuple, d: int, k: int, turn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one query block and one candidate block, up to k (query, candidate, score) per query that can reach its threshold."""
    (qid, qnorm, least, qx), (cid, cnorm, _, cx) = q, c
    qx, cx = qx.reshape(len(qid), d), cx.reshape(len(cid), d)
    alive = np.flatnonzero(cnorm * qnorm.max(initial=0) * (1 + 1e-9) >= least.min(initial=0))
    cid, cnorm, cx = cid[alive], cnorm[alive], cx[alive]
    if not len(cid) or not len(qid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = max(1, np.abs(qx).max(initial=0)) * max(1, np.abs(cx).max(initial=0)) * max(1, d) < 1 << 53
    qf, cf = qx.astype(np.float64), cx.astype(np.float64)
    may = np.ones((len(qid), len(cid)), bool)
    if turn is not None and np.isfinite(least).any():
        n = max(1, int(d * FIRST_AXES))
        qr, cr = qf @ turn, cf @ turn
        bound = qr[:, :n] @ cr[:, :n].T + np.linalg.norm(qr[:, n:], axis=1)[:, None] * np.linalg.norm(cr[:, n:], axis=1)[None]
        may = bound >= least[:, None] - 1e-6 * (1 + qnorm[:, None] * cnorm[None])
    may &= qid[:, None] != cid[None]
    qi, ci = np.nonzero(may)
    if exact and len(qi) * 4 > may.size:
        score = (qf @ cf.T).astype(np.int64)[qi, ci]
    else:
        score = np.concatenate([np.einsum("ij,ij->i", qx[qi[s : s + 65536]], cx[ci[s : s + 65536]]) for s in range(0, len(qi), 65536)] or [np.zeros(0, np.int64)])
    ok = score >= least[qi]
    qi, ci, score = qi[ok], ci[ok], score[ok]
    order = np.lexsort((cid[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    starts = np.flatnonzero(np.append(True, qi[1:] != qi[:-1])) if len(qi) else np.zeros(0, np.int64)
    rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.append(starts, len(qi))))
    top = rank < k
    return qid[qi[top]], cid[ci[top]], score[top]


def _scored(pairs: DataFrame, k: int, turns: dict[int, np.ndarray]) -> DataFrame:
    """pairs holds a query block (q_*) and a candidate block (c_*) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.float64, np.float64, np.int64)
        for b in batches:
            for row in range(b.num_rows):
                at = lambda side: tuple(np.frombuffer(b.column(f"{side}_{n}")[row].as_buffer(), t) for n, t in zip(("id", "norm", "least", "x"), kinds, strict=True))  # noqa: E731, B023
                d = b.column("dim")[row].as_py()
                got = _best(at("q"), at("c"), d, k, turns.get(d))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or hold a null or non-finite component take
    no part, nor do rows without an id; vectors of different lengths are never compared. A row with the
    query's own id is no candidate; repeated rows are candidates each, repeated queries count once. All
    candidates are returned where there are fewer than k.
    """
    t = integers(vectors, id_col, vec_col, scale).withColumn("_down", -F.col("norm")).withColumn("_one", F.lit(1))
    t = materialize(running_total(t, ["dim", "_down", "id"], {"pos": "_one"}, "by-length", within=["dim"]), "numbered")
    turns = _rotations(t)
    never = F.lit(float("-inf"))
    cands = t.select(F.col("dim").cast("long").alias("dim"), F.floor(F.col("pos") / BLOCK).alias("cb"), "id", "norm", never.alias("least"), "x")
    cblocks = materialize(_packed(cands, ["dim", "cb"]).select("dim", "cb", *[F.col(c).alias(f"c_{c}") for c in ("id", "norm", "least", "x")]), "candidate-blocks")
    longest = cands.groupBy("dim", "cb").agg(F.max("norm").alias("long"))
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("_q")).where("_q").select("id").distinct()
    queries = t.join(asked, "id", "left_semi").dropDuplicates(["id"]).withColumn("_one", F.lit(1)).drop("pos")
    queries = running_total(queries, ["dim", "_down", "id"], {"pos": "_one"}, "queries", within=["dim"])
    queries = materialize(queries.select(F.col("dim").cast("long").alias("dim"), F.floor(F.col("pos") / QUERIES).alias("qb"), "id", "norm", "x"), "query-rows")

    def blocks(q: DataFrame) -> DataFrame:
        return _packed(q, ["dim", "qb"]).select("dim", "qb", *[F.col(c).alias(f"q_{c}") for c in ("id", "norm", "least", "x")])

    def scored(plan: DataFrame, q: DataFrame) -> DataFrame:
        # blocks of queries travel to the candidates' partitions, a block of candidates moves once
        sent = plan.join(blocks(q), ["dim", "qb"]).repartition(partitions(t.sparkSession), "dim", "qb", "cb")
        return _scored(sent.join(cblocks, ["dim", "cb"]), k, turns)

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    everyone = queries.select("dim", "qb").distinct().withColumn("cb", F.lit(0).cast("long"))
    best = materialize(top(scored(everyone, queries.withColumn("least", never))), "best")
    last = longest.agg(F.max("cb")).first()[0] or 0
    start = 1
    while start <= last:
        least = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(never).alias("least"))
        q = queries.join(least, F.col("id") == F.col("query_id"), "left").select("dim", "qb", "id", "norm", "x", F.coalesce("least", never).alias("least"))
        q = materialize(q, "queries-with-thresholds")
        # a block of queries reads a block of candidates only if its longest vector can reach a threshold
        need = F.min(F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).otherwise(F.when(F.col("least") > 0, float("inf")).otherwise(never)))
        wave = longest.where(F.col("cb").between(start, start * WAVE - 1))
        plan = q.groupBy("dim", "qb").agg(need.alias("need")).join(wave, "dim").where(F.col("long") * (1 + 1e-9) >= F.col("need"))
        plan = materialize(plan.select("dim", "qb", "cb"), "wave")
        if plan.isEmpty():  # all later blocks are shorter still
            break
        best = materialize(top(scored(plan, q).unionByName(best.drop("rank"))), "best")
        start *= WAVE
    return best
