"""Packing in the order of a space-filling curve.

Token counts of a document, hashed and projected at random to three dimensions, give a point; its
Hilbert key orders the documents, so neighbours on the curve share their tokens. The stream of
documents along the curve is cut into sequences at their full length, and what remains at its end into
sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.llm.encoding import encoder, groups
from photoflow.operators.graph import running_total
from photoflow.scratch import materialize

DIMS, BITS, FEATURES, SEED = 3, 10, 1024, 17


def projection(vocabulary: int) -> np.ndarray:
    """Row t: where one token t moves its document; feature hashing with signs, then a Gaussian projection."""
    rng = np.random.default_rng(SEED)
    feature, sign = rng.integers(0, FEATURES, vocabulary), rng.choice([-1.0, 1.0], vocabulary)
    return (rng.standard_normal((FEATURES, DIMS))[feature] * sign[:, None]).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of integer points (n, d) along the Hilbert curve of d dimensions (Skilling's transpose form)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, special_as_text: bool = False) -> DataFrame:
    """(row, id, n, key, ids): row is unique, n counts the end id, ids are little-endian integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text)
        end = np.array([end_id], enc.dtype).tobytes()
        to = projection(max(enc.tok.get_vocab_size(), end_id + 1))
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            doc = b.column(0)
            for at, texts in groups(b.column(1)):
                ids = [x + end for x in enc.encode(texts)]
                flat = np.frombuffer(b"".join(ids), enc.dtype)
                n = np.array([len(x) // len(end) for x in ids])
                starts = np.cumsum(n) - n
                points = np.empty((len(n), DIMS))
                for k in range(DIMS):
                    points[:, k] = np.add.reduceat(to[flat, k], starts) / n
                cells = np.clip(((np.tanh(points * 4) + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(n))), doc.slice(at, len(n)), pa.array(n), pa.array(hilbert_keys(cells)), pa.array(ids, pa.binary())], names=["row", "id", "n", "key", "ids"]
                )
                row += len(n)

    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return t.mapInArrow(encode, "row long, id long, n long, key long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids as binary
    with `with_ids`). A null or empty text is one end id. Rows with equal keys are ordered by id;
    repeated rows are packed each. Other columns are ignored; an empty table gives no piece. The string of
    a special token becomes its id, as in the library, unless special_as_text.
    """
    t = materialize(tokenized(docs, tokenizer, end_id, id_col, text_col, special_as_text), "tokens")
    placed = running_total(t.select("key", "id", "row", "n"), ["key", "id", "row"], {"at": "n"}, "curve")
    total = t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the tail as powers of two needs no padding
    edges, rest = [total - total % length], total % length
    while rest:
        edges.append(edges[-1] + (1 << (rest.bit_length() - 1)))
        rest -= edges[-1] - edges[-2]
    tail = np.array(edges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        for whole in batches:
            for at_row in range(0, whole.num_rows, 1000):
                b = whole.slice(at_row, 1000)
                out = {k: [] for k in names}
                for doc, at, n, ids in zip(*(b.column(c).to_pylist() for c in ("id", "at", "n", "ids")), strict=True):
                    flat = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                    p, end = at, at + n
                    while p < end:
                        if p < tail[0]:
                            seq, first = divmod(p, length)
                            upto = min(end, (seq + 1) * length)
                        else:
                            k = int(np.searchsorted(tail, p, "right")) - 1
                            seq, first, upto = int(tail[0]) // length + k, p - int(tail[k]), min(end, int(tail[k + 1]))
                        piece = flat[p - at : upto - at].tobytes()
                        for name, v in zip(names, (doc, p - at, upto - p, zlib.crc32(piece), n, seq, first, piece), strict=False):
                            out[name].append(v)
                        p = upto
                kinds = {"ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=names)

    joined = t.select("row", "id", "n", "ids").join(placed.select("row", "at"), "row").select("id", "at", "n", "ids")
    made = joined.mapInArrow(cut, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    return made.withColumnRenamed("id", id_col)
