"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (lengths 1 to 3, presence only) that both
hold, normalised to 1 for equal sets: a blended-spectrum presence kernel. Landmark texts span a Nyström
approximation of it, and one ridge regression per language is fitted in that space. Texts are scored in
batches: as the kernel is linear in the presence of n-grams, presence matrix times landmark matrix times
dual weights is one product with their product, which is kept. N-grams are compared by their code points,
of any script; those that no landmark holds count neither in the kernel nor in a text's length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from photoflow.llm.encoding import groups
from photoflow.scratch import materialize

#: bound of the labelled sample that is fitted on the driver: texts per language, and texts and characters
#: of all languages (more languages get fewer texts each, one at least)
PER_LANG, MAX_TEXTS, MAX_SAMPLE_CHARS = 250, 16_000, 20_000_000
#: landmarks per language, and of all languages
LANDMARKS_PER_LANG, MAX_LANDMARKS = 24, 1536
RIDGE = 1e-3
UNDETERMINED = "und"
#: texts, characters and cells of the presence matrix of a batch
BATCH_TEXTS, BATCH_CHARS, BATCH_CELLS = 128, 400_000, 6_000_000
#: code points of white space, and of all that is neither white space nor letter nor mark
SPACE, OTHER = 32, 1
_BITS = 21


@cache
def _points() -> np.ndarray:
    """What each code point counts as, plus 1."""
    out = np.full(0x110000, OTHER + 1, np.int64)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] in "LM":
            out[c] = c + 1
        elif ch.isspace():
            out[c] = SPACE + 1
    return out


def ngrams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3 the n-grams of all texts as integers, and the text of each. Every text counts as ended by white space."""
    low = [t.lower() for t in texts]
    points = _points()[np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")]
    text = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    two = points[:-1] << _BITS | points[1:]
    three = two[:-1] << _BITS | points[2:]
    return [(points, text), *((grams[text[n:] == text[:-n]], text[n:][text[n:] == text[:-n]]) for n, grams in ((1, two), (2, three)))]


class Columns:
    """The column of every n-gram that the landmarks hold: hash tables, the next for what collides in the one before."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        self.shift = np.uint64(64 - max(8, int(16 * max(1, len(grams)) - 1).bit_length()))
        rng, left = np.random.default_rng(5), np.arange(len(grams), dtype=np.int32)
        while len(left):
            factor = np.uint64(int(rng.integers(1 << 62, 1 << 63)) * 2 + 1)
            slots, first = np.unique(self._slot(grams[left], factor), return_index=True)
            table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
            table[slots] = left[first]
            self.tables.append((factor, table))
            left = np.delete(left, first)

    def _slot(self, grams: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (grams.view(np.uint64) * factor >> self.shift).astype(np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Column of each n-gram, -1 where there is none."""
        out = np.full(len(grams), -1, np.int32)
        left = np.arange(len(grams))
        for factor, table in self.tables:
            col = table[self._slot(grams[left], factor)]
            hit = (col >= 0) & (self.grams[col] == grams[left])
            out[left[hit]] = col[hit]
            left = left[~hit & (col >= 0)]
            if not len(left):
                break
        return out


@dataclass
class Model:
    columns: Columns
    weights: np.ndarray  # columns x languages
    langs: list[str]


def presence(texts: list[str], columns: Columns) -> np.ndarray:
    """Texts x columns, 1 where the text holds the n-gram."""
    out = np.zeros((len(texts), len(columns.grams)), np.float32)
    if len(texts) > 1:
        for grams, text in ngrams(texts):
            col = columns.of(grams)
            out[text[col >= 0], col[col >= 0]] = 1
        return out
    for t in texts:  # piece by piece, two characters of each before the next
        for s in range(0, max(1, len(t)), BATCH_CHARS):
            last = s + BATCH_CHARS >= len(t)
            for grams, _ in ngrams([t[max(0, s - 2) : s + BATCH_CHARS]]):
                col = columns.of(grams if last else grams[:-1])
                out[0, col[col >= 0]] = 1
    return out


def _unit(texts: list[str], columns: Columns) -> np.ndarray:
    p = presence(texts, columns)
    return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))


def batches_of(texts: list[str], columns: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts whose matrix and characters are bounded; a longer text comes alone."""
    most, s = max(1, min(BATCH_TEXTS, BATCH_CELLS // max(1, columns))), 0
    while s < len(texts):
        e, size = s, 0
        while e < len(texts) and e - s < most and (e == s or size + len(texts[e]) <= BATCH_CHARS):
            size += len(texts[e])
            e += 1
        yield s, e
        s = e


def landmarks_of(sample: pd.DataFrame) -> list[str]:
    each = max(1, min(LANDMARKS_PER_LANG, MAX_LANDMARKS // max(1, sample["lang"].nunique())))
    return list(sample.groupby("lang", sort=True).head(each)["text"])


def fit(sample: pd.DataFrame) -> Model:
    """sample: text, lang; texts hold a letter. Deterministic: rows are taken in the given order."""
    langs, texts, marks = sorted(sample["lang"].unique()), list(sample["text"]), landmarks_of(sample)
    held = [np.unique(np.concatenate([g for g, _ in ngrams([t])])) for t in marks]
    columns = Columns(np.unique(np.concatenate(held)))
    p = np.concatenate([_unit(marks[s:e], columns) for s, e in batches_of(marks, len(columns.grams))])
    w, v = np.linalg.eigh((p @ p.T).astype(np.float64))
    keep = w > 1e-6 * w.max()
    root = v[:, keep] / np.sqrt(w[keep])
    phi = np.concatenate([(_unit(texts[s:e], columns) @ p.T).astype(np.float64) @ root for s, e in batches_of(texts, len(columns.grams))])
    target = np.where(sample["lang"].to_numpy()[:, None] == np.array(langs)[None], 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + RIDGE * len(sample) * np.eye(phi.shape[1]), phi.T @ target)
    return Model(columns, (p.T @ (root @ beta).astype(np.float32)).astype(np.float32), langs)


def decision(texts: list[str], m: Model) -> np.ndarray:
    """Texts x languages: the value of each regression."""
    return _unit(texts, m.columns) @ m.weights


def predict(texts: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score in 0 to 1) of each text; ties to the language first in order."""
    f = decision(texts, m)
    e = np.exp(4 * (f - f.max(1, keepdims=True)))
    return f.argmax(1), (e / e.sum(1, keepdims=True)).max(1).astype(np.float64)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> pd.DataFrame:
    """About PER_LANG texts of every language, by a hash of the id and text; only rows outside the held-out part.

    Bounded as documented above before anything reaches the driver, whatever the size of docs: a language's
    shorter texts are taken first until its share of the characters is used; where its shortest text exceeds
    that share, only so much of it is fitted.
    """
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    t = t.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = materialize(t.groupBy("lang").agg(F.count("*").alias("of")), "texts-of-languages")
    langs = max(1, counts.count())
    counts = F.broadcast(counts) if langs <= MAX_TEXTS else counts
    each, chars = max(1, min(PER_LANG, MAX_TEXTS // langs)), max(1, MAX_SAMPLE_CHARS // langs)
    t = t.withColumn("h", F.xxhash64("id", "text")).withColumn("n", F.length("text"))
    # twice as many as needed by their hash, then exactly so many; repeated rows count once
    picked = t.join(counts, "lang").where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < F.lit(2.0 * each) / F.col("of"))
    picked = picked.select("lang", "h", "n", F.substring("text", 1, chars).alias("text")).dropDuplicates(["lang", "h"])
    by = Window.partitionBy("lang")
    picked = picked.withColumn("place", F.row_number().over(by.orderBy("h"))).where(F.col("place") <= each)
    short = by.orderBy("n", "h")
    picked = picked.withColumn("upto", F.sum("n").over(short.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.row_number().over(short) == 1)
    rows = picked.where((F.col("upto") <= chars) | F.col("first")).select("text", "lang", "h").toPandas()
    return rows.sort_values(["h", "lang"])[["text", "lang"]].reset_index(drop=True)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs' `keep` columns (the id by default), held_out, lang_pred and score for every input row.

    A null text and one without any letter are `und` with score 0; so is everything when no labelled text
    exists. The label, source and id are never inputs of a prediction. A null id is not held out. Kept
    columns named held_out, lang_pred or score are replaced.
    """
    keep = [c for c in keep or [id_col] if c not in ("held_out", "lang_pred", "score")]
    sample = labelled_sample(docs, id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample) if len(sample) else None)
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], held_out(F.col(id_col)).alias("held_out"))
    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    carried = text_col in keep
    at = keep.index(text_col) if carried else len(keep) + 1
    if not carried:
        own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for first, texts in groups(b.column(at), 4 * BATCH_CHARS):
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                ok = [k for k, t in enumerate(texts) if t and m and any(map(str.isalpha, t))]
                known = [texts[k] for k in ok]
                for s, e in batches_of(known, len(m.columns.grams) if m else 0):
                    best, score = predict(known[s:e], m)
                    for k, lang, x in zip(ok[s:e], best, score, strict=True):
                        names[k], scores[k] = m.langs[lang], float(x)
                kept = b.slice(first, len(texts)).columns[: len(keep) + 1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    out = own.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "held_out", "lang_pred", "score")
