"""From all documents to packed sequences: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.llm import jaccard, langid, lines, mixing, packing
from photoflow.scratch import materialize

#: a prediction below this score names no language
MIN_SCORE = 0.3
#: words of a shingle and hundredths of shared shingles from which two documents are near copies
NEAR_WORDS, NEAR_PCT = 5, 80


def _inner(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that clash with nothing, and the new name of each."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return own, {c: f"c{i}" for i, c in enumerate(docs.columns)}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without any letter go."""
    own, c = _inner(docs)
    found = langid.identify(own, c["doc_id"], c["text"], c["lang"], keep=own.columns)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; each such line stays only where it comes first, and texts left empty go."""
    own, c = _inner(docs)
    left = lines.drop_boilerplate(own, id_col=c["doc_id"], text_col=c["text"], site_col=c["source"]).where("n_lines > n_dropped or n_dropped = 0")
    return left.withColumn(c["n_chars"], F.length(c["text"]).cast("long")).select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, that of the smallest id, and every other row.

    Copies share NEAR_PCT hundredths of their shingles of NEAR_WORDS words. Rows are told apart by a number
    of their own, so repeated ids are no copies, and of repeated rows one stays.
    """
    own, c = _inner(docs)
    rows = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = jaccard.components(rows, k=NEAR_WORDS, pct=NEAR_PCT, id_col="_row", text_col=c["text"]).select("_row", "component_id")
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    placed = materialize(found.join(groups, "component_id"), "rows-of-groups")
    order = F.struct(F.col(c["doc_id"]).isNull(), c["doc_id"], F.xxhash64(c["text"]), "_row")
    named = rows.select("_row", order.alias("at")).join(placed, "_row")
    first = named.groupBy("component_id").agg(F.min("at")["_row"].alias("_row"))
    copies = materialize(placed.select("_row").join(first, "_row", "left_anti"), "near-copies")
    return rows.join(copies.hint("merge"), "_row", "left_anti").select(*own.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its schedule."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: the classifier and the packing order are beyond SQL; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
