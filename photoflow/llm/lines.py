"""Line dedup by the number of distinct sites that a line appears on.

A HyperLogLog sketch of the sites of every line's hash is merged by aggregation. Lines whose estimate is
near the threshold get an exact distinct count; those far above it are boilerplate, those far below stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.scratch import materialize

#: sites from which a line is boilerplate; share around it in which the sketch's estimate is not trusted
MIN_SITES, NEAR = 8, 0.25
LG_K = 10


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(site_col), F.lit("\u0000")).alias("site"), F.col(text_col).alias("t"))
    cut = own.select("id", "th", "site", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    return cut.select("id", "th", "site", "pos", F.trim("line").alias("line")).where("line <> ''").select("id", "th", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h): hashes of the trimmed lines that appear on at least min_sites sites; a null site is a site."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s")).select("h", F.hll_sketch_estimate("s").alias("sites"))
    spread = materialize(spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h")
    exact = lines.select("h", "site").join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("sites"))
    return spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("h").unionByName(exact.where(F.col("sites") >= min_sites).select("h"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines and n_dropped beside its columns.

    A boilerplate line stays where it comes first (smallest id, then place), so its content is kept once, and
    goes everywhere else. Blank lines are no lines; a null text stays null with 0 lines; null ids come last;
    repeated rows are treated alike. Columns of docs named n_lines or n_dropped are replaced.
    """
    flagged = materialize(boilerplate(docs, min_sites, id_col, text_col, site_col), "boilerplate")
    seen = materialize(_lines(docs, id_col, text_col, site_col).join(flagged, "h").select("h", "id", "th", "pos"), "boilerplate-places")
    # one row per boilerplate line, written so that the places of a very common one can be dealt over tasks
    first = materialize(seen.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "pos")).alias("first")), "first-places")
    later = seen.join(first, "h").where(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.th") == F.col("th")) & (F.col("first.pos") == F.col("pos"))))
    drops = materialize(later.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "drops")
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_th"), F.split(text_col, "\n", -1).alias("cut"))
    own = own.withColumn("n_lines", F.coalesce(F.size(F.filter("cut", lambda x: F.trim(x) != "")), F.lit(0)).cast("long"))
    # texts are shuffled at every size: the list of drops grows with them
    own = own.drop("cut").join(drops.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    text = F.col("doc")[text_col]
    cut = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone")), lambda i: F.get(cut, i))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return own.select(*[(left if c == text_col else F.col("doc")[c]).alias(c) for c in columns], "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
