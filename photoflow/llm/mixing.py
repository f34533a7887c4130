"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in an order shuffled by hash, form a stream of words that is cut into blocks
of equal size. Slot i of the schedule takes the source under the golden-ratio point frac(i * phi) on
the line of cumulative weights; its rank among its source's slots tells which block it reads, and a
source that is repeated starts again at its first block. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.operators.graph import running_total
from photoflow.scratch import materialize, partitions

#: points have BITS bits; PHI is the golden ratio's fraction of them, odd, so that no point comes twice within 2^BITS slots
BITS = 40
PHI = int(0.6180339887498949 * (1 << BITS)) | 1
#: slots that are ranked together; their counts per source are carried on as prefix sums
CHUNK = 1 << 13


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\x09-\\x0D]++")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """sizes (source, source_size) -> (sid, source, source_size, weight, target).

    Sources by code point, null last, take the weights in turn; targets share the total of all sizes and
    stop at `repeats` times their source, the excess shared again by weight (filling to a common level).
    An empty source has target 0.
    """
    last = sizes.withColumn("_null", F.col("source").isNull().cast("int"))
    s = running_total(last.withColumn("_one", F.lit(1)), ["_null", "source"], {"sid": "_one"}, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = s.select("sid", "source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("_cap"))
    s = s.withColumn("_level", F.col("_cap") / F.col("weight"))
    s = running_total(s, ["_level", "sid"], {"_caps": "_cap", "_used": "weight"}, "levels")
    whole = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    level = (F.lit(whole["t"]) - F.col("_caps")) / (F.lit(whole["w"]) - F.col("_used")).cast("double")
    fit = s.withColumn("_fit", level).where("_fit <= _level").agg(F.min_by("_fit", F.struct("_level", "sid"))).first()[0]
    target = F.col("_cap").cast("double") if fit is None else F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(fit))
    return s.select("sid", "source", "source_size", "weight", target.alias("target"))


def point(slot: Column) -> Column:
    """slot * PHI modulo 2^BITS, exact for slots below 2^42: no product passes 63 bits."""
    half = 1 << 20
    high = PHI * half % (1 << BITS)
    return ((slot % half) * F.lit(PHI) + F.floor(slot / half) * F.lit(high)) % (1 << BITS)


def schedule(quota: DataFrame) -> DataFrame:
    """quota (sid, q) -> (sid, rank, slot): q slots of each source, ranked from 0, spread evenly over the whole.

    Points past a source's quota are passed over; where the points leave a source short, the rest of its
    slots follow at the end (a few per source, as the points' discrepancy is logarithmic).
    """
    spark = quota.sparkSession
    q = running_total(quota.where("q > 0"), ["sid"], {"lo": "q"}, "quota")
    total, n = q.agg(F.coalesce(F.sum("q"), F.lit(0)), F.count("*")).first()
    cells = 1 << (4 * n + 1).bit_length()
    cell = lambda c: F.floor(c / F.lit(float(max(total, 1))) * cells)
    spans = q.withColumn("hi", F.col("lo") + F.col("q")).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(cells - 1)))))
    points = spark.range(total).select(F.col("id").alias("slot"), (point(F.col("id")) / (1 << BITS) * total).alias("_at")).withColumn("cell", F.least(cell(F.col("_at")), F.lit(cells - 1)))
    slots = points.join(spans, "cell").where("_at >= lo and _at < hi").select("sid", "q", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = slots.groupBy("sid", "chunk").agg(F.count("*").alias("c"))
    bases = running_total(counts, ["sid", "chunk"], {"base": "c"}, "slots-before", within=["sid"]).select("sid", "chunk", "base")
    ranked = slots.withColumn("_n", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))).join(bases, ["sid", "chunk"])
    ranked = ranked.select("sid", "q", (F.col("base") + F.col("_n") - 1).alias("rank"), "slot").where("rank < q").select("sid", "rank", "slot")
    have = q.join(counts.groupBy("sid").agg(F.sum("c").alias("c")), "sid", "left").select("sid", "q", F.coalesce("c", F.lit(0)).alias("c"))
    rest = have.where("c < q").select("sid", F.explode(F.sequence("c", F.col("q") - 1)).alias("rank")).withColumn("slot", F.lit(total) + F.col("rank"))
    return ranked.unionByName(rest)


def repeated(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs as the mix takes them, in the order of the schedule: range by range, every row where its first slot is.

    A row comes once for each pass over its source that takes half or more of it. Passes are whole but for
    one, which ends within a single document, so a source's words differ from its target by half of one
    of its documents at most. Rows of the same id and text are taken alike. Rows without words are not
    taken; an empty table stays empty. All columns of docs are kept, whatever their names.
    """
    out, cut = mix(docs, seed=seed, id_col=id_col, text_col=text_col, **kw)
    own = cut.groupBy("row", "pass").agg(F.min("slot").alias("slot"), F.sum(F.col("end") - F.col("first")).alias("got"))
    own = own.join(out.select("row", F.col(id_col).alias("id"), "text_hash", "size"), "row").where(F.col("got") * 2 >= F.col("size"))
    own = own.groupBy("row", "id", "text_hash").agg(F.collect_list("slot").alias("slots"))
    own = materialize(own.groupBy("id", "text_hash").agg(F.max_by("slots", F.struct(F.size("slots"), "row")).alias("slots")), "slots-of-documents")
    all_docs = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(F.lit(seed), id_col, text_col).alias("own_hash"))
    joined = all_docs.join(own, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))).select(F.explode("slots").alias("slot"), "doc")
    # slots fill their range evenly (but for the few at its end), so ranges of them need no sample
    n, slots = partitions(docs.sparkSession), max(1, cut.agg(F.approx_count_distinct("slot")).first()[0])
    part = F.least(F.floor(F.col("slot") / F.lit(slots) * n), F.lit(n - 1)).cast("int")
    ordered = joined.repartitionById(n, part).sortWithinPartitions("slot")
    return ordered.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, slices): what the mix takes of every document, and the scheduled slices themselves.

    documents: one row per input row with id, size, source, source_size, weight, target and taken (words
    that the mix takes, repeats counted; whole passes over a source and one part of a pass make up its
    target, rounded down). slices: slot, row, pass over its source, first and last word (end exclusive) in
    the order of the mix.
    Blocks hold half a mean document. A null text has size 0 and is never taken; a null source is a
    source; an empty table gives empty results. Other columns are ignored.
    """
    light = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("_h"),
    )
    light = materialize(light, "sizes")
    total, n = light.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = max(1, total // max(1, 2 * n))
    sources = materialize(source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets")
    named = light.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.row", "d.id", "d._h", "d.size", "s.*")
    placed = running_total(named.select("sid", "_h", "id", "row", "size", "source_size"), ["sid", "_h", "id", "row"], {"pos": "size"}, "streams", within=["sid"])
    # a source's target as whole passes over its blocks and one part of a pass
    plan = sources.where("source_size > 0").select(
        "sid", F.ceil(F.col("source_size") / block).alias("blocks"), F.floor(F.col("target")).alias("t"), "source_size",
    ).withColumn("rest", F.col("t") % F.col("source_size")).withColumn("passes", F.floor(F.col("t") / F.col("source_size")))
    plan = plan.withColumn("q", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    slots = schedule(plan.select("sid", "q")).join(plan.select("sid", "blocks", "passes", "rest"), "sid")
    number = F.col("rank") % F.col("blocks")
    upto = F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - number * block))
    slots = slots.select("sid", "slot", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), number.alias("block"), upto.alias("upto"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor((F.col("pos") + F.col("size") - 1) / block))))
    at = F.col("block") * block
    cut = pieces.join(slots, ["sid", "block"]).select(
        "slot", "row", "pass", F.greatest(at - F.col("pos"), F.lit(0)).alias("first"), F.least(at + F.col("upto") - F.col("pos"), F.col("size")).alias("end"),
    ).where("end > first")
    cut = materialize(cut, "slices")
    taken = cut.groupBy("row").agg(F.sum(F.col("end") - F.col("first")).alias("taken"))
    out = named.join(taken, "row", "left").select("row", F.col("_h").alias("text_hash"), F.col("id").alias(id_col), "size", "source", "source_size", "weight", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, cut
