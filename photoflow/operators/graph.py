"""Connected components and ordered running totals, written for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photoflow.scratch import materialize, partitions


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that occurs in an edge.

    Alternating large-star and small-star rounds; each round is two aggregations with map-side
    combine, and its result is written to the shared folder. Self loops keep their node; null ends
    are ignored; repeated edges count once. An empty table gives an empty result.
    """
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    nodes = e.select("u").union(e.select("v")).distinct()
    links = e.where("u <> v")
    seen = None
    while True:
        links = materialize(_small_star(_large_star(links)), "star")
        # sum of (parent, child) hashes does not change once every node hangs on its root
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return nodes.alias("n").join(links.alias("l"), F.col("n.u") == F.col("l.u"), "left").select(
        F.col("n.u").alias("node"), F.coalesce("l.v", "n.u").alias("component")
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """e holds (u, v) with v < u."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def running_total(df: DataFrame, order: list[str], sums: dict[str, str], name: str = "ordered", within: list[str] | None = None) -> DataFrame:
    """Add, for each name -> column in `sums`, the sum of the column over all rows before this one in the given total order.

    Rows are range-partitioned by `order` (nulls first), so no task holds more than its range; each
    range is summed alone and the ranges' bases come from a prefix sum over one row per range. `within`
    (a prefix of `order`) restarts the totals for each of its values, also where one value fills many ranges.
    """
    within = within or []
    spark = df.sparkSession
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(partitions(spark), *by)
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), name)
    local = Window.partitionBy("_range", *within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    base = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and value of within: small beside the rows themselves
    totals = ranged.groupBy("_range", *within).agg(*[F.sum(c).alias(f"_{o}") for o, c in sums.items()])
    bases = totals.select("_range", *within, *[F.coalesce(F.sum(f"_{o}").over(base), F.lit(0)).alias(f"_base_{o}") for o in sums])
    keys = F.col("r._range") == F.col("b._range")
    for c in within:
        keys = keys & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    summed = ranged.withColumns({f"_local_{o}": F.coalesce(F.sum(c).over(local), F.lit(0)) for o, c in sums.items()})
    return summed.alias("r").join(bases.alias("b"), keys).select(
        *[F.col(f"r.{c}") for c in df.columns], *[(F.col(f"r._local_{o}") + F.col(f"b._base_{o}")).cast("long").alias(o) for o in sums]
    )
