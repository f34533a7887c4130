"""Joins between images, documents, detections and colours."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from photoflow.functions import geometry as G
from photoflow.operators.detectors import Detectors, run_detector  # noqa: F401
from photoflow.operators.graph import running_total
from photoflow.scratch import materialize

#: the preferred form of a sidecar comes first
FORMATS = ["bin", "rkyv", "json"]


def join_sidecars(images: DataFrame, sidecars: DataFrame, key: str = "stem") -> DataFrame:
    """Every image with its sidecar of the preferred format, or none."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    best = sidecars.where(rank > 0).groupBy(key).agg(F.min(F.struct(rank.alias("r"), "path", "format")).alias("b"))
    return images.join(best.select(key, F.col("b.path").alias("sidecar"), F.col("b.format").alias("format")), key, "left")


def join_pattern_sidecars(images: DataFrame, sidecars: DataFrame, key: str = "stem") -> DataFrame:
    """Sidecars named `stem_suffix` with the image of that stem; together with direct ones, duplicates kept."""
    s = sidecars.where(F.col(key).contains("_")).withColumn(key, F.regexp_replace(key, "_[^_]*$", ""))
    return images.join(s, key)


def orphan_sidecars(sidecars: DataFrame, images: DataFrame, key: str = "stem", reference: bool = False) -> DataFrame:
    """Sidecars without an image; `reference` looks only for the stem before the last underscore."""
    short = sidecars.withColumn("_short", F.regexp_replace(key, "_[^_]*$", ""))
    known = images.select(F.col(key).alias("_known")).distinct()
    if not reference:
        short = short.join(known, F.col(key) == F.col("_known"), "left_anti")
    return short.join(known, F.col("_short") == F.col("_known"), "left_anti").drop("_short")


def needs_processing(images: DataFrame, operations: DataFrame, ops: list[str], key: str = "image", force: bool = False) -> DataFrame:
    """Images that lack a successful result of one of the operations."""
    if force:
        return images
    done = operations.where(F.col("op").isin(ops) & F.col("success")).groupBy(key).agg(F.countDistinct("op").alias("n")).where(F.col("n") == len(ops))
    return images.join(done, key, "left_anti")


def overlap_pairs(detections: DataFrame, threshold: float, group: str = "image", strict: bool = False) -> DataFrame:
    """(group, a, b, iou): pairs of boxes of one image, a before b, by their overlap."""
    side = lambda s: detections.select(group, *[F.col(c).alias(f"{s}_{c}") for c in ("ord", "x", "y", "w", "h")])
    box = lambda s: tuple(F.col(f"{s}_{c}") for c in ("x", "y", "w", "h"))
    pairs = side("a").join(side("b"), group).where("a_ord < b_ord").withColumn("iou", G.iou(box("a"), box("b")))
    return pairs.where(F.col("iou") > threshold if strict else F.col("iou") >= threshold).select(group, F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "iou")


def color_cell(axes: tuple[str, str, str], threshold: float) -> Column:
    """Cell of a colour in a grid whose cells are as wide as the threshold on all three axes."""
    return F.struct(*[F.floor(F.col(c) / (threshold * 100)).alias(f"c{k}") for k, c in enumerate(axes)])


def cells_around(axes: tuple[str, str, str], threshold: float) -> Column:
    """The 27 cells that can hold a colour nearer than the threshold."""
    at = [F.floor(F.col(c) / (threshold * 100)) for c in axes]
    return F.array(*[F.struct(*[(at[k] + d).alias(f"c{k}") for k, d in enumerate(ds)]) for ds in product((-1, 0, 1), repeat=3)])


def match_colors(colors: DataFrame, teams: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Distinct (photo, team): a colour of the photo is nearer than threshold to the team's.

    Colours within the threshold share or neighbour a cell of that size on all three axes, so the
    comparison is an equi-join on cells and not a product.
    """
    c = colors.select("photo", "l", "a", "b").withColumn("_cell", color_cell(("l", "a", "b"), threshold))
    t = teams.select("team", F.col("l").alias("tl"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    t = t.withColumn("_cell", F.explode(cells_around(("tl", "ta", "tb"), threshold)))
    d = F.sqrt((F.col("l") - F.col("tl")) ** 2 + (F.col("a") - F.col("ta")) ** 2 + (F.col("b") - F.col("tb")) ** 2) / 100
    return c.join(t, "_cell").where(d < threshold).select("photo", "team").distinct()


def number_frames(balls: DataFrame, by: str = "source") -> DataFrame:
    """balls with `frame`: 1, 2, ... for the different times of each source, counted over ranges of them."""
    times = running_total(balls.select(by, "ts").distinct().withColumn("_one", F.lit(1)), [by, "ts"], {"frame": "_one"}, "frames", within=[by])
    same = F.col(f"b.{by}").eqNullSafe(F.col(f"t.{by}")) & F.col("b.ts").eqNullSafe(F.col("t.ts"))
    return balls.alias("b").join(times.alias("t"), same).select("b.*", (F.col("t.frame") + 1).cast("int").alias("frame"))


def track_nearest(balls: DataFrame, max_move: float = 50, by: str = "source", row: str = "ball_id") -> DataFrame:
    """Each ball with the motion from the nearest ball of the frame before, if within max_move (the first on ties).

    Frames are numbered over ranges of times, and balls meet those of the frame before in their own and the
    neighbouring cells of a grid as wide as max_move, so neither a source nor a crowded frame is one task's work.
    Where ids repeat, `row` names a column that tells balls apart; prev_row is that of the ball before.
    """
    frame = number_frames(balls, by)
    cell = lambda c, step=0: (F.floor(F.col(c) / max_move) + step).alias(f"_{c}")
    around = F.array(*[F.struct(cell("cx", i), cell("cy", j)) for i, j in product((-1, 0, 1), repeat=2)])
    prev = frame.select(by, (F.col("frame") + 1).alias("frame"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("ball_id").alias("prev_id"), F.col(row).alias("prev_row"), F.explode(around).alias("_c"))
    prev = prev.select(by, "frame", "px", "py", "prev_id", "prev_row", "_c._cx", "_c._cy")
    dx, dy = F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    d = F.sqrt(dx * dx + dy * dy)  # hypot rounds otherwise, so equally near balls would not tie
    near = frame.select("*", cell("cx"), cell("cy")).join(prev, [by, "frame", "_cx", "_cy"]).withColumn("d", d).where(F.col("d") < max_move)
    other = [] if row == "ball_id" else ["prev_row"]
    motion = F.struct("prev_id", *other, (F.col("cx") - F.col("px")).alias("dx"), (F.col("cy") - F.col("py")).alias("dy"))
    best = near.groupBy(row).agg(F.min_by(motion, F.struct("d", "prev_id", *other)).alias("m"))
    return frame.join(best, row, "left").select(*frame.columns, *[f"m.{c}" for c in ("prev_id", *other, "dx", "dy")])


def inherit_types(tracked: DataFrame, by: str = "source", row: str = "ball_id") -> DataFrame:
    """Types handed down along tracks: tracked_type is the first known type on the way from a track's start to the ball.

    Every round joins each ball with what its pointer knows and doubles the pointers' reach, so a track of
    n balls takes log2 n joins and no source is gathered in one place. `row` is that of track_nearest.
    """
    known = F.when(F.col("ball_type") != "unknown", F.col("ball_type"))
    before = "prev_id" if row == "ball_id" else "prev_row"
    t = materialize(tracked.select(row, F.col(before).alias("ptr"), known.alias("kind")), "tracks")
    while not t.where("ptr is not null").isEmpty():
        back = t.select(F.col(row).alias("ptr"), F.col("ptr").alias("far"), F.col("kind").alias("before"))
        t = materialize(t.join(back, "ptr", "left").select(row, F.col("far").alias("ptr"), F.coalesce("before", "kind").alias("kind")), "tracks")
    return tracked.join(t.select(row, "kind"), row).withColumn("kind", F.coalesce("kind", "ball_type")).withColumnRenamed("kind", "tracked_type")


def speed(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def unified_results(faces: DataFrame, objects: DataFrame, key: str = "image") -> DataFrame:
    """Counts of faces and objects per image, success if either succeeded."""
    f = faces.groupBy(key).agg(F.max("success").alias("fs"), F.sum("n").alias("faces"))
    o = objects.groupBy(key).agg(F.max("success").alias("os"), F.sum("n").alias("objects"))
    both = f.join(o, key, "full")
    return both.select(key, F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("objects", F.lit(0)).alias("objects"), (F.coalesce("fs", F.lit(False)) | F.coalesce("os", F.lit(False))).alias("success"))


def merge_operations(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by keys: the row of the highest version stays, created_at of the first, last_updated of the last.

    Of rows of the same version an update stays rather than an existing row, and of several the one with the smallest hash.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys)
    hashed = F.xxhash64(*[F.to_json(F.col(c)) if isinstance(existing.schema[c].dataType, MapType) else F.col(c) for c in existing.columns])
    return (
        both.withColumn("_n", F.row_number().over(w.orderBy(F.desc("version"), F.desc("_new"), hashed)))
        .withColumn("created_at", F.min("version").over(w)).withColumn("last_updated", F.max("version").over(w))
        .where("_n = 1").drop("_n", "_new")
    )
