"""Filters, checks, samples and set operations over photo records, with the columns and limits as arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.functions.documents import detection_count, parsed, tool_name
from photoflow.functions.quality import grade

#: (name, what must hold) of a document; the first that does not hold names the verdict
Rules = list[tuple[str, Column]]


def filter_faces(faces: DataFrame, confidence: float = 0.5, size: float = 64) -> DataFrame:
    """Faces of at least `size` pixels in width and height and of at least the confidence; nulls do not pass."""
    return faces.where((F.col("w") >= size) & (F.col("h") >= size) & (F.col("confidence") >= confidence))


def enforce_face_bounds(faces: DataFrame, images: DataFrame | None = None, min_faces: int = 1, max_faces: int | None = None, by: str = "image", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(faces kept, failures): of each image with min_faces faces the max_faces surest, ties in order.

    An image with fewer fails with a message; `images` adds those without any face.
    """
    counted = faces.withColumn("_found", F.count("*").over(Window.partitionBy(by)))
    kept = counted.where(F.col("_found") >= min_faces)
    if max_faces is not None:
        surest = Window.partitionBy(by).orderBy(F.desc("confidence"), order)
        kept = kept.withColumn("_place", F.row_number().over(surest)).where(F.col("_place") <= max_faces).drop("_place")
    found = faces.groupBy(by).agg(F.count("*").alias("_found"))
    if images is not None:
        found = images.select(by).distinct().join(found, by, "left").withColumn("_found", F.coalesce("_found", F.lit(0)))
    error = F.concat(F.lit("Not enough faces detected (found "), F.col("_found").cast("string"), F.lit(f", required {min_faces})"))
    return kept.drop("_found"), found.where(F.col("_found") < min_faces).select(by, F.lit(False).alias("success"), error.alias("error"))


def filter_classes(detections: DataFrame, classes: list[str], column: str = "class") -> DataFrame:
    """Detections of the classes, whatever their case."""
    return detections.where(F.lower(column).isin([c.lower() for c in classes]))


def filter_quality(scores: DataFrame, low: float | None = None, high: float | None = None, column: str = "score") -> DataFrame:
    """Successful rows whose score lies within the given ends; a missing end is open."""
    ok = F.col("success")
    ok = ok if low is None else ok & (F.col(column) >= low)
    return scores.where(ok if high is None else ok & (F.col(column) <= high))


def low_quality(scores: DataFrame, below: float = 0.5, column: str = "score") -> DataFrame:
    return scores.where(F.col("success") & (F.col(column) < below))


def write_by_grade(scores: DataFrame, path: str, column: str = "score") -> None:
    """One folder of Parquet files per grade."""
    scores.withColumn("grade", grade(F.col(column))).write.mode("overwrite").partitionBy("grade").parquet(path)


def filter_size(objects: DataFrame, low: float = 32, high: float | None = None) -> DataFrame:
    """Objects whose width and height lie within the ends."""
    ok = (F.col("w") >= low) & (F.col("h") >= low)
    return objects.where(ok if high is None else ok & (F.col("w") <= high) & (F.col("h") <= high))


def filter_image_size(images: DataFrame, width: str = "width", height: str = "height", low: float = 100, high: float = 8000, high_width: float | None = None) -> DataFrame:
    """Images whose sides lie within the ends; high_width is an end of the width of its own."""
    return images.where(F.col(width).between(low, high if high_width is None else high_width) & F.col(height).between(low, high))


def missing_encodings(faces: DataFrame, by: str = "image") -> DataFrame:
    """(image, missing): images with faces (item as JSON) that lack an encoding."""
    return faces.where(F.get_json_object("item", "$.encoding").isNull()).groupBy(by).agg(F.count("*").alias("missing"))


def first_failure(rules: Rules, otherwise: str = "valid") -> Column:
    """Name of the first rule that does not hold (or is null), else `otherwise`."""
    verdict = F.lit(otherwise)
    for name, ok in reversed(rules):
        verdict = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(verdict)
    return verdict


def validate_documents(documents: DataFrame, rules: Rules = (), doc: str = "doc") -> DataFrame:
    """documents with verdict (invalid where it is no JSON, else the first failing rule, else valid), size, n_detections and tool."""
    checked = [("invalid", parsed(F.col(doc)).isNotNull()), *rules]
    return documents.withColumns({"verdict": first_failure(checked), "size": F.octet_length(doc), "n_detections": detection_count(F.col(doc)), "tool": tool_name(F.col(doc))})


def validate_results(results: DataFrame, data: str = "data", rules: Rules = ()) -> DataFrame:
    """results with verdict: success without data is invalid, then the first failing rule, else ok."""
    return results.withColumn("verdict", first_failure([("success without data", ~F.coalesce(F.col("success"), F.lit(False)) | F.col(data).isNotNull()), *rules], "ok"))


def join_poses(images: DataFrame, poses: DataFrame, key: str = "image") -> DataFrame:
    """images with the number of their poses."""
    n = poses.groupBy(key).agg(F.count("*").alias("poses"))
    return images.join(n, key, "left").withColumn("poses", F.coalesce("poses", F.lit(0)))


def images_without_poses(images: DataFrame, poses: DataFrame, key: str = "image") -> DataFrame:
    return images.join(poses.select(key), key, "left_anti")


def image_for_legacy_json(documents: DataFrame, images: DataFrame, stem: str = "stem") -> DataFrame:
    """documents with `image`: the stem and extension of the image of their name, first by extension; null without one. Case does not count."""
    best = images.select(F.lower(stem).alias("_stem"), "ext").groupBy("_stem").agg(F.min("ext").alias("_ext"))
    joined = documents.join(best, F.lower(stem) == F.col("_stem"), "left")
    return joined.withColumn("image", F.when(F.col("_ext").isNotNull(), F.concat_ws(".", "_stem", "_ext"))).drop("_stem", "_ext")


def top_n(counts: DataFrame, n: int, value: str, name: str, rest: bool = False) -> DataFrame:
    """(name, value) of the n highest values, ties by name; with `rest` a last row "k more" sums what is beyond them."""
    top = counts.select(F.col(name).cast("string").alias(name), value).orderBy(F.desc(value), name).limit(n)
    if not rest:
        return top
    beyond = counts.agg(F.count("*").alias("_k"), F.sum(value).alias("_s"))
    own = top.agg(F.count("*").alias("_n"), F.coalesce(F.sum(value), F.lit(0)).alias("_t"))
    more = beyond.join(F.broadcast(own)).where("_k > _n").select(F.concat((F.col("_k") - F.col("_n")).cast("string"), F.lit(" more")).alias(name), (F.col("_s") - F.col("_t")).alias(value))
    return top.unionByName(more)


def sample_images(images: DataFrame, n: int, key: str = "image") -> DataFrame:
    """n images in an order shuffled by their hash; the same ones at every run."""
    return images.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def limit_images(images: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n images in the given order."""
    return images.orderBy(*order).limit(n)


def union_catalogs(*catalogs: DataFrame, key: str = "path") -> DataFrame:
    """Distinct paths of several catalogues."""
    return reduce(DataFrame.unionByName, [c.select(key) for c in catalogs]).distinct()


def union_detections(detections: dict[str, DataFrame], column: str = "method") -> DataFrame:
    """Detections of several methods or resolutions in one table, which each came from in `column`."""
    return reduce(DataFrame.unionByName, [d.withColumn(column, F.lit(name)) for name, d in detections.items()])


def union_sidecars(**kinds: DataFrame) -> DataFrame:
    """Sidecars of several kinds (direct, pattern) in one table with their kind; a name of several kinds stays once for each."""
    return union_detections(kinds, "kind")


def distinct_colors(colors: DataFrame, columns: list[str] = ("r", "g", "b", "percentage")) -> DataFrame:
    return colors.select(*columns).distinct()


def except_skipped(images: DataFrame, skipped: DataFrame, key: str = "image") -> DataFrame:
    """Images (distinct) that are not among the skipped."""
    return images.select(key).subtract(skipped.select(key))


def class_counter(detections: DataFrame, by: str = "image", column: str = "class", order: str = "ord") -> DataFrame:
    """detections with nth: their number within their image and class."""
    return detections.withColumn("nth", F.row_number().over(Window.partitionBy(by, column).orderBy(order)))


def class_name(class_id: Column, names: list[str] | dict[int, str]) -> Column:
    """Name of a class id, class_{id} where it is unknown, null for null."""
    known = names if isinstance(names, dict) else dict(enumerate(names))
    fallback = F.concat(F.lit("class_"), class_id.cast("string"))
    if not known:
        return fallback
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, class_id.cast("int")), fallback)
