"""Statistics over operations, detections, benchmarks and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoflow.functions.quality import grade


def share(n: Column) -> Column:
    """Percentage of a count within the whole result."""
    return n * 100 / F.sum(n).over(Window.partitionBy())


def zero(c: Column) -> Column:
    """Averages over nothing are 0."""
    return F.coalesce(c, F.lit(0.0))


def counts(df: DataFrame, by: str, *more: Column) -> DataFrame:
    """Rows and percentage per value; the total is a second small aggregation over the counts."""
    per = df.groupBy(by).agg(F.count("*").alias("n"), *more)
    return per.withColumn("pct", share(F.col("n")))


def operation_stats(operations: DataFrame, images: int) -> DataFrame:
    """Per operation: documents, their share of the images, mean time, success rate and mean payload size."""
    return operations.groupBy("op").agg(
        F.count("*").alias("n"), (F.count("*") * 100 / F.lit(images)).alias("coverage_pct"), F.avg("processing_time").alias("avg_time"),
        (F.avg(F.col("success").cast("int")) * 100).alias("success_pct"), F.avg(F.octet_length("payload")).alias("avg_size"),
    )


def histogram(df: DataFrame, item: str, count: str = "items") -> DataFrame:
    """Images by their number of rows, and the percentage."""
    per = df.groupBy(item).agg(F.count("*").alias(count))
    return counts(per, count)


def class_analysis(detections: DataFrame) -> DataFrame:
    """Per class: count, percentage, confidence and area."""
    c, a = F.col("confidence"), F.col("w") * F.col("h")
    return counts(detections, "class", F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"), F.avg(a).alias("avg_area"))


def detector_performance(runs: DataFrame) -> DataFrame:
    """Per detector, over successful runs: time (population deviation), success rate, faces."""
    ok = lambda c: F.when(F.col("success"), c)
    t, f = ok(F.col("time")), ok(F.col("faces"))
    return runs.groupBy("detector").agg(
        zero(F.avg(t)).alias("avg_time"), zero(F.min(t)).alias("min_time"), zero(F.max(t)).alias("max_time"), zero(F.stddev_pop(t)).alias("std_time"),
        F.avg(F.col("success").cast("int")).alias("success_rate"), F.coalesce(F.sum(f), F.lit(0)).alias("total_faces"), zero(F.avg(f)).alias("avg_faces"),
    )


def detector_accuracy(runs: DataFrame) -> DataFrame:
    """Per detector, over all confidences of successful runs, and over all face areas where runs have them."""
    kept = [("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop)]
    known = runs.select("detector").distinct()
    names = []
    for column, name, figures in (("confidences", "confidence", kept), ("areas", "face_area", kept[:3])):
        if column in runs.columns:
            flat = runs.where("success").select("detector", F.explode(column).alias("c"))
            known = known.join(flat.groupBy("detector").agg(*[f("c").alias(f"{k}_{name}") for k, f in figures]), "detector", "left")
            names += [f"{k}_{name}" for k, _ in figures]
    return known.select("detector", *[zero(F.col(n)).alias(n) for n in names])


def detector_comparison(performance: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Per detector its score (speed 40, accuracy 30, reliability 30, within 0 to 100) and who is fastest, surest, most reliable.

    Ties go to the first by name.
    """
    both = performance.join(accuracy, "detector")
    speed = F.greatest(F.lit(0.0), 100 - F.col("avg_time") * 100)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), speed * 0.4 + F.col("avg_confidence") * 100 * 0.3 + F.col("success_rate") * 100 * 0.3))
    one = both.agg(
        F.min(F.struct("avg_time", "detector"))["detector"].alias("fastest"), F.min(F.struct(-F.col("avg_confidence"), "detector"))["detector"].alias("most_accurate"), F.min(F.struct(-F.col("success_rate"), "detector"))["detector"].alias("most_reliable"),
    )
    return both.withColumn("score", score).join(F.broadcast(one))


def resolution_summary(runs: DataFrame, poses: str | None = None) -> DataFrame:
    """Per resolution: mean faces, time and, where there is such a column, poses."""
    more = [F.avg(poses).alias("avg_poses")] if poses else []
    return runs.groupBy("resolution").agg(F.avg("faces").alias("avg_faces"), F.avg("time").alias("avg_time"), F.count("*").alias("runs"), *more)


def method_totals(detections: DataFrame) -> DataFrame:
    """Per method: detections, and their mean per resolution at which the method found any."""
    per = detections.groupBy("method", "resolution").agg(F.count("*").alias("n"))
    return per.groupBy("method").agg(F.sum("n").alias("total"), F.avg("n").alias("per_resolution"))


def best_resolution(runs: DataFrame) -> DataFrame:
    """Per image the run with most faces, then the highest mean confidence, then the first; none if that run failed."""
    best = runs.groupBy("image").agg(F.max(F.struct("faces", "confidence", (-F.col("ord")).alias("o"), "resolution", "success")).alias("b"))
    return best.select("image", F.when(F.col("b.success"), F.col("b.resolution")).alias("best"), F.col("b.faces").alias("faces"))


def rank_resolutions(summary: DataFrame) -> DataFrame:
    return summary.withColumn("place", F.row_number().over(Window.orderBy(F.desc("avg_faces"), "resolution")))


def resolution_findings(summary: DataFrame) -> DataFrame:
    """Best and worst by faces, improvement of one over the other, and the most faces per second."""
    s = summary.agg(
        F.max(F.struct("avg_faces", "resolution")).alias("hi"), F.min(F.struct("avg_faces", "resolution")).alias("lo"), F.max(F.struct((F.col("avg_faces") / F.col("avg_time")).alias("rate"), "resolution")).alias("eff"),
    )
    gain = (F.col("hi.avg_faces") - F.col("lo.avg_faces")) / F.col("lo.avg_faces") * 100
    return s.select(F.col("hi.resolution").alias("best"), F.col("lo.resolution").alias("worst"), gain.alias("improvement_pct"), F.col("eff.resolution").alias("most_efficient"))


def exact_sum(c: Column, digits: int = 6) -> Column:
    """Sum in units of 10^-digits, as integers, so no order of addition changes it."""
    return F.sum(F.round(c * 10**digits).cast("long"))


def exact_mean(c: Column, digits: int = 6) -> Column:
    """Mean of values rounded to so many digits, itself rounded (half up) to as many: one exact division."""
    total, n = exact_sum(c, digits).cast("decimal(38,0)"), F.count(c)
    return (F.floor((total * 2 + n) / (n * 2)) / 10**digits).cast("double")


def run_summary(results: DataFrame, kinds: list[str], score: str = "score", field: str = "field", time: str = "time") -> DataFrame:
    """Results counted by each of several groupings and in total, in one pass: n, mean score, share with a field, total time.

    Columns that a row is not grouped by say "all"; a null of the column itself stays null.
    """
    cube = results.groupingSets([[], *[[F.col(k)] for k in kinds]], *[F.col(k) for k in kinds])
    own = cube.agg(
        *[F.grouping(k).alias(f"_all_{k}") for k in kinds], F.count("*").alias("n"), exact_mean(F.col(score)).alias("avg_score"),
        exact_mean(F.col(field).cast("int")).alias("field_rate"), (exact_sum(F.col(time)) / 1e6).alias("total_time"),
    )
    return own.select(*[F.when(F.col(f"_all_{k}") == 1, "all").otherwise(F.col(k)).alias(k) for k in kinds], "n", "avg_score", "field_rate", "total_time")


def grade_distribution(scores: DataFrame, column: str = "score", low: float = 0.5) -> DataFrame:
    """Per grade: rows, mean score, share of successes and rows below `low`."""
    graded = scores.withColumn("grade", grade(F.col(column)))
    return graded.groupBy("grade").agg(F.count("*").alias("n"), F.avg(column).alias("avg_score"), F.avg(F.col("success").cast("int")).alias("success_ratio"), F.count_if(F.col(column) < low).alias("low"))


def validation_stats(validated: DataFrame, time: str = "time") -> DataFrame:
    """Of validated documents (verdict, size): total, valid, their share, mean time and size."""
    ok = F.count_if(F.col("verdict") != "invalid")
    return validated.agg(F.count("*").alias("total"), ok.alias("valid"), (ok * 100 / F.count("*")).alias("valid_pct"), F.avg(time).alias("avg_time"), F.avg("size").alias("avg_size"))


def extraction_report(extractions: DataFrame, found: str = "found", cut: str = "cut") -> DataFrame:
    """Per run: images, how many gave something, objects found and cut out, and objects per image."""
    return extractions.agg(
        F.count("*").alias("images"), F.count_if(F.col(found) > 0).alias("ok"), F.count_if(F.col(found) == 0).alias("failed"), F.sum(found).alias("objects"),
        F.sum(cut).alias("extracted"), F.avg(found).alias("per_image"),
    )


def link_counts(files: DataFrame) -> DataFrame:
    """One row: files, links among them, and links that lead nowhere, of a list of files."""
    return files.agg(F.count("*").alias("images"), F.count_if("is_link").alias("symlinks"), F.count_if("broken").alias("broken_symlinks"))


def operation_links(operations: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """(op, images, symlinks, broken_symlinks): over the images (key) with a result of each operation; images not in the list are no links."""
    of = operations.select("op", key).distinct().join(files.select(key, "is_link", "broken"), key, "left")
    return of.groupBy("op").agg(F.count("*").alias("images"), F.count_if("is_link").alias("symlinks"), F.count_if("broken").alias("broken_symlinks"))


def multires_totals(detections: DataFrame, reconciled: DataFrame, image: str = "image") -> DataFrame:
    """One row: images, detections, reconciled faces and their share of the detections in per cent (0 without detections)."""
    d = detections.agg(F.countDistinct(image).alias("images"), F.count("*").alias("detections"))
    r = reconciled.agg(F.count("*").alias("reconciled"))
    rate = F.when(F.col("detections") > 0, F.col("reconciled") * 100.0 / F.col("detections")).otherwise(0.0)
    return d.join(F.broadcast(r)).withColumn("reconciliation_pct", rate)  # a row each


def multires_by_resolution(detections: DataFrame, image: str = "image", resolution: str = "resolution") -> DataFrame:
    """Per resolution its detections, the images with any of them, and detections per such image."""
    per = detections.groupBy(resolution).agg(F.count("*").alias("detections"), F.countDistinct(image).alias("images"))
    return per.withColumn("per_image", F.col("detections") / F.col("images"))


def multires_methods(reconciled: DataFrame, methods: str = "methods") -> DataFrame:
    """Per method the reconciled faces that it took part in."""
    return reconciled.select(F.explode(methods).alias("method")).groupBy("method").agg(F.count("*").alias("faces"))


def face_extraction_report(results: DataFrame) -> DataFrame:
    """One row over results (image, found, extracted, seconds): totals, share extracted, and means per image; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total = results.agg(F.count("*").alias("images"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "extracted", "seconds")])
    return total.withColumns({
        "extracted_share": share(F.col("extracted"), F.col("found")), "found_per_image": share(F.col("found"), F.col("images")), "seconds_per_image": share(F.col("seconds"), F.col("images")),
    })


def feature_counts(faces: DataFrame, features: str = "features") -> DataFrame:
    """(feature, label, n): facial features by type over an array of types for each face; the label is the type in words."""
    per = faces.select(F.explode(features).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    return per.select("feature", F.initcap(F.replace("feature", F.lit("_"), F.lit(" "))).alias("label"), "n")


def detection_rates(detections: DataFrame, by: str = "method", image: str = "image") -> DataFrame:
    """Per kind: detections per image of the whole table."""
    images = detections.agg(F.countDistinct(image).alias("_i"))  # one row
    return detections.groupBy(by).agg(F.count("*").alias("n")).join(F.broadcast(images)).select(by, "n", (F.col("n") / F.col("_i")).alias("per_image"))


def jersey_share(colors: DataFrame, jersey: Column, key: str = "photo") -> DataFrame:
    """Per image the summed percentages of jersey and of background colours."""
    s = lambda c: F.sum(F.when(c, F.col("percentage")).otherwise(0.0))
    return colors.groupBy(key).agg(s(jersey).alias("jersey"), s(~jersey).alias("background"))


def color_statistics(colors: DataFrame, name: Column, confidence: Column, key: str = "photo") -> DataFrame:
    """Per colour name: images, their share of all images, and mean confidence."""
    total = colors.agg(F.countDistinct(key).alias("_t"))  # one row
    per = colors.select(key, name.alias("name"), confidence.alias("_c")).where("name is not null").groupBy("name").agg(F.countDistinct(key).alias("images"), F.avg("_c").alias("avg_confidence"))
    return per.join(F.broadcast(total)).select("name", "images", (F.col("images") / F.col("_t")).alias("share"), "avg_confidence")


def split_summary(decisions: DataFrame) -> DataFrame:
    """Photos by their number of teams, splits, mean confidence, and the sorted list of all teams met."""
    team = F.explode(F.split("teams", ", ", -1))
    names = decisions.where("n_teams > 0").select(team.alias("team")).agg(F.array_join(F.array_sort(F.collect_set("team")), ", ").alias("team_list"))
    own = decisions.agg(
        F.count("*").alias("photos"), F.count_if(F.col("n_teams") == 0).alias("no_team"), F.count_if(F.col("n_teams") == 1).alias("one_team"),
        F.count_if(F.col("n_teams") > 1).alias("several_teams"), F.count_if("should_split").alias("split"), F.avg("confidence").alias("avg_confidence"),
    )
    return own.join(F.broadcast(names))


def channel_statistics(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Per channel mean, variance and deviation (population) of its 256-bin histogram, empty bins counted."""
    flat = pixels.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("bin")) for c in channels])).alias("p")).select("p.*")
    hist = flat.groupBy("channel", "bin").agg(F.count("*").cast("double").alias("n"))
    s, q = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return hist.groupBy("channel").agg((s / 256).alias("mean"), (q / 256 - (s / 256) * (s / 256)).alias("variance")).withColumn("std", F.sqrt("variance"))


def file_stats(files: DataFrame) -> DataFrame:
    """Files and bytes by extension, with a total row."""
    own = files.rollup("ext").agg(F.grouping("ext").alias("_all"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return own.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("ext")).alias("ext"), "files", "bytes")


def cluster_stats(members: DataFrame) -> DataFrame:
    """Per person: faces, distinct images, faces per image and mean confidence."""
    per = members.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("faces"), F.countDistinct("image").alias("images"), F.avg("confidence").alias("avg_confidence"))
    return per.withColumn("faces_per_image", F.col("faces") / F.col("images"))


def color_confidence(colors: DataFrame, jersey: Column, key: str = "photo") -> DataFrame:
    """Per image: 0.7 of the jersey share and 0.3 of the number of jersey colours (up to 3, less beyond 5), 0 without any."""
    n = F.count_if(jersey)
    share_ = F.try_divide(F.sum(F.when(jersey, F.col("percentage")).otherwise(0.0)), F.sum("percentage"))
    bonus = F.least(n / 3, F.lit(1.0)) * F.when(n > 5, 0.8).otherwise(1.0)
    return colors.groupBy(key).agg(F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(share_, F.lit(0.0)) * 0.7 + bonus * 0.3)).alias("confidence"), F.sum(F.when(jersey, F.col("percentage")).otherwise(0.0)).alias("jersey_share"))
