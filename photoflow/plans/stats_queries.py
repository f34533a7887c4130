"""Statistics, ranks, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.functions import color as C
from photoflow.operators import detectors as E
from photoflow.operators import filters as R
from photoflow.operators import joins as J
from photoflow.operators import stats as T
from photoflow.plans import fixtures as X
from photoflow.plans.registry import query


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _n(table: DataFrame) -> int:
    return table.count()


@query("f3_sidecar_stats", f"""WITH {X.OPERATIONS} SELECT op, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM operations), 6) AS coverage_pct, round(avg(processing_time), 6) AS avg_time, round(avg(CAST(success AS INTEGER)) * 100, 6) AS success_pct, round(avg(strlen(payload)), 6) AS avg_size FROM operations GROUP BY op""")
def f3(spark, sf_dir) -> DataFrame:
    o = X.operations(spark, sf_dir)
    return _round(T.operation_stats(o, _n(o)), "coverage_pct", "avg_time", "success_pct", "avg_size")


@query("f4_operation_summary", f"WITH {X.OPERATIONS} SELECT op, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM operations GROUP BY op")
def f4(spark, sf_dir) -> DataFrame:
    return _round(T.counts(X.operations(spark, sf_dir), "op"), "pct")


@query("f5_object_class_counts", f"WITH {X.DETECTIONS} SELECT class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM detections GROUP BY class")
def f5(spark, sf_dir) -> DataFrame:
    return _round(T.counts(X.detections(spark, sf_dir), "class"), "pct")


@query("f6_face_histogram", f"WITH {X.DETECTIONS}, p AS (SELECT image, count(*) AS items FROM detections GROUP BY image) SELECT items, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM p GROUP BY items")
def f6(spark, sf_dir) -> DataFrame:
    return _round(T.histogram(X.detections(spark, sf_dir), "image"), "pct")


@query("f7_object_analysis", f"WITH {X.DETECTIONS} SELECT class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct, round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence, round(avg(w * h), 6) AS avg_area FROM detections GROUP BY class")
def f7(spark, sf_dir) -> DataFrame:
    return _round(T.class_analysis(X.detections(spark, sf_dir)), "pct", "avg_confidence", "min_confidence", "max_confidence", "avg_area")


_RUNS = "runs AS (SELECT event_type AS detector, user_id AS image, value / 100 AS time, value > 5 AS success, event_id % 6 AS faces, value / 500 AS c1, 0.5 AS c2, (event_id % 30 + 20) * (event_id % 7 + 20) AS area FROM events)"


def _runs(spark, sf_dir) -> DataFrame:
    return X.table(spark, sf_dir, "events").selectExpr("event_type as detector", "user_id as image", "value / 100 as time", "value > 5 as success", "event_id % 6 as faces", "array(value / 500, 0.5D) as confidences", "array((event_id % 30 + 20) * (event_id % 7 + 20), 400) as areas")


_PERF = "perf AS (SELECT detector, avg(time) FILTER (success) AS avg_time, min(time) FILTER (success) AS min_time, max(time) FILTER (success) AS max_time, stddev_pop(time) FILTER (success) AS std_time, avg(CAST(success AS INTEGER)) AS success_rate, sum(faces) FILTER (success) AS total_faces, avg(faces) FILTER (success) AS avg_faces FROM runs GROUP BY detector)"
_ACC = "acc AS (SELECT detector, avg(c) AS avg_confidence, min(c) AS min_confidence, max(c) AS max_confidence, stddev_pop(c) AS std_confidence FROM (SELECT detector, unnest([c1, c2]) AS c FROM runs WHERE success) GROUP BY detector)"


@query("f8_benchmark_performance", f"WITH {_RUNS}, {_PERF} SELECT detector, round(avg_time, 6) AS avg_time, round(min_time, 6) AS min_time, round(max_time, 6) AS max_time, round(std_time, 6) AS std_time, round(success_rate, 6) AS success_rate, CAST(total_faces AS BIGINT) AS total_faces, round(avg_faces, 6) AS avg_faces FROM perf")
def f8(spark, sf_dir) -> DataFrame:
    return _round(T.detector_performance(_runs(spark, sf_dir)), "avg_time", "min_time", "max_time", "std_time", "success_rate", "avg_faces")


@query("f9_benchmark_accuracy", f"WITH {_RUNS}, {_ACC}, ar AS (SELECT detector, avg(a) AS avg_a, min(a) AS min_a, max(a) AS max_a FROM (SELECT detector, unnest([area, 400]) AS a FROM runs WHERE success) GROUP BY detector) SELECT detector, round(avg_confidence, 6) AS avg_confidence, round(min_confidence, 6) AS min_confidence, round(max_confidence, 6) AS max_confidence, round(std_confidence, 6) AS std_confidence, round(avg_a, 6) AS avg_face_area, CAST(min_a AS DOUBLE) AS min_face_area, CAST(max_a AS DOUBLE) AS max_face_area FROM acc JOIN ar USING (detector)")
def f9(spark, sf_dir) -> DataFrame:
    return _round(T.detector_accuracy(_runs(spark, sf_dir)), "avg_confidence", "min_confidence", "max_confidence", "std_confidence", "avg_face_area")


@query("f10_detector_comparison", f"""WITH {_RUNS}, {_PERF}, {_ACC}, b AS (SELECT * FROM perf JOIN acc USING (detector))
SELECT detector, round(greatest(0, least(100, greatest(0, 100 - avg_time * 100) * 0.4 + avg_confidence * 30 + success_rate * 30)), 6) AS score, (SELECT detector FROM b ORDER BY avg_time, detector LIMIT 1) AS fastest,
 (SELECT detector FROM b ORDER BY avg_confidence DESC, detector LIMIT 1) AS most_accurate, (SELECT detector FROM b ORDER BY success_rate DESC, detector LIMIT 1) AS most_reliable FROM b""")
def f10(spark, sf_dir) -> DataFrame:
    r = _runs(spark, sf_dir)
    c = T.detector_comparison(T.detector_performance(r), T.detector_accuracy(r))
    return _round(c, "score").select("detector", "score", "fastest", "most_accurate", "most_reliable")


_RES = "res AS (SELECT o_custkey AS image, o_orderpriority AS resolution, o_orderkey AS ord, (SELECT 1) AS one, count(l_orderkey) AS faces, any_value(o_totalprice) / 1e5 AS time, coalesce(avg(l_discount), 0) AS confidence, any_value(o_orderstatus) <> 'P' AS success FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def _res(spark, sf_dir) -> DataFrame:
    o, li = X.table(spark, sf_dir, "orders"), X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_discount").alias("d"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.selectExpr("o_custkey as image", "o_orderpriority as resolution", "o_orderkey as ord", "coalesce(n, 0) as faces", "o_totalprice / 1e5D as time", "round(coalesce(d, 0), 9) as confidence", "o_orderstatus <> 'P' as success")


_SUM = "summ AS (SELECT resolution, avg(faces) AS avg_faces, avg(time) AS avg_time, count(*) AS runs FROM res GROUP BY resolution)"


@query("f13_resolution_summary", f"WITH {_RES}, {_SUM}, p AS (SELECT o_orderpriority AS resolution, count(l_orderkey) * 1.0 / count(DISTINCT o_orderkey) AS avg_poses FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1) SELECT resolution, round(avg_faces, 6) AS avg_faces, round(avg_time, 6) AS avg_time, runs, round(avg_poses, 6) AS avg_poses FROM summ JOIN p USING (resolution)")
def f13(spark, sf_dir) -> DataFrame:
    poses = X.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ord"))
    runs = R.join_poses(_res(spark, sf_dir), poses, "ord")
    return _round(T.resolution_summary(runs, "poses"), "avg_faces", "avg_time", "avg_poses")


@query("f14_best_resolution", f"WITH {_RES}, k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY faces DESC, round(confidence, 9) DESC, ord) AS k FROM res) SELECT image, CASE WHEN success THEN resolution ELSE 'failed' END AS best, faces FROM k WHERE k = 1")
def f14(spark, sf_dir) -> DataFrame:
    return T.best_resolution(_res(spark, sf_dir)).select("image", F.coalesce("best", F.lit("failed")).alias("best"), "faces")


@query("e8_rank_resolutions", f"WITH {_RES}, {_SUM} SELECT resolution, CAST(row_number() OVER (ORDER BY avg_faces DESC, resolution) AS INTEGER) AS place FROM summ")
def e8(spark, sf_dir) -> DataFrame:
    return T.rank_resolutions(T.resolution_summary(_res(spark, sf_dir))).select("resolution", "place")


@query("h2_top_resolutions", f"WITH {_RES}, {_SUM} SELECT resolution FROM summ ORDER BY avg_faces DESC, resolution LIMIT 3")
def h2(spark, sf_dir) -> DataFrame:
    return R.top_n(T.resolution_summary(_res(spark, sf_dir)), 3, "avg_faces", "resolution").select("resolution")


@query("f16_resolution_findings", f"WITH {_RES}, {_SUM} SELECT arg_max(resolution, (avg_faces, resolution)) AS best, arg_min(resolution, (avg_faces, resolution)) AS worst, round((max(avg_faces) - min(avg_faces)) / min(avg_faces) * 100, 6) AS improvement_pct, arg_max(resolution, (avg_faces / avg_time, resolution)) AS most_efficient FROM summ")
def f16(spark, sf_dir) -> DataFrame:
    return _round(T.resolution_findings(T.resolution_summary(_res(spark, sf_dir))), "improvement_pct")


_EXACT = "((2 * sum(CAST(round({c} * 1000000) AS BIGINT)) + count({c})) // (2 * count({c}))) / 1000000.0"


@query("f12_run_summary", f"""WITH r AS (SELECT l_returnflag AS ball, l_linestatus AS action, l_discount AS score, CAST(l_quantity > 25 AS INTEGER) AS field, l_tax AS time FROM lineitem) SELECT CASE WHEN grouping(ball) = 1 THEN 'all' ELSE ball END AS ball, CASE WHEN grouping(action) = 1 THEN 'all' ELSE action END AS action, count(*) AS n,
 CAST({_EXACT.format(c="score")} AS DOUBLE) AS avg_score, CAST({_EXACT.format(c="field")} AS DOUBLE) AS field_rate, CAST(sum(CAST(round(time * 1000000) AS BIGINT)) / 1000000.0 AS DOUBLE) AS total_time FROM r GROUP BY GROUPING SETS ((), (ball), (action))""")
def f12(spark, sf_dir) -> DataFrame:
    r = X.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as ball", "l_linestatus as action", "l_discount as score", "l_quantity > 25 as field", "l_tax as time")
    return T.run_summary(r, ["ball", "action"])


@query("f18_channel_statistics", f"""WITH {X.COLORS}, f AS (SELECT 'r' AS channel, r AS bin FROM colors UNION ALL SELECT 'g', g FROM colors UNION ALL SELECT 'b', b FROM colors), h AS (SELECT channel, bin, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY ALL),
v AS (SELECT channel, sum(n) / 256 AS mean, sum(n * n) / 256 - (sum(n) / 256) * (sum(n) / 256) AS variance FROM h GROUP BY channel) SELECT channel, round(mean, 6) AS mean, round(variance, 6) AS variance, round(sqrt(variance), 6) AS std FROM v""")
def f18(spark, sf_dir) -> DataFrame:
    return _round(T.channel_statistics(X.colors(spark, sf_dir), ["r", "g", "b"]), "mean", "variance", "std")


@query("f20_file_stats", "SELECT coalesce(o_orderpriority, 'all') AS ext, count(*) AS files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY ROLLUP (o_orderpriority)")
def f20(spark, sf_dir) -> DataFrame:
    return T.file_stats(X.table(spark, sf_dir, "orders").selectExpr("o_orderpriority as ext", "cast(floor(o_totalprice) as bigint) as bytes"))


@query("f21_extraction_report", "SELECT count(*) AS images, count(*) FILTER (n > 0) AS ok, count(*) FILTER (n = 0) AS failed, CAST(sum(n) AS BIGINT) AS objects, CAST(sum(c) AS BIGINT) AS extracted, round(avg(n), 6) AS per_image FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(l_orderkey) FILTER (l_quantity >= 12) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def f21(spark, sf_dir) -> DataFrame:
    cut = R.filter_size(X.detections(spark, sf_dir), 32).groupBy(F.col("image").alias("ord")).agg(F.count("*").alias("cut"))
    r = _res(spark, sf_dir).withColumnRenamed("faces", "found").join(cut, "ord", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return _round(T.extraction_report(r), "per_image")


@query("f21_extracted_classes", f"WITH {X.DETECTIONS} SELECT class, count(*) AS found, count(*) FILTER (w >= 32) AS extracted FROM detections GROUP BY class")
def f21_classes(spark, sf_dir) -> DataFrame:
    return X.detections(spark, sf_dir).groupBy("class").agg(F.count("*").alias("found"), F.count_if(F.col("w") >= 32).alias("extracted"))


@query("f21_face_report", f"""WITH {X.DETECTIONS}, i AS (SELECT image, count(*) AS found, count(*) FILTER (w >= 32) AS extracted, count(*) * 0.5 AS seconds FROM detections GROUP BY image)
SELECT count(*) AS images, CAST(sum(found) AS BIGINT) AS found, CAST(sum(extracted) AS BIGINT) AS extracted, sum(seconds) AS seconds, round(sum(extracted) / sum(found), 6) AS extracted_share,
  round(sum(found) / count(*), 6) AS found_per_image, round(sum(seconds) / count(*), 6) AS seconds_per_image FROM i""")
def f21_faces(spark, sf_dir) -> DataFrame:
    per = X.detections(spark, sf_dir).groupBy("image").agg(F.count("*").alias("found"), F.count_if(F.col("w") >= 32).alias("extracted"), (F.count("*") * 0.5).alias("seconds"))
    return _round(T.face_extraction_report(per), "extracted_share", "found_per_image", "seconds_per_image")


@query("f21_feature_counts", f"""WITH {X.DETECTIONS}, f AS (SELECT unnest(['left_eye_' || method, 'mouth_' || resolution]) AS feature FROM detections UNION ALL SELECT 'nose_tip' FROM detections WHERE ord % 2 = 0)
SELECT feature, CASE WHEN feature LIKE 'left%' THEN 'Left Eye ' || feature[10:] WHEN feature LIKE 'mouth%' THEN 'Mouth ' || feature[7:] ELSE 'Nose Tip' END AS label, count(*) AS n FROM f GROUP BY feature""")
def f21_features(spark, sf_dir) -> DataFrame:
    types = F.array(F.concat(F.lit("left_eye_"), "method"), F.concat(F.lit("mouth_"), "resolution"), F.when(F.col("ord") % 2 == 0, "nose_tip"))
    return T.feature_counts(X.detections(spark, sf_dir).select(F.array_compact(types).alias("features")))


@query("f24_detection_rates", f"WITH {X.DETECTIONS} SELECT method, count(*) AS n, round(count(*) * 1.0 / (SELECT count(DISTINCT image) FROM detections), 6) AS per_image FROM detections GROUP BY method")
def f24(spark, sf_dir) -> DataFrame:
    return _round(T.detection_rates(X.detections(spark, sf_dir)), "per_image")


_JERSEY = "(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END) >= 0.7"


def _jersey():
    return C.is_jersey(C.rgb_to_hsv((F.col("r"), F.col("g"), F.col("b")), 1.0)[1], 0.7)


@query("b16_color_confidence", f"""WITH {X.COLORS}, j AS (SELECT photo, percentage, {_JERSEY} AS j FROM colors), a AS (SELECT photo, count(*) FILTER (j) AS n, coalesce(sum(percentage) FILTER (j), 0) AS s, sum(percentage) AS t FROM j GROUP BY photo)
SELECT photo, round(CASE WHEN n = 0 THEN 0 ELSE least(1, coalesce(s / nullif(t, 0), 0) * 0.7 + least(n / 3, 1) * CASE WHEN n > 5 THEN 0.8 ELSE 1.0 END * 0.3) END, 6) AS confidence FROM a""")
def b16(spark, sf_dir) -> DataFrame:
    return _round(T.color_confidence(X.colors(spark, sf_dir), _jersey()), "confidence").select("photo", "confidence")


@query("f26_jersey_share", f"WITH {X.COLORS} SELECT photo, round(coalesce(sum(percentage) FILTER ({_JERSEY}), 0), 6) AS jersey, round(coalesce(sum(percentage) FILTER (NOT {_JERSEY}), 0), 6) AS background FROM colors GROUP BY photo")
def f26(spark, sf_dir) -> DataFrame:
    return _round(T.jersey_share(X.colors(spark, sf_dir), _jersey()), "jersey", "background")


@query("f17_color_statistics", f"""WITH {X.COLORS}, pal AS ({" UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS name, {r} AS pr, {g} AS pg, {b} AS pb, {t} AS tol" for k, (n, r, g, b, t) in enumerate(C.PALETTE))}),
d AS (SELECT photo, ord, name, k, tol, sqrt((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) AS d FROM colors, pal), m AS (SELECT photo, ord, arg_min(name, (d, k)) AS name, arg_min(1 - 0.3 * d / tol, (d, k)) AS cf FROM d WHERE d <= tol GROUP BY photo, ord)
SELECT name, count(DISTINCT photo) AS images, round(count(DISTINCT photo) * 1.0 / (SELECT count(DISTINCT photo) FROM colors), 6) AS share, round(avg(cf), 6) AS avg_confidence FROM m GROUP BY name""")
def f17(spark, sf_dir) -> DataFrame:
    return _round(T.color_statistics(X.colors(spark, sf_dir), *C.classify_color((F.col("r"), F.col("g"), F.col("b")))), "share", "avg_confidence")


# ---- order, samples, sets

@query("h1_top_classes", f"WITH {X.DETECTIONS}, c AS (SELECT class, count(*) AS n FROM detections GROUP BY class), t AS (SELECT class, n FROM c ORDER BY n DESC, class LIMIT 3) SELECT * FROM t UNION ALL SELECT (count(*) - 3) || ' more', CAST(sum(n) - (SELECT sum(n) FROM t) AS BIGINT) FROM c HAVING count(*) > 3")
def h1(spark, sf_dir) -> DataFrame:
    return R.top_n(X.detections(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n")), 3, "n", "class", rest=True)


@query("h3_sample_images", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50")
def h3(spark, sf_dir) -> DataFrame:
    return R.sample_images(X.table(spark, sf_dir, "orders").select("o_orderkey"), 50, "o_orderkey")


@query("h4_limit_images", f"WITH {X.PHOTOS} SELECT photo_id, filename FROM photos ORDER BY filename, photo_id LIMIT 100")
def h4(spark, sf_dir) -> DataFrame:
    return R.limit_images(X.photos(spark, sf_dir), 100, "filename", "photo_id").select("photo_id", "filename")


@query("i1_union_catalogs", f"WITH {X.PHOTOS} SELECT DISTINCT filename FROM photos WHERE photo_id % 3 = 0 OR photo_id % 2 = 0")
def i1(spark, sf_dir) -> DataFrame:
    p = X.photos(spark, sf_dir)
    return R.union_catalogs(p.where("photo_id % 3 = 0"), p.where("photo_id % 2 = 0"), key="filename")


@query("i2_union_detections", "SELECT method, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM (SELECT 'orders' AS method, o_orderkey % 7 AS score FROM orders UNION ALL SELECT 'parts', p_size FROM part UNION ALL SELECT 'events', event_id % 5 FROM events) GROUP BY method")
def i2(spark, sf_dir) -> DataFrame:
    """Three tables as the detections of three methods."""
    parts = {
        "orders": X.table(spark, sf_dir, "orders").selectExpr("o_orderkey % 7 as score"), "parts": X.table(spark, sf_dir, "part").selectExpr("cast(p_size as bigint) as score"),
        "events": X.table(spark, sf_dir, "events").selectExpr("event_id % 5 as score"),
    }
    return R.union_detections(parts).groupBy("method").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("i3_distinct_colors", f"WITH {X.COLORS} SELECT DISTINCT r, g, b, percentage FROM colors")
def i3(spark, sf_dir) -> DataFrame:
    return R.distinct_colors(X.colors(spark, sf_dir))


@query("i4_except_skipped", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def i4(spark, sf_dir) -> DataFrame:
    skipped = X.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.except_skipped(X.table(spark, sf_dir, "orders"), skipped, "o_orderkey")


@query("i5_union_sidecars", "SELECT kind, stem, count(*) AS n FROM (SELECT 'direct' AS kind, event_id % 50 AS stem FROM events WHERE event_id % 50 < 30 UNION ALL SELECT 'pattern', event_id % 50 FROM events WHERE event_id % 50 > 20) GROUP BY ALL")
def i5(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("stem"))
    return R.union_sidecars(direct=e.where("stem < 30"), pattern=e.where("stem > 20")).groupBy("kind", "stem").agg(F.count("*").alias("n"))


@query("e7_class_counter", f"WITH {X.DETECTIONS} SELECT image, ord, CAST(row_number() OVER (PARTITION BY image, class ORDER BY ord) AS INTEGER) AS nth FROM detections")
def e7(spark, sf_dir) -> DataFrame:
    return R.class_counter(X.detections(spark, sf_dir)).select("image", "ord", "nth")


@query("a12_crop_manifest", f"""WITH {X.DETECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY ord) AS k FROM detections WHERE lower(class) IN ('ao', 'nf', 'rf'))
SELECT image, ord, class, CAST(k AS INTEGER) AS n, image || '_' || class || '_' || lpad(CAST(k AS VARCHAR), 2, '0') || '.jpg' AS name, CAST(trunc(x) AS BIGINT) AS x1, CAST(trunc(y) AS BIGINT) AS y1, CAST(least(60, trunc(x + w)) AS BIGINT) AS x2, CAST(least(50, trunc(y + h)) AS BIGINT) AS y2 FROM n""")
def a12(spark, sf_dir) -> DataFrame:
    from photoflow.sources.sidecars import crop_manifest

    return crop_manifest(X.detections(spark, sf_dir), F.lit(60), F.lit(50), types=["AO", "nf", "RF"])


@query("j1_apply_detector", f"WITH {X.PHOTOS} SELECT photo_id AS image, photo_id % 50 <> 7 AS success, CASE WHEN photo_id % 50 <> 7 THEN photo_id % 4 ELSE 0 END AS faces FROM photos")
def j1(spark, sf_dir) -> DataFrame:
    def detector(batch, config):
        if (batch["image"] % 50 == 7).any():
            raise ValueError("cannot read")
        return batch.assign(faces=batch["image"] % config["kinds"])[["image", "faces"]]

    d = J.Detectors()
    d.register("faces", detector, "image long, faces long", kinds=9)
    out = d.run("faces", X.photos(spark, sf_dir).select(F.col("photo_id").alias("image")), kinds=4, other=1)
    return out.select("image", "success", F.coalesce(F.col("faces").cast("long"), F.lit(0)).alias("faces"))


@query("j1_detector_accounts", """WITH p AS (SELECT event_id AS image FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 10 = 1)
SELECT image, image % 7 <> 3 AND image % 50 <> 7 AS success, CASE WHEN image % 7 <> 3 AND image % 50 <> 7 THEN image % 4 ELSE -1 END AS faces,
  CASE WHEN image % 50 = 7 THEN 'cannot read' WHEN image % 7 = 3 THEN 'no result' ELSE 'none' END AS error FROM p""")
def j1_accounts(spark, sf_dir) -> DataFrame:
    """A detector with a model and small batches that fails on some images and leaves others out; some images come twice."""

    def detect(batch, config, model):
        assert len(batch) <= 64
        if (batch["image"] % 50 == 7).any():
            raise ValueError("cannot read")
        return batch[batch["image"] % 7 != 3].assign(faces=lambda b: b["image"] % model)[["image", "faces"]].sort_values("image", ascending=False)

    photos = X.photos(spark, sf_dir).select(F.col("photo_id").alias("image"))
    d = E.Detectors()
    d.register("faces", detect, "image long, faces long", batch_size=64, model=lambda config: config["kinds"], kinds=4)
    out = d.run("faces", photos.unionByName(photos.where("image % 10 = 1")))
    return out.select("image", "success", F.coalesce("faces", F.lit(-1)).alias("faces"), F.coalesce("error", F.lit("none")).alias("error"))


@query("a9_report_json", f"WITH {X.DETECTIONS} SELECT image, CAST(count(*) AS BIGINT) AS n, round(max(confidence), 6) AS best FROM detections GROUP BY image")
def a9(spark, sf_dir) -> DataFrame:
    """The report is written as JSON and read again."""
    from photoflow.scratch import new_path
    from photoflow.sources.sidecars import write_report_json

    rows = X.detections(spark, sf_dir).groupBy("image").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("best"))
    write_report_json(rows, path := new_path(spark, "report"))
    return spark.read.schema(rows.schema).json(path)


@query("a9_cluster_csv", "SELECT CAST(label AS INTEGER) AS cluster_id, vec_id AS face FROM embeddings WHERE vec_id % 9 > 0 UNION ALL SELECT -1, vec_id FROM embeddings WHERE vec_id % 9 = 0")
def a9_csv(spark, sf_dir) -> DataFrame:
    """Clusters as CSV, what belongs to none with cluster -1, read again."""
    from photoflow.scratch import new_path
    from photoflow.sources.sidecars import write_csv

    e = X.table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("cluster_id"), F.col("vec_id").alias("face"))
    write_csv(e.where("face % 9 > 0"), path := new_path(spark, "clusters"), e.where("face % 9 = 0").drop("cluster_id"))
    return spark.read.option("header", "true").schema("cluster_id int, face long").csv(path)


@query("a11_export_sidecars", f"WITH {X.OPERATIONS}, {X.SIDECARS} SELECT o.image, 'shoot/IMG_' || o.image || '.json' AS path, op, 'c' || o.image AS created, CAST(strlen(doc) AS INTEGER) AS size FROM operations o JOIN sidecars USING (image) WHERE o.image % 97 <> 0")
def a11(spark, sf_dir) -> DataFrame:
    from photoflow.sources.sidecars import export_sidecars

    return export_sidecars(X.sidecars(spark, sf_dir))


@query("f16_method_totals", f"WITH {X.DETECTIONS}, p AS (SELECT method, resolution, count(*) AS n FROM detections GROUP BY ALL) SELECT method, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS per_resolution FROM p GROUP BY method")
def f16_methods(spark, sf_dir) -> DataFrame:
    return _round(T.method_totals(X.detections(spark, sf_dir)), "per_resolution")


@query("j5_run_two_detectors", f"WITH {X.PHOTOS} SELECT photo_id AS image, photo_id % 50 <> 7 AS success, CASE WHEN photo_id % 50 <> 7 THEN photo_id % 4 END AS faces, photo_id % 3 AS objects, CASE WHEN photo_id % 50 = 7 THEN 'face: cannot read' END AS error FROM photos")
def j5(spark, sf_dir) -> DataFrame:
    def face(batch, config):
        if (batch["image"] % 50 == 7).any():
            raise ValueError("cannot read")
        return batch.assign(n=batch["image"] % config["kinds"])[["image", "n"]]

    def thing(batch, config):
        return batch.assign(n=batch["image"] % 3)[["image", "n"]]

    photos = X.photos(spark, sf_dir).select(F.col("photo_id").alias("image"))
    out = E.run_two_detectors(photos, ("face", face, "n long"), ("object", thing, "n long"), config={"kinds": 4})
    return out.select("image", "success", F.col("face.n").alias("faces"), F.col("object.n").alias("objects"), "error")


@query("j2_detector_registry", f"WITH {X.PHOTOS} SELECT photo_id AS image, true AS success, photo_id % 4 AS n, 'depth' AS other, CAST(NULL AS VARCHAR) AS error, 'known' AS detector FROM photos UNION ALL SELECT photo_id, false, NULL, NULL, 'unknown detector balls', 'balls' FROM photos")
def j2(spark, sf_dir) -> DataFrame:
    """A detector with one setting replaced and one that it does not know, and a detector that nobody registered."""
    d = J.Detectors()
    d.register("faces", lambda batch, config: batch.assign(n=batch["image"] % config["kinds"], other=",".join(config["tool_params"])), "image long, n long, other string", kinds=9)
    photos = X.photos(spark, sf_dir).select(F.col("photo_id").alias("image"))
    known = d.run("faces", photos, kinds=4, depth=1).select("image", "success", "n", "other", "error", F.lit("known").alias("detector"))
    return known.unionByName(d.run("balls", photos).withColumn("detector", F.lit("balls")), allowMissingColumns=True)
