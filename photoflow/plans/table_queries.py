"""Documents, joins and statistics over photo tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photoflow.functions import color as C
from photoflow.functions import documents as D
from photoflow.operators import filters as R
from photoflow.operators import joins as J
from photoflow.plans import fixtures as X
from photoflow.plans.registry import query
from photoflow.operators import stats as T
from photoflow.sources import sidecars as S



@query("a4_explode_operations", f"WITH {X.SIDECARS}, {X.OPERATIONS} SELECT o.image, op, success FROM operations o WHERE o.image % 97 <> 0")
def a4(spark, sf_dir) -> DataFrame:
    return S.explode_operations(X.sidecars(spark, sf_dir)).select("image", "op", "success")


@query("b32_operation_type", f"WITH {X.OPERATIONS} SELECT image, CASE WHEN image % 97 = 0 OR image % 5 = 0 OR op NOT IN ('click', 'view') THEN 'unknown' ELSE op END AS kind FROM operations")
def b32(spark, sf_dir) -> DataFrame:
    return X.sidecars(spark, sf_dir).select("image", D.operation_type(F.col("doc"), F.col("path"), types=["click", "view"], legacy={"nothing": "x"}).alias("kind"))


@query("b33_detection_count", f"WITH {X.OPERATIONS} SELECT image, CAST(CASE WHEN image % 97 = 0 THEN 0 ELSE image % 6 END AS BIGINT) AS n FROM operations")
def b33(spark, sf_dir) -> DataFrame:
    doc = F.concat(F.lit('{"result":'), F.regexp_extract("doc", r'"[a-z_]+":(\{"success.*\})\}$', 1), F.lit("}"))
    return X.sidecars(spark, sf_dir).select("image", D.detection_count(F.when(F.col("image") % 97 == 0, F.col("doc")).otherwise(doc)).alias("n"))


@query("b34_contains_operation", f"WITH {X.OPERATIONS} SELECT image, image % 97 <> 0 AND op = 'click' AS has FROM operations")
def b34(spark, sf_dir) -> DataFrame:
    return X.sidecars(spark, sf_dir).select("image", D.contains_operation(F.col("doc"), "click").alias("has"))


@query("b36_sidecar_fields", f"WITH {X.OPERATIONS} SELECT image, CASE WHEN image % 97 = 0 THEN -1 ELSE floor(value) END AS t, CASE WHEN image % 97 = 0 THEN true ELSE value < 100 END AS ok FROM operations")
def b36(spark, sf_dir) -> DataFrame:
    inner = F.regexp_extract("doc", r'"[a-z_]+":(\{"success.*\})\}$', 1)
    f = D.sidecar_fields(F.when(F.col("image") % 97 == 0, F.col("doc")).otherwise(inner), older=True)
    return X.sidecars(spark, sf_dir).select("image", F.coalesce(f["processing_time"], F.lit(-1.0)).alias("t"), f["success"].alias("ok"))


@query("c6_validate_documents", f"WITH {X.OPERATIONS}, {X.SIDECARS} SELECT o.image, CASE WHEN o.image % 97 = 0 THEN 'invalid' WHEN value >= 100 THEN 'failed' WHEN o.image % 6 = 0 THEN 'empty' ELSE 'valid' END AS verdict, CAST(strlen(doc) AS INTEGER) AS size FROM operations o JOIN sidecars USING (image)")
def c6(spark, sf_dir) -> DataFrame:
    rules = [("failed", F.col("doc").contains('"success":true')), ("empty", ~F.col("doc").contains('"count":0'))]
    return R.validate_documents(X.sidecars(spark, sf_dir), rules).select("image", "verdict", "size")


@query("f22_validation_stats", f"WITH {X.OPERATIONS}, {X.SIDECARS} SELECT count(*) AS total, count(*) FILTER (o.image % 97 <> 0) AS valid, round(count(*) FILTER (o.image % 97 <> 0) * 100.0 / count(*), 6) AS valid_pct, round(sum(CAST(floor(value) AS BIGINT)) * 1.0 / count(*), 6) AS avg_time, round(sum(strlen(doc)) * 1.0 / count(*), 6) AS avg_size FROM operations o JOIN sidecars USING (image)")
def f22(spark, sf_dir) -> DataFrame:
    checked = R.validate_documents(X.sidecars(spark, sf_dir)).join(X.operations(spark, sf_dir).select("image", F.floor("value").alias("time")), "image")
    return T.validation_stats(checked).withColumns({c: F.round(c, 6) for c in ("valid_pct", "avg_time", "avg_size")})


@query("d1_join_sidecars", """WITH i AS (SELECT event_id AS stem FROM events), s AS (SELECT event_id AS stem, 'json' AS format, 1 AS k FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 'bin', 0 FROM events WHERE event_id % 4 = 0)
SELECT i.stem, coalesce(arg_min(format, k), 'none') AS format FROM i LEFT JOIN s USING (stem) GROUP BY i.stem""")
def d1(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("stem"))
    side = lambda cond, f: e.where(cond).select("stem", F.lit(f).alias("format"), F.concat(F.col("stem").cast("string"), F.lit(f".{f}")).alias("path"))
    return J.join_sidecars(e, side("stem % 3 > 0", "json").unionByName(side("stem % 4 = 0", "bin"))).select("stem", F.coalesce("format", F.lit("none")).alias("format"))


@query("d2_join_pattern_sidecars", "SELECT 'p' || (event_id % 500) AS stem, count(*) AS n FROM events WHERE event_id % 500 >= 100 GROUP BY 1")
def d2(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    images = spark.range(100, 500).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("stem"))
    sidecars = e.select(F.concat(F.lit("p"), (F.col("event_id") % 500).cast("string"), F.lit("_"), F.col("event_id").cast("string")).alias("stem"))
    return J.join_pattern_sidecars(images, sidecars).groupBy("stem").agg(F.count("*").alias("n"))


_STEMS = "s AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'a_' || (event_id % 700) ELSE 'b' || (event_id % 700) || '_' || (event_id % 5) END AS stem FROM events), i AS (SELECT DISTINCT 'b' || (event_id % 300) AS stem FROM events UNION SELECT DISTINCT 'a_' || (event_id % 350) FROM events)"


@query("d3_orphan_sidecars", f"WITH {_STEMS} SELECT stem, count(*) AS n FROM s WHERE stem NOT IN (SELECT stem FROM i) AND regexp_replace(stem, '_[^_]*$', '') NOT IN (SELECT stem FROM i) GROUP BY stem")
def d3(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    e = X.table(spark, sf_dir, "events")
    s = e.select(F.when(k % 3 == 0, F.concat(F.lit("a_"), text(k % 700))).otherwise(F.concat(F.lit("b"), text(k % 700), F.lit("_"), text(k % 5))).alias("stem"))
    i = e.select(F.concat(F.lit("b"), text(k % 300)).alias("stem")).union(e.select(F.concat(F.lit("a_"), text(k % 350)))).distinct()
    return J.orphan_sidecars(s, i).groupBy("stem").agg(F.count("*").alias("n"))


@query("d4_needs_processing", """WITH o AS (SELECT user_id AS image, event_type AS op, value < 3 AS success FROM events), t AS (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2)
SELECT DISTINCT user_id AS image FROM events WHERE user_id NOT IN (SELECT image FROM o WHERE success AND op IN (SELECT event_type FROM t) GROUP BY image HAVING count(DISTINCT op) = 2)""")
def d4(spark, sf_dir) -> DataFrame:
    o = X.table(spark, sf_dir, "events").selectExpr("user_id as image", "event_type as op", "value < 3 as success")
    ops = [r[0] for r in o.groupBy("op").count().orderBy("op").limit(2).collect()]
    return J.needs_processing(o.select("image").distinct(), o, ops)


@query("d7_overlap_pairs", f"""WITH {X.DETECTIONS}, p AS (SELECT a.image, a.ord AS a, b.ord AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s
  FROM detections a JOIN detections b ON a.image = b.image AND a.ord < b.ord) SELECT image, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.3""")
def d7(spark, sf_dir) -> DataFrame:
    return J.overlap_pairs(X.detections(spark, sf_dir), 0.3).withColumn("iou", F.round("iou", 6))


def _lab(df: DataFrame) -> DataFrame:
    l, a, b = C.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))  # noqa: E741
    return df.select("photo", "ord", "percentage", l.alias("l"), a.alias("a"), b.alias("bb")).withColumnRenamed("bb", "b")


_LAB = f"{X.COLORS}, lab AS (SELECT photo, ord, percentage, (r / 255.0 * 0.299 + g / 255.0 * 0.587 + b / 255.0 * 0.114) * 255 AS l, (r / 255.0 - g / 255.0) * 0.5 * 255 AS a, (r / 255.0 + g / 255.0 - b / 255.0 * 2) * 0.25 * 255 AS b FROM colors)"


@query("d6_match_team_colors", f"""WITH {_LAB}, teams AS (SELECT n_nationkey AS team, n_nationkey * 10.0 AS l, n_nationkey * 3.0 - 30 AS a, 20.0 - n_nationkey AS b FROM nation)
SELECT DISTINCT photo, team FROM lab, teams WHERE sqrt((lab.l - teams.l) * (lab.l - teams.l) + (lab.a - teams.a) * (lab.a - teams.a) + (lab.b - teams.b) * (lab.b - teams.b)) / 100 < 0.15""")
def d6(spark, sf_dir) -> DataFrame:
    teams = X.table(spark, sf_dir, "nation").selectExpr("n_nationkey as team", "n_nationkey * 10D as l", "n_nationkey * 3D - 30 as a", "20D - n_nationkey as b")
    return J.match_colors(_lab(X.colors(spark, sf_dir)), teams)


_BALLS = "balls AS (SELECT event_id AS ball_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, date_trunc('hour', ts) AS ts, user_id * 1.0 AS cx, value AS cy, CASE event_id % 4 WHEN 0 THEN 'soccer' WHEN 1 THEN 'tennis' ELSE 'unknown' END AS ball_type FROM events)"


def balls(spark, sf_dir) -> DataFrame:
    return X.table(spark, sf_dir, "events").selectExpr("event_id as ball_id", "if(user_id % 2 = 0, 'even', 'odd') as source", "date_trunc('hour', cast(ts as timestamp)) as ts", "user_id * 1D as cx", "value as cy", "case event_id % 4 when 0 then 'soccer' when 1 then 'tennis' else 'unknown' end as ball_type")


TRACK_SQL = f"""WITH RECURSIVE {_BALLS}, f AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY ts) AS frame FROM balls),
d AS (SELECT c.ball_id, p.ball_id AS prev_id, c.cx - p.cx AS dx, c.cy - p.cy AS dy, sqrt((c.cx - p.cx) * (c.cx - p.cx) + (c.cy - p.cy) * (c.cy - p.cy)) AS dist FROM f c JOIN f p ON c.source = p.source AND c.frame = p.frame + 1),
m AS (SELECT ball_id, arg_min(prev_id, (dist, prev_id)) AS prev_id, arg_min(dx, (dist, prev_id)) AS dx, arg_min(dy, (dist, prev_id)) AS dy FROM d WHERE dist < 50 GROUP BY ball_id)"""


@query("d8_track_nearest_previous", f"{TRACK_SQL} SELECT ball_id, coalesce(prev_id, -1) AS prev_id, round(coalesce(dx, 0), 6) AS dx, round(coalesce(dy, 0), 6) AS dy FROM f LEFT JOIN m USING (ball_id)")
def d8(spark, sf_dir) -> DataFrame:
    t = J.track_nearest(balls(spark, sf_dir))
    return t.select("ball_id", F.coalesce("prev_id", F.lit(-1)).alias("prev_id"), F.round(F.coalesce("dx", F.lit(0.0)), 6).alias("dx"), F.round(F.coalesce("dy", F.lit(0.0)), 6).alias("dy"))


TYPES_SQL = """r AS (SELECT ball_id, ball_type AS t, frame FROM f WHERE ball_id NOT IN (SELECT ball_id FROM m)
 UNION ALL SELECT m.ball_id, CASE WHEN r.t <> 'unknown' THEN r.t ELSE f.ball_type END, f.frame FROM r JOIN m ON m.prev_id = r.ball_id JOIN f ON f.ball_id = m.ball_id)"""


@query("d8_inherited_types", f"{TRACK_SQL}, {TYPES_SQL} SELECT ball_id, t AS tracked_type FROM r")
def d8b(spark, sf_dir) -> DataFrame:
    return J.inherit_types(J.track_nearest(balls(spark, sf_dir))).select("ball_id", "tracked_type")


@query("d9_speed_from_motion", f"{TRACK_SQL} SELECT ball_id, round(sqrt(dx * dx + dy * dy), 6) AS speed FROM m")
def d9(spark, sf_dir) -> DataFrame:
    t = J.track_nearest(balls(spark, sf_dir)).where("prev_id is not null")
    return t.select("ball_id", F.round(J.speed(F.col("dx"), F.col("dy")), 6).alias("speed"))


@query("d10_join_poses", "SELECT o_orderkey AS image, count(l_orderkey) AS poses FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def d10(spark, sf_dir) -> DataFrame:
    return R.join_poses(*_posed(spark, sf_dir))


def _posed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")), X.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image"))


@query("d10_images_without_poses", "SELECT o_orderkey AS image FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def d10_without(spark, sf_dir) -> DataFrame:
    return R.images_without_poses(*_posed(spark, sf_dir))


@query("d11_unified_results", """WITH f AS (SELECT user_id AS image, bool_or(value < 3) AS s, sum(event_id % 6) AS n FROM events WHERE event_id % 2 = 0 AND user_id % 3 > 0 GROUP BY 1), o AS (SELECT user_id AS image, bool_or(value < 5) AS s, sum(event_id % 4) AS n FROM events WHERE event_id % 2 = 1 AND user_id % 5 > 0 GROUP BY 1)
SELECT coalesce(f.image, o.image) AS image, CAST(coalesce(f.n, 0) AS BIGINT) AS faces, CAST(coalesce(o.n, 0) AS BIGINT) AS objects, coalesce(f.s, false) OR coalesce(o.s, false) AS success FROM f FULL JOIN o ON f.image = o.image""")
def d11(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    f = e.where("event_id % 2 = 0 and user_id % 3 > 0").selectExpr("user_id as image", "value < 3 as success", "event_id % 6 as n")
    o = e.where("event_id % 2 = 1 and user_id % 5 > 0").selectExpr("user_id as image", "value < 5 as success", "event_id % 4 as n")
    return J.unified_results(f, o)


@query("f25_unified_totals", "SELECT count(DISTINCT user_id) AS images, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id % 6 ELSE 0 END) AS BIGINT) AS faces, CAST(sum(CASE WHEN event_id % 2 = 1 THEN event_id % 4 ELSE 0 END) AS BIGINT) AS objects FROM events")
def f25(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    u = J.unified_results(e.where("event_id % 2 = 0").selectExpr("user_id as image", "true as success", "event_id % 6 as n"), e.where("event_id % 2 = 1").selectExpr("user_id as image", "true as success", "event_id % 4 as n"))
    return u.agg(F.count("*").alias("images"), F.sum("faces").alias("faces"), F.sum("objects").alias("objects"))


@query("d12_merge_sidecars", "SELECT user_id AS image, event_type AS op, min(event_id) AS created_at, max(event_id) AS last_updated, arg_max(props, event_id) AS payload FROM events GROUP BY 1, 2")
def d12(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events").selectExpr("user_id as image", "event_type as op", "event_id as version", "props as payload")
    m = J.merge_operations(e.where("version % 2 = 0"), e.where("version % 2 = 1"), ["image", "op"])
    return m.select("image", "op", "created_at", "last_updated", "payload")


@query("d12_merge_documents", """WITH e AS (SELECT user_id AS image, event_type AS op, event_id AS id, CASE WHEN event_id % 5 <> 1 THEN 'b' || event_id % 3 END AS backend FROM events),
old AS (SELECT image, op, max(id) AS v FROM e WHERE id % 2 = 0 AND image % 3 > 0 GROUP BY 1, 2), new AS (SELECT * FROM e WHERE id % 2 = 1),
w AS (SELECT image, op, max(id) AS w FROM new WHERE backend IS NULL GROUP BY 1, 2),
n AS (SELECT image, op, backend, max(id) AS v FROM new LEFT JOIN w USING (image, op) WHERE backend IS NOT NULL AND (w IS NULL OR id > w) GROUP BY 1, 2, 3),
k AS (SELECT image, op FROM old UNION SELECT image, op FROM new),
p AS (SELECT image, op, backend AS k, '{"v":' || v || '}' AS j FROM n UNION ALL SELECT image, op, 'v', CAST(coalesce(w, v) AS VARCHAR) FROM k LEFT JOIN old USING (image, op) LEFT JOIN w USING (image, op) WHERE coalesce(w, v) IS NOT NULL),
d AS (SELECT image, op, '{' || string_agg('"' || k || '":' || j, ',' ORDER BY k) || '}' AS j FROM p GROUP BY 1, 2
  UNION ALL SELECT image, 'sidecar_info', CASE WHEN o.f IS NULL THEN '{"created_at":"' || n.f || '","last_operation":"' || n.op || '","last_updated":"' || n.l || '","operation_type":"' || n.fop || '"}'
    WHEN n.l IS NULL THEN '{"created_at":"t' || o.f || '","image_path":"p' || image || '"}' ELSE '{"created_at":"t' || o.f || '","image_path":"p' || image || '","last_operation":"' || n.op || '","last_updated":"' || n.l || '"}' END
  FROM (SELECT image, min(id) AS f FROM e WHERE id % 2 = 0 AND image % 3 > 0 GROUP BY 1) o FULL JOIN (SELECT image, min(id) AS f, max(id) AS l, arg_max(op, id) AS op, arg_min(op, id) AS fop FROM new GROUP BY 1) n USING (image))
SELECT image, '{' || string_agg('"' || op || '":' || j, ',' ORDER BY op) || '}' AS doc FROM d GROUP BY image""")
def d12_documents(spark, sf_dir) -> DataFrame:
    """Results put into documents of two thirds of the users; some results belong to a backend of their operation."""
    e = X.table(spark, sf_dir, "events").selectExpr("user_id as image", "event_type as op", "event_id as at", "if(event_id % 5 <> 1, concat('b', event_id % 3), null) as backend", "concat('{\"v\":', event_id, '}') as payload")
    old = e.where("at % 2 = 0 and image % 3 > 0")
    part = F.concat(F.lit('"'), "op", F.lit('":{"v":'), F.max("at").cast("string"), F.lit("}"))
    parts = old.groupBy("image", "op").agg(part.alias("p"), F.min("at").alias("first")).groupBy("image").agg(F.concat_ws(",", F.collect_list("p")).alias("p"), F.min("first").alias("first"))
    info = F.concat(F.lit(',"sidecar_info":{"created_at":"t'), F.col("first").cast("string"), F.lit('","image_path":"p'), F.col("image").cast("string"), F.lit('"}}'))
    return S.merge_documents(parts.select("image", F.concat(F.lit("{"), "p", info).alias("doc")), e.where("at % 2 = 1"))


@query("b33_any_depth", "SELECT event_id AS image, CASE WHEN event_id % 9 = 0 OR event_id % 5 > 0 THEN event_id % 5 ELSE 2 END AS n, CASE WHEN event_id % 7 > 0 THEN 'deep' ELSE 'none' END AS tool FROM events")
def b33_any_depth(spark, sf_dir) -> DataFrame:
    """Counts up to 8 objects down, beside a list one down; names of tools up to 6 down."""
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("image"))
    wrap = lambda key, n, inner: F.concat(F.repeat(F.lit(f'{{"{key}":'), n.cast("int")), inner, F.repeat(F.lit("}"), n.cast("int")))
    count = wrap("data", F.col("image") % 9, F.concat(F.lit('{"count":'), (F.col("image") % 5).cast("string"), F.lit("}")))
    named = wrap("metadata", F.col("image") % 7, F.lit('{"model":"deep"}'))
    inside = F.regexp_extract(count, r"^\{(.*)\}$", 1)
    docs = e.select("image", F.concat(F.lit("{"), inside, F.lit(',"result":{"objects":[1,2]}'), F.when(F.col("image") % 7 > 0, F.concat(F.lit(',"metadata":'), named)).otherwise(""), F.lit("}")).alias("doc"))
    return S.detection_counts(docs).join(S.tool_names(docs), "image").select("image", "n", F.coalesce("tool", F.lit("none")).alias("tool"))


@query("b34_any_depth", "SELECT event_id AS image, event_type = 'click' AS has FROM events")
def b34_any_depth(spark, sf_dir) -> DataFrame:
    """Operations up to 8 objects down, as a key or as the type."""
    e = X.table(spark, sf_dir, "events")
    n = (F.col("event_id") % 9).cast("int")
    inner = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"'), "event_type", F.lit('":1}'))).otherwise(F.concat(F.lit('{"sidecar_info":{"operation_type":"'), "event_type", F.lit('"}}')))
    doc = F.concat(F.repeat(F.when(F.col("event_id") % 4 > 1, F.lit('{"data":')).otherwise('{"result":'), n), inner, F.repeat(F.lit("}"), n))
    return S.with_operation(e.select(F.col("event_id").alias("image"), doc.alias("doc")), "click")


@query("d13_image_for_legacy_json", "SELECT c_custkey AS json, CASE WHEN c_nationkey % 2 = 0 THEN lower(n_name) || CASE WHEN c_nationkey % 4 = 0 THEN '.jpeg' ELSE '.jpg' END ELSE 'none' END AS image FROM customer JOIN nation ON n_nationkey = c_nationkey")
def d13(spark, sf_dir) -> DataFrame:
    n = X.table(spark, sf_dir, "nation")
    c = X.table(spark, sf_dir, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("json"), F.lower("n_name").alias("stem"))
    kinds = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("png"), F.lit("jpeg"))).otherwise(F.array(F.lit("jpg")))
    images = n.where("n_nationkey % 2 = 0").select(F.upper("n_name").alias("stem"), F.explode(kinds).alias("ext"))
    return R.image_for_legacy_json(c, images).select("json", F.coalesce("image", F.lit("none")).alias("image"))


# ---- filters

@query("c1_filter_faces", f"WITH {X.DETECTIONS} SELECT image, ord FROM detections WHERE w >= 64 AND h >= 64 AND confidence >= 0.5")
def c1(spark, sf_dir) -> DataFrame:
    return R.filter_faces(X.detections(spark, sf_dir)).select("image", "ord")


@query("c2_enforce_face_bounds", f"""WITH {X.DETECTIONS}, n AS (SELECT image, ord, count(*) OVER (PARTITION BY image) AS c, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, ord) AS k FROM detections),
a AS (SELECT o_orderkey AS image, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT image, ord, CAST(NULL AS VARCHAR) AS error FROM n WHERE c >= 2 AND k <= 3 UNION ALL SELECT image, NULL, 'Not enough faces detected (found ' || c || ', required 2)' FROM a WHERE c < 2""")
def c2(spark, sf_dir) -> DataFrame:
    images = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"))
    kept, failed = R.enforce_face_bounds(X.detections(spark, sf_dir), images, 2, 3)
    return kept.select("image", "ord", F.lit(None).cast("string").alias("error")).unionByName(failed.select("image", F.lit(None).cast("long").alias("ord"), "error"))


@query("c5_filter_size", f"WITH {X.DETECTIONS} SELECT image, ord FROM detections WHERE w BETWEEN 32 AND 50 AND h BETWEEN 32 AND 50")
def c5(spark, sf_dir) -> DataFrame:
    return R.filter_size(X.detections(spark, sf_dir), 32, 50).select("image", "ord")


@query("c7_filter_image_size", "SELECT p_partkey FROM part WHERE p_size * 60 BETWEEN 100 AND 2000 AND p_retailprice BETWEEN 100 AND 8000")
def c7(spark, sf_dir) -> DataFrame:
    sized = X.table(spark, sf_dir, "part").withColumn("width", F.col("p_size") * 60)
    return R.filter_image_size(sized, height="p_retailprice", high_width=2000).select("p_partkey")


_QUALITY = "quality AS (SELECT d.doc_id AS image, (d.n_chars % 1000) / 1000.0 AS score, l.quality IS NOT NULL AS success FROM documents d LEFT JOIN labels l USING (doc_id))"


def _quality(spark, sf_dir) -> DataFrame:
    d, lab = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels")
    return d.join(lab.select("doc_id", "quality"), "doc_id", "left").selectExpr("doc_id as image", "(n_chars % 1000) / 1000D as score", "quality is not null as success")


@query("c4_filter_quality", f"WITH {_QUALITY} SELECT image, 'range' AS list FROM quality WHERE success AND score BETWEEN 0.2 AND 0.5 UNION ALL SELECT image, 'low' FROM quality WHERE success AND score < 0.5")
def c4(spark, sf_dir) -> DataFrame:
    q = _quality(spark, sf_dir)
    return R.filter_quality(q, 0.2, 0.5).select("image", F.lit("range").alias("list")).unionByName(R.low_quality(q).select("image", F.lit("low").alias("list")))


_GR = "CASE WHEN score >= 0.85 THEN 'A' WHEN score >= 0.70 THEN 'B' WHEN score >= 0.55 THEN 'C' WHEN score >= 0.40 THEN 'D' ELSE 'F' END"


@query("f11_grade_distribution", f"WITH {_QUALITY} SELECT {_GR} AS grade, count(*) AS n, round(avg(score), 6) AS avg_score, round(avg(CAST(success AS INTEGER)), 6) AS success_ratio, count(*) FILTER (score < 0.5) AS low FROM quality GROUP BY 1")
def f11(spark, sf_dir) -> DataFrame:
    return T.grade_distribution(_quality(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_score", "success_ratio")})


# ---- faces and objects inside documents

def _payloads(spark, sf_dir) -> DataFrame:
    """One operation per image: its detections as a JSON list, some without a number or an encoding."""
    d = X.detections(spark, sf_dir)
    item = F.struct(
        F.col("ord").alias("pos"), F.when(F.col("ord") % 2 == 0, F.col("ord")).alias("face_id"), "confidence", F.col("class"), F.when(F.col("ord") % 3 > 0, F.array("x", "y")).alias("encoding"),
    )
    listed = d.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("i"))
    return listed.select("image", F.to_json(F.struct(F.lit(True).alias("success"), F.col("i").alias("faces"), F.col("i").alias("objects"))).alias("payload"))


@query("a5_explode_faces", f"WITH {X.DETECTIONS} SELECT image, CAST(ord - 1 AS INTEGER) AS pos, image || ':' || CASE WHEN ord % 2 = 0 THEN ord ELSE ord - 1 END AS face_key, round(confidence, 6) AS confidence, x + y AS total FROM detections WHERE ord % 3 > 0")
def a5(spark, sf_dir) -> DataFrame:
    f = S.explode_faces(_payloads(spark, sf_dir))
    return f.select("image", "pos", "face_key", F.round("confidence", 6).alias("confidence"), (F.col("encoding")[0] + F.col("encoding")[1]).alias("total"))


@query("a6_explode_objects", f"WITH {X.DETECTIONS} SELECT image, CAST(ord - 1 AS INTEGER) AS pos, class, round(confidence, 6) AS confidence FROM detections")
def a6(spark, sf_dir) -> DataFrame:
    return S.explode_objects(_payloads(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("a7_read_legacy_faces", f"WITH {X.DETECTIONS} SELECT image, CAST(ord - 1 AS INTEGER) AS pos, CASE WHEN image % 2 = 0 THEN 'detector' ELSE 'extractor' END AS origin, CASE WHEN image % 2 = 0 THEN -1 ELSE CAST(greatest(0, trunc(x - w * 0.25)) AS BIGINT) END AS crop_x FROM detections WHERE image % 2 = 1 OR ord % 3 > 0")
def a7(spark, sf_dir) -> DataFrame:
    """Faces with encodings of the one older form, else those of the other with a crop computed from the box."""
    one = S.explode_faces(_payloads(spark, sf_dir).where("image % 2 = 0")).select("image", "pos", F.lit("detector").alias("origin"), F.lit(-1).cast("long").alias("crop_x"))
    d = X.detections(spark, sf_dir).where("image % 2 = 1")
    other = d.select("image", (F.col("ord") - 1).cast("int").alias("pos"), F.lit("extractor").alias("origin"), F.greatest(F.lit(0), (F.col("x") - F.col("w") * 0.25).cast("long")).alias("crop_x"))
    return one.unionByName(other)


@query("a7_legacy_documents", f"""WITH {X.DETECTIONS} SELECT image, CAST(ord - 1 AS INTEGER) AS pos, CASE WHEN image % 3 = 1 THEN 'extractor' ELSE 'detector' END AS origin, CAST(ord AS VARCHAR) AS face_id, CAST(trunc(x) AS BIGINT) AS x, CAST(trunc(w) AS BIGINT) AS width,
  CASE WHEN image % 3 = 1 THEN -1 ELSE ord END AS code, CASE WHEN image % 3 = 1 THEN CAST(greatest(0, trunc(x) - trunc(trunc(w) * p)) AS BIGINT) ELSE 7 END AS crop_x, CASE WHEN image % 3 = 1 THEN CAST(trunc(h) + 2 * trunc(trunc(h) * p) AS BIGINT) ELSE 9 END AS crop_height
FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 0.5 ELSE 0.25 END AS p FROM detections) WHERE image % 3 = 1 OR ord % 4 > 0""")
def a7_documents(spark, sf_dir) -> DataFrame:
    """Documents of either older form, or of both."""
    box = lambda *c: F.struct(*[F.expr(e).cast("long").alias(n) for e, n in zip(c, ("x", "y", "width", "height"), strict=True)])
    face = F.struct(
        F.col("ord").alias("face_id"), "confidence", box("x", "y", "w", "h").alias("coordinates"), F.when(F.col("ord") % 4 > 0, F.array(F.col("ord").cast("double"))).alias("face_encoding"),
        box("7", "7", "9", "9").alias("crop_area"), F.when(F.col("ord") % 2 == 0, 0.5).alias("border_padding"), F.lit(2.0).alias("detection_scale_factor"),
    )
    d = X.detections(spark, sf_dir).groupBy("image").agg(F.struct(F.sort_array(F.collect_list(face)).alias("faces")).alias("form"))
    doc = F.to_json(F.struct(F.when(F.col("image") % 3 != 1, F.col("form")).alias("Face_detector"), F.when(F.col("image") % 3 > 0, F.col("form")).alias("Face_extractor")))
    f = S.legacy_faces(d.select("image", doc.alias("doc")))
    return f.select("image", "pos", "origin", "face_id", "x", "width", F.coalesce(F.col("encoding")[0].cast("long"), F.lit(-1)).alias("code"), "crop_x", "crop_height")


@query("c8_missing_encodings", f"WITH {X.DETECTIONS} SELECT image, count(*) AS missing FROM detections WHERE ord % 3 = 0 GROUP BY image")
def c8(spark, sf_dir) -> DataFrame:
    return R.missing_encodings(S.explode_detections(_payloads(spark, sf_dir), "faces"))


@query("j4_validate_results", f"WITH {X.OPERATIONS} SELECT image, CASE WHEN success AND user_id % 7 = 0 THEN 'success without data' WHEN processing_time < 0.01 THEN 'no time' ELSE 'ok' END AS verdict FROM operations")
def j4(spark, sf_dir) -> DataFrame:
    o = X.operations(spark, sf_dir).withColumn("data", F.when(F.col("user_id") % 7 > 0, F.col("payload")))
    return R.validate_results(o, rules=[("no time", F.col("processing_time") >= 0.01)]).select("image", "verdict")


@query("j3_validation_rules", f"WITH {X.OPERATIONS} SELECT image, CASE WHEN value >= 400 THEN 'too large' WHEN user_id % 2 = 1 THEN 'odd user' WHEN processing_time < 0.5 THEN 'too fast' ELSE 'valid' END AS verdict FROM operations")
def j3(spark, sf_dir) -> DataFrame:
    @F.pandas_udf("boolean")
    def even(users):
        return users % 2 == 0

    rules = [("too large", F.col("value") < 400), ("odd user", even("user_id")), ("too fast", F.col("processing_time") >= 0.5)]
    return X.operations(spark, sf_dir).select("image", R.first_failure(rules).alias("verdict"))


@query("b39_class_name", "SELECT l_linenumber AS class_id, CASE l_linenumber WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' ELSE 'class_' || l_linenumber END AS name, count(*) AS n FROM lineitem GROUP BY 1, 2")
def b39(spark, sf_dir) -> DataFrame:
    name = R.class_name(F.col("l_linenumber"), ["person", "bicycle", "car", "motorcycle"])
    return X.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("class_id"), name.alias("name")).groupBy("class_id", "name").agg(F.count("*").alias("n"))


@query("a1_image_catalog", "SELECT 'IMG_' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.jpg' ELSE '.PNG' END AS name, CAST(strlen(c_name) AS BIGINT) AS length FROM customer")
def a1(spark, sf_dir) -> DataFrame:
    """A file per customer, in folders of which one is skipped and one holds no images, listed again."""
    from photoflow.scratch import new_path

    c = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("IMG_"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".jpg").otherwise(".PNG")).alias("name"), "c_name")
    spread = S.spread(F.col("name"))
    places = F.explode(F.array(F.concat(F.lit("day/"), spread), F.concat(F.lit("venv/"), spread), F.concat(F.lit("notes/"), spread, F.lit(".txt"))))
    root = new_path(spark, "images")
    S.write_files(c.select(places.alias("place"), "c_name"), root, "place", F.col("c_name"))
    return S.image_catalog(spark, root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


_CUSTOMER_DOC = '{"sidecar_info":{"operation_type":"face_detection"},"face_detection":{"success":true,"count":%d'


def customer_documents(spark, sf_dir) -> DataFrame:
    """(name, doc): a document per customer, every seventh cut off."""
    doc = F.concat(F.format_string(_CUSTOMER_DOC, "c_nationkey"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise("}}"))
    return X.table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".json")).alias("name"), doc.alias("doc"))


@query("a3_read_sidecars", f"SELECT c_custkey AS image, printf('{_CUSTOMER_DOC}', c_nationkey) || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '}}}}' END AS doc, c_custkey % 7 <> 0 AS valid FROM customer")
def a3(spark, sf_dir) -> DataFrame:
    """A document per customer as a file of its own, read again; broken ones stay as rows."""
    from photoflow.scratch import new_path

    root = new_path(spark, "documents")
    S.write_files(customer_documents(spark, sf_dir).withColumn("name", S.spread(F.col("name"))), root, "name", F.col("doc"))
    return S.read_sidecars(spark, root).select(F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("long").alias("image"), "doc", "valid")


@query("a13_migrate_sidecars", f"WITH {X.OPERATIONS} SELECT image, op, success FROM operations WHERE image % 97 <> 0")
def a13(spark, sf_dir) -> DataFrame:
    from photoflow.scratch import new_path

    return S.migrate_sidecars(X.sidecars(spark, sf_dir), new_path(spark, "migrated")).select("image", "op", "success")


@query("e6_number_sessions", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS game_id FROM events")
def e6(spark, sf_dir) -> DataFrame:
    from photoflow.operators.sessions import number_games

    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("start_time"), F.col("event_id").alias("end_time"))
    return number_games(e, ["user_id"]).select("user_id", "event_id", "game_id")
