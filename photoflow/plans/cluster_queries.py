"""Clusters of faces, merged boxes and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photoflow.functions import color as C
from photoflow.operators import cluster as K
from photoflow.operators import stats as T
from photoflow.plans import fixtures as X
from photoflow.plans.registry import query


#: cosine distance at which the given vectors form clusters
EPS = 0.68


def _vectors(spark, sf_dir) -> DataFrame:
    return X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"), "label")


_VEC = "vec AS (SELECT vec_id AS id, [CAST(c AS DOUBLE) FOR c IN embedding] AS v FROM embeddings)"
_FLAT = "flat AS (SELECT id, unnest(range(len(v))) AS d, unnest(v) AS x FROM vec)"


@query("g1_standardize", f"WITH {_VEC}, {_FLAT}, st AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM flat GROUP BY d) SELECT id, CAST(flat.d AS INTEGER) AS d, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS z FROM flat JOIN st ON flat.d = st.d")
def g1(spark, sf_dir) -> DataFrame:
    z = K.standardize(_vectors(spark, sf_dir).select("id", "v"))
    return z.select("id", F.posexplode("v").alias("d", "z")).withColumn("z", F.round("z", 5))


def _dbscan_sql(dist: str, eps: str, least: int) -> str:
    return f"""pairs AS (SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON a.id <> b.id AND {dist} <= {eps}),
deg AS (SELECT vec.id, count(pairs.b) + 1 AS n FROM vec LEFT JOIN pairs ON pairs.a = vec.id GROUP BY vec.id), core AS (SELECT id FROM deg WHERE n >= {least}),
r AS (SELECT id AS x, id AS y FROM core UNION SELECT r.x, p.b FROM r JOIN pairs p ON r.y = p.a JOIN core ON core.id = p.b),
comp AS (SELECT x AS id, min(y) AS comp FROM r GROUP BY x), lab AS (SELECT id, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM comp),
bor AS (SELECT p.a AS id, min(label) AS label FROM pairs p JOIN lab ON lab.id = p.b GROUP BY p.a),
final AS (SELECT vec.id, CAST(coalesce(lab.label, bor.label, -1) AS INTEGER) AS label FROM vec LEFT JOIN lab ON lab.id = vec.id LEFT JOIN bor ON bor.id = vec.id)"""


_COS = "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_EUC = "list_distance(a.v, b.v)"
_DB = f"WITH RECURSIVE {_VEC}, {_dbscan_sql(_COS, str(EPS), 4)}"


def _faces(spark, sf_dir) -> DataFrame:
    return K.dbscan(_vectors(spark, sf_dir).select("id", "v"), EPS, 4)


@query("g2_dbscan_cosine", f"{_DB} SELECT id, label FROM final")
def g2(spark, sf_dir) -> DataFrame:
    return _faces(spark, sf_dir)


@query("g3_dbscan_auto", f"""WITH RECURSIVE {_VEC}, nd AS (SELECT a.id, {_EUC} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_EUC}) AS k FROM vec a, vec b),
e AS (SELECT quantile_cont(d, 0.75) AS eps FROM nd WHERE k = 4), {_dbscan_sql(_EUC, '(SELECT eps FROM e)', 8)} SELECT id, label FROM final""")
def g3(spark, sf_dir) -> DataFrame:
    return K.dbscan_auto(_vectors(spark, sf_dir).select("id", "v"), 8)


@query("g6_assemble_clusters", f"{_DB}, s AS (SELECT label FROM final WHERE label >= 0 GROUP BY label HAVING count(*) >= 6), {_FLAT} SELECT label, CAST(d AS INTEGER) AS d, round(avg(x), 6) AS x, count(*) AS n FROM final JOIN s USING (label) JOIN flat USING (id) GROUP BY label, d")
def g6(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir).select("id", "v")
    return K.centroids(v, K.assemble_clusters(v, _faces(spark, sf_dir), 6)).withColumn("x", F.round("x", 6))


@query("g8_cluster_result", f"{_DB} SELECT count(*) AS faces, count(DISTINCT label) FILTER (label >= 0) AS clusters, count(*) FILTER (label < 0) AS unclustered, 'dbscan' AS algorithm, 'eps={EPS},min_samples=4' AS parameters FROM final")
def g8(spark, sf_dir) -> DataFrame:
    r = K.cluster_result(_faces(spark, sf_dir), "dbscan", eps=EPS, min_samples=4)
    return r.withColumn("parameters", F.array_join(F.transform(F.map_entries("parameters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("g6_cluster_members", f"{_DB}, s AS (SELECT label FROM final WHERE label >= 0 GROUP BY label HAVING count(*) >= 6) SELECT label, CAST(count(*) AS INTEGER) AS size, string_agg(id, ',' ORDER BY id) AS ids, string_agg('p' || id % 40, ',' ORDER BY id) AS paths, round(sum(id % 10) / 10.0 / count(*), 6) AS mean_confidence FROM final JOIN s USING (label) GROUP BY label")
def g6_members(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir).select("id", ((F.col("id") % 10) / 10).alias("confidence"), F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("path"))
    m = K.cluster_members(v, K.assemble_clusters(v, _faces(spark, sf_dir), 6))
    return m.select("label", "size", F.array_join("ids", ",").alias("ids"), F.array_join("paths", ",").alias("paths"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query("f23_cluster_stats", f"{_DB}, m AS (SELECT label AS cluster_id, id % 40 AS image, (id % 10) / 10.0 AS confidence FROM final WHERE label >= 0) SELECT cluster_id, count(*) AS faces, count(DISTINCT image) AS images, round(avg(confidence), 6) AS avg_confidence, round(count(*) * 1.0 / count(DISTINCT image), 6) AS faces_per_image FROM m GROUP BY cluster_id")
def f23(spark, sf_dir) -> DataFrame:
    m = _faces(spark, sf_dir).selectExpr("label as cluster_id", "id % 40 as image", "(id % 10) / 10D as confidence")
    return T.cluster_stats(m).withColumns({c: F.round(c, 6) for c in ("avg_confidence", "faces_per_image")})


@query("h5_sort_clusters", f"{_DB}, c AS (SELECT label, count(*) AS n FROM final WHERE label >= 0 GROUP BY label) SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS place FROM c")
def h5(spark, sf_dir) -> DataFrame:
    return K.sort_clusters(_faces(spark, sf_dir))


@query("g7_identical_guard", "SELECT count(DISTINCT embedding) = 1 AND count(*) > 1 AS identical FROM embeddings")
def g7(spark, sf_dir) -> DataFrame:
    return K.all_identical(_vectors(spark, sf_dir))


@query("g4_kmeans_faces")
def g4(spark, sf_dir) -> DataFrame:
    return K.kmeans_faces(_vectors(spark, sf_dir).select("id", "v"), 25)


@query("g4_kmeans_faces_v1")
def g4_v1(spark, sf_dir) -> DataFrame:
    return K.kmeans_faces(_vectors(spark, sf_dir).select("id", "v"), 25, most=50)


@query("g5_hierarchical_faces")
def g5(spark, sf_dir) -> DataFrame:
    return K.hierarchical_faces(_vectors(spark, sf_dir).select("id", "v"), 25)


@query("g5_ward_faces")
def g5_ward(spark, sf_dir) -> DataFrame:
    return K.hierarchical_faces(_vectors(spark, sf_dir).select("id", "v"), 25, "ward", 50)


_IOU_PAIRS = """iou AS (SELECT a.image, a.{o} AS a, b.{o} AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM {t} a JOIN {t} b ON a.image = b.image AND a.{o} < b.{o}),
nb AS (SELECT image, b AS ord, list(a) AS nb FROM iou WHERE i / (s - i) {test} GROUP BY image, b), it AS (SELECT d.image, d.{o} AS ord, nb FROM {t} d LEFT JOIN nb ON nb.image = d.image AND nb.ord = d.{o}),
r AS (SELECT DISTINCT image, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders FROM {t} UNION ALL SELECT r.image, it.ord, CASE WHEN it.nb IS NOT NULL AND list_has_any(r.leaders, it.nb) THEN r.leaders ELSE list_append(r.leaders, it.ord) END FROM r JOIN it ON it.image = r.image AND it.ord = r.k + 1),
fin AS (SELECT image, arg_max(leaders, k) AS leaders FROM r GROUP BY image), asg AS (SELECT it.image, it.ord, coalesce(list_min(list_intersect(fin.leaders, it.nb)), it.ord) AS leader FROM it JOIN fin USING (image))"""
_GREEDY = f"WITH RECURSIVE {X.DETECTIONS}, {_IOU_PAIRS.format(o='ord', t='detections', test='>= 0.3')}"


def _led(spark, sf_dir) -> DataFrame:
    return K.overlap_leaders(X.detections(spark, sf_dir), 0.3)


@query("g9_greedy_leaders", f"{_GREEDY} SELECT image, ord, leader FROM asg")
def g9(spark, sf_dir) -> DataFrame:
    return _led(spark, sf_dir).select("image", "ord", "leader")


_RECON = f"{_GREEDY}, rec AS (SELECT image, leader, CASE WHEN count(*) = 1 THEN any_value(x) ELSE trunc(sum(x * confidence) / sum(confidence)) END AS x, CASE WHEN count(*) = 1 THEN any_value(w) ELSE trunc(sum(w * confidence) / sum(confidence)) END AS w, avg(confidence) AS c, count(*) AS detections, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM asg JOIN detections USING (image, ord) GROUP BY image, leader HAVING round(avg(confidence), 9) >= 0.5)"


def _reconciled(spark, sf_dir) -> DataFrame:
    return K.reconcile(_led(spark, sf_dir), None, 0.5 - 5e-10)


@query("g10_reconcile_faces", f"{_RECON} SELECT image, leader, round(c, 6) AS confidence, detections, methods FROM rec")
def g10(spark, sf_dir) -> DataFrame:
    return _reconciled(spark, sf_dir).select("image", "leader", F.round("mean_confidence", 6).alias("confidence"), "detections", F.array_join("methods", ",").alias("methods"))


@query("f15_multires_summary", f"{_RECON} SELECT detections, count(*) AS faces, round(count(*) * 1.0 / (SELECT count(*) FROM detections), 6) AS share FROM rec GROUP BY detections")
def f15(spark, sf_dir) -> DataFrame:
    n = X.detections(spark, sf_dir).count()
    return _reconciled(spark, sf_dir).groupBy("detections").agg(F.count("*").alias("faces"), F.round(F.count("*") / F.lit(n), 6).alias("share"))


@query("f15_multires_totals", f"{_RECON} SELECT (SELECT count(DISTINCT image) FROM detections) AS images, (SELECT count(*) FROM detections) AS detections, count(*) AS reconciled, round(count(*) * 100.0 / (SELECT count(*) FROM detections), 6) AS reconciliation_pct FROM rec")
def f15_totals(spark, sf_dir) -> DataFrame:
    return T.multires_totals(X.detections(spark, sf_dir), _reconciled(spark, sf_dir)).withColumn("reconciliation_pct", F.round("reconciliation_pct", 6))


@query("f15_multires_by_resolution", f"WITH {X.DETECTIONS} SELECT resolution, count(*) AS detections, count(DISTINCT image) AS images, round(count(*) * 1.0 / count(DISTINCT image), 6) AS per_image FROM detections GROUP BY resolution")
def f15_by_resolution(spark, sf_dir) -> DataFrame:
    return T.multires_by_resolution(X.detections(spark, sf_dir)).withColumn("per_image", F.round("per_image", 6))


@query("f15_multires_methods", f"{_RECON} SELECT unnest(string_split(methods, ',')) AS method, count(*) AS faces FROM rec GROUP BY 1")
def f15_methods(spark, sf_dir) -> DataFrame:
    return T.multires_methods(_reconciled(spark, sf_dir))


@query("g11_nms", f"WITH RECURSIVE {X.DETECTIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, ord) AS rk FROM detections), {_IOU_PAIRS.format(o='rk', t='ranked', test='> 0.5')} SELECT ranked.image, ranked.ord FROM asg JOIN ranked ON ranked.image = asg.image AND ranked.rk = asg.ord WHERE asg.leader = asg.ord")
def g11(spark, sf_dir) -> DataFrame:
    d = X.detections(spark, sf_dir).withColumn("rk", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("confidence"), "ord")).cast("long"))
    ranked = d.withColumn("box", F.col("ord")).withColumn("ord", F.col("rk"))
    return K.overlap_leaders(ranked, 0.5, strict=True).where("leader = ord").select("image", F.col("box").alias("ord"))


# teams: few distinct shades, so that groups form
_SHADES = """shades AS (SELECT l_orderkey % 3000 AS photo, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS seq,
  CAST(l_partkey % 8 * 12 AS INTEGER) AS r, CAST(l_suppkey % 8 * 14 AS INTEGER) AS g, CAST(l_linenumber * 12 AS INTEGER) AS b, l_discount * 10 AS percentage FROM lineitem),
lab AS (SELECT *, (r / 255.0 * 0.299 + g / 255.0 * 0.587 + b / 255.0 * 0.114) * 255 AS l, (r / 255.0 - g / 255.0) * 0.5 * 255 AS a, (r / 255.0 + g / 255.0 - b / 255.0 * 2) * 0.25 * 255 AS bb FROM shades)"""


def _shades(spark, sf_dir) -> DataFrame:
    """Colours of every photo, one row for n equal ones of a percentage; seq is the place of the first such one in all photos."""
    from photoflow.operators.graph import running_total
    from photoflow.scratch import materialize

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    kind = ["r", "g", "b", "percentage"]
    t = X.table(spark, sf_dir, "lineitem").selectExpr(*order, "l_orderkey % 3000 as photo", "cast(l_partkey % 8 * 12 as int) as r", "cast(l_suppkey % 8 * 14 as int) as g", "cast(l_linenumber * 12 as int) as b", "l_discount * 10 as percentage")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in kind]
    # the first of each kind: by the leading column of the order, then among the few that share it
    low = materialize(t.groupBy(*kind).agg(F.min("l_orderkey").alias("k")), "colour-kinds")
    few = t.alias("t").join(low.alias("k"), same("t", "k")).where(F.col("t.l_orderkey").eqNullSafe(F.col("k.k"))).select("t.*")
    first = few.groupBy(*kind).agg(F.min(F.struct(*order)).alias("o")).select(*kind, "o.*", F.lit(1).alias("one"))
    placed = materialize(running_total(first, order, {"seq": "one"}, "colors").select(*kind, (F.col("seq") + 1).alias("seq")), "placed-colours")
    c = t.groupBy("photo", *kind).agg(F.count("*").alias("n")).alias("c").join(placed.alias("p"), same("c", "p")).select("c.*", "p.seq")
    l, a, b = C.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))  # noqa: E741
    return materialize(c.withColumns({"l": l, "a": a, "bb": b, "ord": F.col("seq")}), "colours-of-photos")


_TEAMS = f"""WITH RECURSIVE {_SHADES}, u AS (SELECT l, a, bb, min(seq) AS ord0 FROM lab GROUP BY l, a, bb), v AS (SELECT *, CAST(row_number() OVER (ORDER BY ord0) AS BIGINT) AS ord FROM u),
nb AS (SELECT y.ord, list(x.ord) AS nb FROM v x JOIN v y ON x.ord < y.ord AND sqrt((x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.bb - y.bb) * (x.bb - y.bb)) / 100 < 0.15 GROUP BY y.ord), it AS (SELECT v.ord, nb FROM v LEFT JOIN nb USING (ord)),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT it.ord, CASE WHEN it.nb IS NOT NULL AND list_has_any(r.leaders, it.nb) THEN r.leaders ELSE list_append(r.leaders, it.ord) END FROM r JOIN it ON it.ord = r.k + 1),
fin AS (SELECT arg_max(leaders, k) AS leaders FROM r), asg AS (SELECT it.ord, coalesce(list_min(list_intersect(fin.leaders, it.nb)), it.ord) AS leader FROM it, fin),
mem AS (SELECT v.l, v.a, v.bb, dense_rank() OVER (ORDER BY leader) AS no FROM v JOIN asg USING (ord)),
grp AS (SELECT lab.*, no FROM lab JOIN mem USING (l, a, bb)),
top AS (SELECT no, count(*) AS colors, arg_max({{'r': r, 'g': g, 'b': b, 'l': l, 'a': a, 'bb': bb}}, (percentage, -seq)) AS t FROM grp GROUP BY no HAVING count(*) >= 5),
met AS (SELECT DISTINCT photo, no FROM lab, top WHERE sqrt((lab.l - t.l) * (lab.l - t.l) + (lab.a - t.a) * (lab.a - t.a) + (lab.bb - t.bb) * (lab.bb - t.bb)) / 100 < 0.15),
teams AS (SELECT no, colors, t, (SELECT count(*) FROM met WHERE met.no = top.no) AS photos, 'Team_' || no || '_' || coalesce(CASE
   WHEN t.r > t.g AND t.r > t.b THEN CASE WHEN t.r > 200 AND t.g < 100 AND t.b < 100 THEN 'Red' WHEN t.r > 150 AND t.g > 100 AND t.b < 100 THEN 'Orange' END
   WHEN t.g > t.r AND t.g > t.b THEN CASE WHEN t.g > 200 AND t.r < 100 AND t.b < 100 THEN 'Green' WHEN t.g > 150 AND t.r > 100 AND t.b < 100 THEN 'Yellow' END
   WHEN t.b > t.r AND t.b > t.g THEN CASE WHEN t.b > 200 AND t.r < 100 AND t.g < 100 THEN 'Blue' WHEN t.b > 150 AND t.r > 100 AND t.g < 100 THEN 'Purple' END
   WHEN t.r > 200 AND t.g > 200 AND t.b > 200 THEN 'White' WHEN t.r < 50 AND t.g < 50 AND t.b < 50 THEN 'Black' END, 'RGB_' || t.r || '_' || t.g || '_' || t.b) AS name FROM top)"""


@query("g13_team_groups", f"{_TEAMS} SELECT name, colors, photos FROM teams WHERE photos >= 5")
def g13(spark, sf_dir) -> DataFrame:
    return K.team_groups(_shades(spark, sf_dir))[0].select("name", "colors", "photos")


@query("g14_team_confidence", f"""{_TEAMS}, m AS (SELECT no, avg(l) AS ml, avg(a) AS ma, avg(bb) AS mb, count(*) AS n FROM grp GROUP BY no), d AS (SELECT no, n, avg(sqrt((l - ml) * (l - ml) + (a - ma) * (a - ma) + (bb - mb) * (bb - mb))) AS dist FROM grp JOIN m USING (no) GROUP BY no, n)
SELECT name, round(least(1, (1 - (n - 1) / greatest(n, 10)) * 0.6 + (1 - least(dist / 50, 1)) * 0.4), 6) AS confidence FROM d JOIN teams USING (no) WHERE photos >= 5""")
def g14(spark, sf_dir) -> DataFrame:
    colors = _shades(spark, sf_dir)
    teams, _ = K.team_groups(colors)
    return K.team_members_confidence(colors, teams).withColumn("confidence", F.round("confidence", 6))


_SEP = "sep AS (SELECT x.photo, least(avg(sqrt((x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.bb - y.bb) * (x.bb - y.bb)) / 100) / 0.15, 1) AS separation FROM lab x JOIN lab y ON x.photo = y.photo AND x.seq < y.seq GROUP BY x.photo)"


@query("g16_color_separation", f"WITH {_SHADES}, {_SEP} SELECT photo, round(separation, 6) AS separation FROM sep")
def g16(spark, sf_dir) -> DataFrame:
    return K.color_separation(_shades(spark, sf_dir)).withColumn("separation", F.round("separation", 6))


_DECISIONS = f"""{_TEAMS}, {_SEP}, nm AS (SELECT photo, string_agg(name, ', ' ORDER BY no) AS teams, count(*) AS n FROM met JOIN teams USING (no) WHERE photos >= 5 GROUP BY photo),
dec AS (SELECT p.photo, coalesce(nm.teams, '') AS teams, coalesce(n, 0) AS n_teams, coalesce(n, 0) > 1 AS should_split, least(1, 0.5 + CASE WHEN coalesce(n, 0) > 1 THEN least(n / 3, 0.3) ELSE 0 END + coalesce(separation, 0) * 0.2) AS confidence,
 CASE WHEN coalesce(n, 0) = 0 THEN 'No teams matched to jersey colors' WHEN n = 1 THEN 'Single team detected: ' || teams ELSE 'Multiple teams detected: ' || teams || ' - should split' END AS reason FROM (SELECT DISTINCT photo FROM lab) p LEFT JOIN nm USING (photo) LEFT JOIN sep USING (photo))"""


def _decisions(spark, sf_dir) -> DataFrame:
    colors = _shades(spark, sf_dir)
    teams, met = K.team_groups(colors)
    photos = colors.groupBy("photo").agg(F.sum("n").alias("colors"))
    return K.split_decisions(photos, K.color_separation(colors), met, teams)


@query("g15_split_decisions", f"{_DECISIONS} SELECT photo, teams, CAST(n_teams AS INTEGER) AS n_teams, should_split, round(confidence, 6) AS confidence, reason FROM dec")
def g15(spark, sf_dir) -> DataFrame:
    return _decisions(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query("f19_split_summary", f"{_DECISIONS} SELECT count(*) AS photos, count(*) FILTER (n_teams = 0) AS no_team, count(*) FILTER (n_teams = 1) AS one_team, count(*) FILTER (n_teams > 1) AS several_teams, count(*) FILTER (should_split) AS split, round(avg(confidence), 6) AS avg_confidence, (SELECT string_agg(DISTINCT name, ', ' ORDER BY name) FROM met JOIN teams USING (no) WHERE photos >= 5) AS team_list FROM dec")
def f19(spark, sf_dir) -> DataFrame:
    return T.split_summary(_decisions(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("a10_team_layout", f"{_DECISIONS} SELECT CASE WHEN n_teams = 0 THEN 'NoTeam' WHEN n_teams > 1 THEN 'MultiTeam' ELSE teams END AS folder, count(*) AS placed FROM dec GROUP BY 1")
def a10_teams(spark, sf_dir) -> DataFrame:
    """Manifests of photos by team, written, and the number of photos in each."""
    from photoflow.scratch import new_path
    from photoflow.sources.sidecars import team_folder, write_layout

    d = _decisions(spark, sf_dir).select("photo", F.when(F.col("n_teams") > 0, F.split("teams", ", ", -1)).alias("teams"))
    return write_layout(d, new_path(spark, "layout"), [team_folder(F.col("teams"))])


@query("g12_dominant_colors")
def g12(spark, sf_dir) -> DataFrame:
    return K.dominant_colors(X.colors(spark, sf_dir).selectExpr("photo % 200 as image", "r", "g", "b"), k=5)


@query("g12_dominant_colors_lab")
def g12_lab(spark, sf_dir) -> DataFrame:
    return K.dominant_colors(X.colors(spark, sf_dir).selectExpr("photo % 200 as image", "r", "g", "b"), k=5, color_space="lab")


@query("b11_lab_distance", f"WITH {X.COLORS}, lab AS (SELECT photo, ord, (r / 255.0 * 0.299 + g / 255.0 * 0.587 + b / 255.0 * 0.114) * 255 AS l, (r / 255.0 - g / 255.0) * 0.5 * 255 AS a, (r / 255.0 + g / 255.0 - b / 255.0 * 2) * 0.25 * 255 AS bb FROM colors) SELECT x.photo, x.ord, round(sqrt((x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.bb - y.bb) * (x.bb - y.bb)) / 100, 6) AS d FROM lab x JOIN lab y ON x.photo = y.photo AND y.ord = x.ord + 1")
def b11(spark, sf_dir) -> DataFrame:
    l, a, b = C.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))  # noqa: E741
    t = X.colors(spark, sf_dir).select("photo", "ord", l.alias("l"), a.alias("a"), b.alias("bb"))
    y = t.select("photo", (F.col("ord") - 1).alias("ord"), F.col("l").alias("l2"), F.col("a").alias("a2"), F.col("bb").alias("b2"))
    return t.join(y, ["photo", "ord"]).select("photo", "ord", F.round(C.lab_distance((F.col("l"), F.col("a"), F.col("bb")), (F.col("l2"), F.col("a2"), F.col("b2"))), 6).alias("d"))


@query("b7_iou", f"WITH {X.DETECTIONS}, p AS (SELECT a.image, a.ord, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM detections a JOIN detections b ON a.image = b.image AND b.ord = a.ord + 1) SELECT image, ord, round(i / (s - i), 6) AS iou FROM p")
def b7(spark, sf_dir) -> DataFrame:
    from photoflow.functions import geometry as G

    d = X.detections(spark, sf_dir)
    n = d.select("image", (F.col("ord") - 1).alias("ord"), *[F.col(c).alias(f"n{c}") for c in ("x", "y", "w", "h")])
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x", "y", "w", "h"))
    return d.join(n, ["image", "ord"]).select("image", "ord", F.round(G.iou(box(""), box("n")), 6).alias("iou"))
