"""Scalar expressions over boxes, colours, quality measures and poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.functions import color as C
from photoflow.functions import geometry as G
from photoflow.functions import pose as P
from photoflow.functions import quality as Q
from photoflow.plans import fixtures as X
from photoflow.plans.registry import query

W, H = 1920, 1080


def _expressions(name: str, base: str, build, keys: list[str], columns: dict[str, tuple]) -> None:
    """Register a query of key columns and (Spark expression factory, SQL) pairs over one fixture; doubles are rounded."""
    sql_cols = ", ".join([*keys, *[f"{sql} AS {c}" for c, (_, sql) in columns.items()]])

    @query(name, f"WITH {base} SELECT {sql_cols} FROM t")
    def run(spark, sf_dir) -> DataFrame:
        df = build(spark, sf_dir)
        return df.select(*keys, *[make().alias(c) for c, (make, _) in columns.items()])


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _box() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("x", "y", "w", "h"))


_DET = f"{X.DETECTIONS}, t AS (SELECT * FROM detections)"
_KEYS = ["image", "ord"]


def _det(spark, sf_dir):
    return X.detections(spark, sf_dir)


def _w():
    return F.lit(W)


def _h():
    return F.lit(H)


_expressions("b3_bbox_to_ratio", _DET, _det, _KEYS, {f"r{c}": (lambda k=k: _r(G.bbox_to_ratio(_box(), _w(), _h())[k]), f"round({c} / {n}, 6)") for k, (c, n) in enumerate(zip("xywh", (W, H, W, H), strict=True))})

_S = "least(1920 / (1000.0 + x * 50), 1080 / (800.0 + y * 40), 1.0)"
_expressions("b4_rescale_bbox", _DET, _det, _KEYS, {
    c: (lambda k=k: G.rescale_bbox(_box(), F.lit(1000.0) + F.col("x") * 50, F.lit(800.0) + F.col("y") * 40)[k], sql)
    for k, (c, sql) in enumerate({
        "ox": f"CAST(trunc(x / {_S}) AS BIGINT)", "oy": f"CAST(trunc(y / {_S}) AS BIGINT)", "ow": f"CAST(trunc((x + w) / {_S}) AS BIGINT) - CAST(trunc(x / {_S}) AS BIGINT)", "oh": f"CAST(trunc((y + h) / {_S}) AS BIGINT) - CAST(trunc(y / {_S}) AS BIGINT)",
    }.items())
})

_UX, _UY = "greatest(0, least(CAST(trunc((x - 10) / 0.5) AS BIGINT), 59))", "greatest(0, least(CAST(trunc((y - 5) / 0.5) AS BIGINT), 79))"
_expressions("b4b_unletterbox", _DET, _det, _KEYS, {
    c: (lambda k=k: G.unletterbox(_box(), F.lit(0.5), F.lit(10), F.lit(5), F.lit(60), F.lit(80))[k].cast("long"), f"CAST({sql} AS BIGINT)")
    for k, (c, sql) in enumerate({"ux": _UX, "uy": _UY, "uw": f"least(CAST(trunc(w / 0.5) AS BIGINT), 60 - {_UX})", "uh": f"least(CAST(trunc(h / 0.5) AS BIGINT), 80 - {_UY})"}.items())
})

_expressions("b5_crop_box", _DET, _det, _KEYS, {
    **{c: (lambda k=k: _r(G.crop_percent(G.bbox_to_ratio(_box(), F.lit(100), F.lit(100)))[k]), f"round({sql}, 6)") for k, (c, sql) in enumerate({
        "cx1": "greatest(0, x / 100 - w / 100 * 0.25)", "cy1": "greatest(0, y / 100 - h / 100 * 0.25)", "cx2": "least(1, x / 100 + w / 100 + w / 100 * 0.25)", "cy2": "least(1, y / 100 + h / 100 + h / 100 * 0.25)"}.items())},
    **{c: (lambda k=k: _r(G.crop_pixels(_box(), F.lit(100.0), F.lit(100.0))[k]), f"round({sql}, 6)") for k, (c, sql) in enumerate({
        "px1": "greatest(0, x - 20)", "py1": "greatest(0, y - 20)", "px2": "least(100, x + w + 20)", "py2": "least(100, y + h + 20)"}.items())},
})

_expressions("b6_bbox_geom", _DET, _det, _KEYS, {
    "cx": (lambda: G.center(_box())[0], "CAST(floor((2 * x + w) / 2) AS BIGINT)"),
    "cy": (lambda: G.center(_box())[1], "CAST(floor((2 * y + h) / 2) AS BIGINT)"),
    "area": (lambda: _r(G.area(_box())), "round(w * h, 6)"),
    "aspect": (lambda: _r(G.aspect(_box())), "round(CASE WHEN w > 0 THEN h / w ELSE 0 END, 6)"),
})

_expressions("b8_person_traits", _DET, _det, _KEYS, {
    "size_category": (lambda: G.size_category(_box(), F.lit(200), F.lit(150)), "CASE WHEN w * h / 30000 > 0.1 THEN 'large' WHEN w * h / 30000 > 0.05 THEN 'medium' WHEN w * h / 30000 > 0.01 THEN 'small' ELSE 'tiny' END"),
    "position": (lambda: G.grid_position(_box(), F.lit(110), F.lit(100)), "(CASE WHEN floor((2 * y + h) / 2) < 33 THEN 'top' WHEN floor((2 * y + h) / 2) > 66 THEN 'bottom' ELSE 'middle' END) || '_' || (CASE WHEN floor((2 * x + w) / 2) < 36 THEN 'left' WHEN floor((2 * x + w) / 2) > 73 THEN 'right' ELSE 'center' END)"),
    "color": (lambda: C.hue_name(F.col("x") * 3.7), "CASE WHEN x * 3.7 < 10 OR x * 3.7 > 170 THEN 'red' WHEN x * 3.7 <= 25 THEN 'orange' WHEN x * 3.7 <= 35 THEN 'yellow' WHEN x * 3.7 <= 85 THEN 'green' WHEN x * 3.7 <= 130 THEN 'blue' ELSE 'purple' END"),
})

_BALL = "WHEN v > 200 AND s < 50 THEN 'soccer' WHEN h BETWEEN 5 AND 15 AND s > 120 THEN 'basketball' WHEN h BETWEEN 20 AND 30 AND s > 120 THEN 'tennis' WHEN h BETWEEN 10 AND 20 AND s > 80 THEN 'rugby'"
_expressions(
    "b9_ball_type", f"{X.COLORS}, t AS (SELECT photo, ord, r % 180 AS h, g AS s, b + percentage * 10 AS v FROM colors)", lambda s, d: X.colors(s, d).selectExpr("photo", "ord", "r % 180 as h", "g as s", "b + percentage * 10 as v"), ["photo", "ord"], {
        "combined": (lambda: C.ball_type(F.col("h"), F.col("s"), F.col("v")), f"CASE {_BALL} WHEN h < 10 OR h > 170 THEN 'soccer' ELSE 'sports ball' END"),
        "tuned": (lambda: C.ball_type(F.col("h"), F.col("s"), F.col("v"), "tuned"), f"CASE {_BALL} ELSE 'unknown' END"),
        "field": (lambda: C.ball_type(F.col("h"), F.col("s"), F.col("v"), "field"), "CASE WHEN v > 200 AND s < 50 THEN CASE WHEN h < 20 OR h > 160 THEN 'soccer' ELSE 'unknown' END WHEN h BETWEEN 5 AND 15 THEN 'basketball' WHEN h BETWEEN 20 AND 30 THEN 'tennis' WHEN h BETWEEN 10 AND 20 THEN 'rugby' ELSE 'unknown' END"),
    },
)

_RATIO = "(pi() * (w / 2) * (w / 2) / 40000)"
_expressions("b10_circle_score", _DET, _det, _KEYS, {
    "score": (lambda: _r(G.circle_score(F.col("x") * 3, F.col("y") * 3, F.col("w") / 2, F.lit(200), F.lit(200), F.col("confidence"), F.col("w") * 200, F.lit(0.9))),
              f"round(CASE WHEN x * 3 - w / 2 < 0 OR x * 3 + w / 2 >= 200 OR y * 3 - w / 2 < 0 OR y * 3 + w / 2 >= 200 THEN 0 ELSE least(1, confidence * 0.3 + greatest(0, 1 - w * 200 / 10000) * 0.3 + 0.9 * 0.2 + (CASE WHEN {_RATIO} BETWEEN 0.001 AND 0.01 THEN 1.0 WHEN {_RATIO} BETWEEN 0.0005 AND 0.02 THEN 0.8 ELSE 0.3 END) * 0.2) END, 6)"),
})

_CIRC = "4 * pi() * (w * h) / ((x + 60) * (x + 60))"
_expressions("b38_circularity", _DET, _det, _KEYS, {
    "circularity": (lambda: _r(G.circularity(G.area(_box()), F.col("x") + 60)), f"round({_CIRC}, 6)"),
    "ball": (lambda: G.is_ball_contour(G.area(_box()), F.col("x") + 60, F.col("y")), f"{_CIRC} > 0.7 AND w * h >= 50 AND y BETWEEN 5 AND 100"),
})

_expressions("b31_expand_player_box", _DET, _det, _KEYS, {
    c: (lambda k=k: _r(G.player_box(_box(), F.lit(100.0), F.lit(120.0))[k]), f"round({sql}, 6)") for k, (c, sql) in enumerate({
        "bx": "greatest(0, x - floor(w / 2))", "by": "greatest(0, y - floor(h / 2))", "bw": "least(w * 2, 100 - greatest(0, x - floor(w / 2)))", "bh": "least(h * 3, 120 - greatest(0, y - floor(h / 2)))"}.items())
})

_FX, _FY = "((x + w / 2) / 90)", "((y + h / 2) / 90)"


def _fx():
    return (F.col("x") + F.col("w") / 2) / 90


def _fy():
    return (F.col("y") + F.col("h") / 2) / 90


_GOAL = f"least(sqrt({_FX} * {_FX} + ({_FY} - 0.5) * ({_FY} - 0.5)), sqrt((1 - {_FX}) * (1 - {_FX}) + ({_FY} - 0.5) * ({_FY} - 0.5)))"
_expressions("b29_field_position", _DET, _det, _KEYS, {
    "fx": (lambda: _r(_fx()), f"round({_FX}, 6)"),
    "side": (lambda: G.field_side(_fx()), f"CASE WHEN {_FX} < 0.33 THEN 'left' WHEN {_FX} > 0.67 THEN 'right' ELSE 'center' END"),
    "zone": (lambda: G.field_zone(_fx()), f"CASE WHEN {_FX} < 0.25 THEN 'left_goal' WHEN {_FX} > 0.75 THEN 'right_goal' ELSE 'center_field' END"),
    "goal": (lambda: _r(G.goal_distance(_fx(), _fy())), f"round({_GOAL}, 6)"),
    "middle": (lambda: _r(G.center_distance(_fx(), _fy())), f"round(sqrt(({_FX} - 0.5) * ({_FX} - 0.5) + ({_FY} - 0.5) * ({_FY} - 0.5)), 6)"),
    "offside": (lambda: G.offside(_fx(), _fy()), f"{_FX} > 0.6 AND {_GOAL} < 0.3"),
    "offside_simple": (lambda: G.offside(_fx(), _fy(), simple=True), f"{_FX} > 0.6 AND {_FY} < 0.3"),
    "player_zone": (lambda: F.coalesce(G.player_zone(_fx(), _fy(), F.lit(1000), F.lit(800)), F.lit("none")),
                    "CASE " + " ".join(f"WHEN abs({_FX} - {c}) < 0.2 AND abs({_FY} - 0.5) < 0.2 THEN '{n}'" for n, c in (("center_field", 0.5), ("left_goal_area", 0.125), ("right_goal_area", 0.875), ("left_penalty_area", 0.166), ("right_penalty_area", 0.833))) + " ELSE 'none' END"),
})

_T_COLORS = f"{X.COLORS}, t AS (SELECT * FROM colors)"
_CK = ["photo", "ord"]


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


_MX, _MN = "greatest(r, g, b)", "least(r, g, b)"
_HUE = f"(CASE WHEN {_MX} = {_MN} THEN 0 WHEN {_MX} = r THEN ((g - b) / ({_MX} - {_MN}) + 6) % 6 WHEN {_MX} = g THEN (b - r) / ({_MX} - {_MN}) + 2 ELSE (r - g) / ({_MX} - {_MN}) + 4 END)"
_expressions("b12_color_spaces", _T_COLORS, X.colors, _CK, {
    "hue": (lambda: _r(C.rgb_to_hsv(_rgb())[0]), f"round({_HUE} * 60 * 255, 6)"),
    "sat": (lambda: F.round(C.rgb_to_hsv(_rgb())[1] / 7, 6), f"round(CASE WHEN {_MX} = 0 THEN 0 ELSE ({_MX} - {_MN}) / {_MX} * 255 END / 7, 6)"),
    "val": (lambda: _r(C.rgb_to_hsv(_rgb())[2]), f"round({_MX} * 1.0, 6)"),
    "lab_l": (lambda: _r(C.rgb_to_lab(_rgb())[0]), "round(0.299 * r + 0.587 * g + 0.114 * b, 6)"),
    "lab_a": (lambda: _r(C.rgb_to_lab(_rgb())[1]), "round(0.5 * (r - g), 6)"),
    "lab_b": (lambda: _r(C.rgb_to_lab(_rgb())[2]), "round(0.25 * (r + g - 2 * b), 6)"),
    "back_r": (lambda: _r(C.lab_to_rgb(C.rgb_to_lab(_rgb()))[0]), "round(greatest(0, least(255, 0.299 * r + 0.587 * g + 0.114 * b + 0.25 * (r - g))), 6)"),
    "hsv_r": (lambda: _r(C.hsv_to_rgb(C.rgb_to_hsv(_rgb(), 1.0))[0]), "round(r / 255, 6)"),
    "hsv_g": (lambda: _r(C.hsv_to_rgb(C.rgb_to_hsv(_rgb(), 1.0))[1]), "round(g / 255, 6)"),
})

_expressions("b13_color_name", _T_COLORS, X.colors, _CK, {
    "name": (lambda: C.color_name(*_rgb()), """coalesce(CASE
      WHEN r > g AND r > b THEN CASE WHEN r > 200 AND g < 100 AND b < 100 THEN 'Red' WHEN r > 150 AND g > 100 AND b < 100 THEN 'Orange' END
      WHEN g > r AND g > b THEN CASE WHEN g > 200 AND r < 100 AND b < 100 THEN 'Green' WHEN g > 150 AND r > 100 AND b < 100 THEN 'Yellow' END
      WHEN b > r AND b > g THEN CASE WHEN b > 200 AND r < 100 AND g < 100 THEN 'Blue' WHEN b > 150 AND r > 100 AND g < 100 THEN 'Purple' END
      WHEN r > 200 AND g > 200 AND b > 200 THEN 'White' WHEN r < 50 AND g < 50 AND b < 50 THEN 'Black' END, 'RGB_' || r || '_' || g || '_' || b)"""),
})

_PAL = " UNION ALL ".join(f"SELECT {k} AS k, '{n}' AS name, {r} AS pr, {g} AS pg, {b} AS pb, {t} AS tol" for k, (n, r, g, b, t) in enumerate(C.PALETTE))
_expressions("b14_classify_color", f"""{X.COLORS}, pal AS ({_PAL}), d AS (SELECT photo, ord, name, tol, k, sqrt((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) AS d FROM colors, pal),
 m AS (SELECT photo, ord, arg_min(name, (d, k)) AS nm, arg_min(1 - 0.3 * d / tol, (d, k)) AS cf FROM d WHERE d <= tol GROUP BY photo, ord), t AS (SELECT c.photo, c.ord, nm, cf FROM colors c LEFT JOIN m USING (photo, ord))""", X.colors, _CK, {
    "name": (lambda: F.coalesce(C.classify_color(_rgb())[0], F.lit("none")), "coalesce(nm, 'none')"),
    "confidence": (lambda: _r(F.coalesce(C.classify_color(_rgb())[1], F.lit(0.0))), "round(coalesce(cf, 0), 6)"),
})

_SAT = f"(CASE WHEN {_MX} = 0 THEN 0 ELSE ({_MX} - {_MN}) / {_MX} END)"
_expressions("b15_jersey_filter", _T_COLORS, X.colors, _CK, {
    "jersey": (lambda: C.is_jersey(C.rgb_to_hsv(_rgb(), 1.0)[1], 0.7), f"{_SAT} >= 0.7"),
    "jersey_scaled": (lambda: C.is_jersey(C.rgb_to_hsv(_rgb())[1]), f"{_SAT} * 255 >= 0.3"),
})

_MEAS = "t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 50 AS lap, l_quantity * 5 AS bright, l_discount * 8 AS con, l_extendedprice / 30 AS noise, l_extendedprice / 8 AS grad FROM lineitem)"


def _measures(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice / 50 as lap", "l_quantity * 5 as bright", "l_discount * 8 as con", "l_extendedprice / 30 as noise", "l_extendedprice / 8 as grad")


_MK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_SQL_SCORES = {
    "sharpness": "CASE WHEN lap >= 1000 THEN 1.0 WHEN lap >= 500 THEN 0.8 WHEN lap >= 200 THEN 0.6 WHEN lap >= 100 THEN 0.4 WHEN lap >= 50 THEN 0.2 ELSE 0.0 END",
    "focus": "1 / (1 + exp(-10 * (least(1, lap / 2000) - 0.5)))",
    "exposure": "CASE WHEN bright BETWEEN 50 AND 200 THEN 1.0 WHEN bright BETWEEN 30 AND 220 THEN 0.8 ELSE greatest(0, 0.4 - 0.4 * CASE WHEN bright < 30 THEN (30 - bright) / 30 ELSE (bright - 220) / 35 END) END",
    "composition": "least(1, least(0.5, con / 10 * 10) + least(0.5, con / 20 * 10))",
    "action": "CASE WHEN grad > 10000 THEN 1.0 WHEN grad > 5000 THEN 0.8 WHEN grad > 2000 THEN 0.6 WHEN grad > 1000 THEN 0.4 ELSE 0.2 END",
    "color": "(least(1, bright / 128) + least(1, grad / 10000)) / 2",
    "noise": "CASE WHEN noise < 100 THEN 1.0 WHEN noise < 500 THEN 0.8 WHEN noise < 1000 THEN 0.6 WHEN noise < 2000 THEN 0.4 ELSE 0.2 END",
    "contrast": "CASE WHEN con >= 0.7 THEN 1.0 WHEN con >= 0.5 THEN 0.8 WHEN con >= 0.3 THEN 0.6 WHEN con >= 0.2 THEN 0.4 ELSE 0.2 END",
}


def _scores() -> dict[str, Column]:
    c = F.col
    share = F.least(F.lit(1.0), c("lap") / 2000)
    return {
        "sharpness": Q.sharpness(c("lap")), "focus": Q.focus({m: share * usual for m, (usual, _) in Q.FOCUS.items()}, F.lit(1000), F.lit(1000)), "exposure": Q.exposure(c("bright")),
        "composition": Q.composition([c("con") / 10, c("con") / 20]), "action": Q.action(c("grad")), "color": Q.color(c("bright"), c("grad")), "noise": Q.noise(c("noise")), "contrast": Q.contrast(c("con")),
    }


_OVER = " + ".join(f"({_SQL_SCORES[m]}) * {w}" for m, w in Q.WEIGHTS.items())
_GRADE = "CASE WHEN {0} >= 0.85 THEN 'A' WHEN {0} >= 0.70 THEN 'B' WHEN {0} >= 0.55 THEN 'C' WHEN {0} >= 0.40 THEN 'D' ELSE 'F' END"
for _m in Q.WEIGHTS:
    _id = {"focus": "b18_score_focus", "composition": "b19_score_composition"}.get(_m, f"b17_score_{_m}")
    _expressions(_id, _MEAS, _measures, _MK, {"score": (lambda m=_m: _scores()[m] if m == "color" else _r(_scores()[m]), _SQL_SCORES[_m] if _m == "color" else f"round({_SQL_SCORES[_m]}, 6)")})
_expressions("b20_overall_score", _MEAS, _measures, _MK, {
    "score": (lambda: _r(Q.overall(_scores())), f"round({_OVER}, 6)"),
    "simple": (lambda: _r(Q.overall({k: v for k, v in _scores().items() if k in ("sharpness", "exposure")})), f"round((({_SQL_SCORES['sharpness']}) + ({_SQL_SCORES['exposure']})) / 2, 6)"),
})
_expressions("b21_grade", _MEAS, _measures, _MK, {"grade": (lambda: Q.grade(_r(Q.overall(_scores()))), _GRADE.format(f"round({_OVER}, 6)"))})
_expressions("b22_recommendations", _MEAS, _measures, _MK, {
    "advice": (lambda: F.array_join(Q.recommendations(_scores()), "|"), "coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN {_SQL_SCORES[m]} < 0.5 THEN '{t}' END" for m, t in Q.ADVICE.items()) + f"), ''), '{Q.GOOD}')"),
})


# poses: landmark k of an order line lies at values that its columns give; every seventh part lacks wrists
def _landmark(k: int) -> Column:
    x = (F.col("l_partkey") * (k + 3) % 97) / 97.0
    y = (F.col("l_suppkey") * (k + 5) % 89) / 89.0
    c = (F.col("l_partkey") + F.col("l_suppkey") * k) % 10 / 10.0
    gone = (F.col("l_partkey") % 7 == 0) & F.lit(k in (15, 16)) | ((F.col("l_partkey") % 11 == 0) & F.lit(k > 6))
    return F.when(~gone, F.struct(x.alias("x"), y.alias("y"), c.alias("confidence")))


def _poses(spark, sf_dir):
    """Measures with `points`; exists() keeps the 33 landmarks out of one method that is too large for the JVM to compile."""
    known = F.exists(F.array("l_partkey", "l_suppkey"), lambda k: k.isNotNull())
    none = F.array_repeat(F.when(F.lit(False), _landmark(0)), 33)
    return _measures(spark, sf_dir).withColumn("points", F.when(known, F.array(*[_landmark(k) for k in range(33)])).otherwise(none))


def _pt(k: int, part: str) -> str:
    v = {"x": f"(l_partkey * {k + 3} % 97) / 97.0", "y": f"(l_suppkey * {k + 5} % 89) / 89.0", "c": f"((l_partkey + l_suppkey * {k}) % 10) / 10.0"}[part]
    lost = ([] if k not in (15, 16) else ["l_partkey % 7 = 0"]) + ([] if k <= 6 else ["l_partkey % 11 = 0"])
    return f"(CASE WHEN {' OR '.join(lost)} THEN NULL ELSE {v} END)" if lost else f"({v})"


_SEEN = "(CASE WHEN l_partkey % 11 = 0 THEN 7 WHEN l_partkey % 7 = 0 THEN 31 ELSE 33 END)"
_SUM_C = " + ".join(f"coalesce({_pt(k, 'c')}, 0)" for k in range(33))
_ARMS = [11, 12, 13, 14]
_expressions("b23_pose_confidence", _MEAS, lambda s, d: _poses(s, d).withColumn("points", F.filter("points", lambda p: p.isNotNull())), _MK, {
    "confidence": (lambda: _r(P.pose_confidence(F.col("points"))), f"round(CASE WHEN l_partkey % 11 = 0 THEN ({_SUM_C}) / 7 ELSE ({' + '.join(_pt(k, 'c') for k in _ARMS)}) / 4 END, 6)"),
})


def _ext(fn: str, part: str) -> str:
    return f"{fn}(" + ", ".join(f"CASE WHEN {_pt(k, 'c')} > 0.7 THEN {_pt(k, part)} END" for k in P.UPPER_BODY) + ")"


def _edge(part: str, n: int, pad: float, low: bool) -> str:
    lo, hi = _ext("least", part), _ext("greatest", part)
    return f"greatest(0, CAST(trunc(({lo} - ({hi} - {lo}) * {pad}) * {n}) AS BIGINT))" if low else f"least({n}, CAST(trunc(({hi} + ({hi} - {lo}) * {pad}) * {n}) AS BIGINT))"


def _upper(spark, sf_dir) -> DataFrame:
    return P.with_upper_body(_poses(spark, sf_dir), "points", F.lit(640), F.lit(480))


_expressions("b24_upper_body_box", _MEAS, _upper, _MK, {
    "x": (lambda: F.col("box.x").cast("long"), f"CAST(coalesce({_edge('x', 640, 0.2, True)}, 0) AS BIGINT)"),
    "y": (lambda: F.col("box.y").cast("long"), f"CAST(CASE WHEN {_ext('least', 'x')} IS NULL THEN 0 ELSE {_edge('y', 480, 0.3, True)} END AS BIGINT)"),
    "w": (lambda: F.col("box.w").cast("long"), f"CAST(CASE WHEN {_ext('least', 'x')} IS NULL THEN 640 ELSE {_edge('x', 640, 0.2, False)} - {_edge('x', 640, 0.2, True)} END AS BIGINT)"),
    "h": (lambda: F.col("box.h").cast("long"), f"CAST(CASE WHEN {_ext('least', 'x')} IS NULL THEN 480 ELSE {_edge('y', 480, 0.3, False)} - {_edge('y', 480, 0.3, True)} END AS BIGINT)"),
})

_ANG = f"abs(degrees(atan2({_pt(12, 'y')} - {_pt(11, 'y')}, {_pt(12, 'x')} - {_pt(11, 'x')})))"
_AL, _AR, _LL, _LR = (f"coalesce({_pt(a, 'y')} < {_pt(b, 'y')}, false)" for a, b in ((15, 13), (16, 14), (27, 25), (28, 26)))
_FEW = f"{_SEEN} < 10"


def _raised(a: str, b: str) -> str:
    return f"CASE WHEN {_FEW} THEN 'unknown' ELSE coalesce(nullif(concat_ws(',', CASE WHEN {a} THEN 'left_raised' END, CASE WHEN {b} THEN 'right_raised' END), ''), 'both_down') END"


_MEANC = f"(({_SUM_C}) / {_SEEN})"
_expressions("b25_pose_traits", _MEAS, _poses, _MK, {
    "quality": (lambda: P.pose_traits(F.col("points"))["quality"], f"CASE WHEN {_FEW} THEN 'poor' WHEN {_MEANC} > 0.8 THEN 'excellent' WHEN {_MEANC} > 0.6 THEN 'good' WHEN {_MEANC} > 0.4 THEN 'fair' ELSE 'poor' END"),
    "pose_type": (lambda: P.pose_traits(F.col("points"))["pose_type"], f"CASE WHEN {_FEW} THEN 'unknown' WHEN ({_AL} OR {_AR}) AND ({_LL} OR {_LR}) THEN 'dynamic' WHEN {_AL} OR {_AR} THEN 'arm_action' WHEN {_LL} OR {_LR} THEN 'leg_action' ELSE 'static' END"),
    "orientation": (lambda: P.pose_traits(F.col("points"))["orientation"], f"CASE WHEN {_FEW} THEN 'unknown' WHEN {_ANG} IS NULL THEN 'unknown' WHEN {_ANG} < 30 THEN 'facing_camera' WHEN {_ANG} > 150 THEN 'facing_away' ELSE 'side_view' END"),
    "arms": (lambda: F.array_join(P.pose_traits(F.col("points"))["arms"], ","), _raised(_AL, _AR)),
    "legs": (lambda: F.array_join(P.pose_traits(F.col("points"))["legs"], ","), _raised(_LL, _LR)),
})


def _leg(a: int, b: int) -> str:
    return f"abs(degrees(atan2(({_pt(b, 'y')} - {_pt(a, 'y')}) * 1000, ({_pt(b, 'x')} - {_pt(a, 'x')}) * 1000)))"


_LEAN = f"abs(({_pt(11, 'x')} + {_pt(12, 'x')}) / 2 - ({_pt(23, 'x')} + {_pt(24, 'x')}) / 2) * 1000"
_FEATURES = {"shoulder_width": f"abs({_pt(12, 'x')} - {_pt(11, 'x')}) * 1000", "hip_width": f"abs({_pt(24, 'x')} - {_pt(23, 'x')}) * 1000", "left_leg_angle": _leg(23, 25), "right_leg_angle": _leg(24, 26), "body_lean": _LEAN}
_expressions("b26_pose_features", _MEAS, _poses, _MK, {f: (lambda f=f: _r(P.pose_features(F.col("points"))[f]), f"round({sql}, 6)") for f, sql in _FEATURES.items()})

_ACT = {
    "running": "(CASE WHEN abs(a - b) BETWEEN 30 AND 120 THEN 0.4 ELSE 0 END + CASE WHEN lean > 10 THEN 0.3 ELSE 0 END)", "jumping": "CASE WHEN (a + b) / 2 > 120 THEN 0.5 ELSE 0 END", "kicking": "CASE WHEN abs(a - b) > 30 THEN 0.6 ELSE 0 END",
    "tackling": "(CASE WHEN lean > 15 THEN 0.5 ELSE 0 END + CASE WHEN (a + b) / 2 < 90 THEN 0.4 ELSE 0 END)", "passing": "CASE WHEN lean BETWEEN 5 AND 20 THEN 0.4 ELSE 0 END", "shooting": "CASE WHEN a IS NOT NULL AND greatest(a, b) > 140 THEN 0.6 ELSE 0 END", "standing": "(0.5 + CASE WHEN abs(a - b) < 20 THEN 0.3 ELSE 0 END)",
}
_BEST = "greatest(" + ", ".join(f"round({s}, 6)" for s in _ACT.values()) + ")"
_ACTION = "CASE WHEN " + _BEST + " < 0.6 THEN 'none' " + " ".join(f"WHEN round({s}, 6) = {_BEST} THEN '{n}'" for n, s in _ACT.items()) + " END"


def _angles():
    return F.when(F.col("l_partkey") % 5 > 0, (F.col("l_partkey") % 181).cast("double")), F.when(F.col("l_partkey") % 5 > 0, (F.col("l_suppkey") % 181).cast("double")), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_partkey") % 31).cast("double"))


_expressions("b27_classify_action", f"u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 181 END AS a, CASE WHEN l_partkey % 5 > 0 THEN l_suppkey % 181 END AS b, CASE WHEN l_suppkey % 3 > 0 THEN l_partkey % 31 END AS lean FROM lineitem), t AS (SELECT * FROM u)", _measures, _MK, {
    "action": (lambda: F.coalesce(P.classify_action(*_angles())[0], F.lit("none")), _ACTION),
})

_KNEE = f"abs({_pt(25, 'y')} - {_pt(26, 'y')})"
_expressions("b28_classify_action_simple", _MEAS, _poses, _MK, {
    "actions": (lambda: F.array_join(F.transform(P.classify_action_simple(F.col("points")), lambda a: a["type"]), ","),
                f"coalesce(nullif(concat_ws(',', CASE WHEN abs(abs({_pt(23, 'y')} - {_pt(25, 'y')}) - abs({_pt(24, 'y')} - {_pt(26, 'y')})) > 0.1 THEN 'running' END, CASE WHEN ({_pt(25, 'y')} + {_pt(26, 'y')}) / 2 < 0.3 THEN 'jumping' END, CASE WHEN {_KNEE} > 0.2 THEN 'kicking' END), ''), 'standing')"),
})

def _placed(spark, sf_dir) -> DataFrame:
    return _poses(spark, sf_dir).withColumn("placed", P.landmarks_to_image(F.col("points"), F.lit(10), F.lit(20), F.lit(100), F.lit(200)))


_expressions("b37_landmarks_to_image", _MEAS, _placed, _MK, {
    "nose_x": (lambda: F.coalesce(F.get("placed", F.lit(0))["x"], F.lit(-1)), f"coalesce(CASE WHEN {_pt(0, 'c')} > 0.5 THEN CAST(trunc(10 + {_pt(0, 'x')} * 100) AS BIGINT) END, -1)"),
    "wrist_y": (lambda: F.coalesce(F.get("placed", F.lit(15))["y"], F.lit(-1)), f"coalesce(CASE WHEN {_pt(15, 'c')} > 0.5 THEN CAST(trunc(20 + {_pt(15, 'y')} * 200) AS BIGINT) END, -1)"),
})


@query("b30_zone_boxes", """WITH i AS (SELECT DISTINCT p_size * 40 AS w, p_size * 30 AS h FROM part), z AS (
 SELECT w, h, 'center_field' AS zone, w // 2 - 100 AS x1, h // 2 - 100 AS y1, w // 2 + 100 AS x2, h // 2 + 100 AS y2, w // 2 AS center_x, 40000 AS area FROM i UNION ALL
 SELECT w, h, 'left_goal_area', 0, h // 2 - 50, w // 4, h // 2 + 50, w // 8, w * h // 8 FROM i UNION ALL SELECT w, h, 'right_goal_area', 3 * w // 4, h // 2 - 50, w, h // 2 + 50, 7 * w // 8, w * h // 8 FROM i UNION ALL
 SELECT w, h, 'left_penalty_area', 0, h // 2 - 100, w // 3, h // 2 + 100, w // 6, w * h // 6 FROM i UNION ALL SELECT w, h, 'right_penalty_area', 2 * w // 3, h // 2 - 100, w, h // 2 + 100, 5 * w // 6, w * h // 6 FROM i)
 SELECT CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, zone, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2, CAST(center_x AS BIGINT) AS center_x, CAST(area AS BIGINT) AS area FROM z""")
def b30(spark, sf_dir) -> DataFrame:
    sizes = X.table(spark, sf_dir, "part").selectExpr("p_size * 40 as w", "p_size * 30 as h").distinct()
    z = sizes.withColumn("z", F.explode(G.zone_boxes(F.col("w"), F.col("h"))))
    return z.select("w", "h", *[F.col(f"z.{c}").alias(c) for c in ("zone", "x1", "y1", "x2", "y2", "center_x", "area")])


@query("c3_filter_classes", f"WITH {X.DETECTIONS} SELECT class, count(*) AS n FROM detections WHERE lower(class) IN ('ao', 'nf') GROUP BY class")
def c3(spark, sf_dir) -> DataFrame:
    from photoflow.operators.filters import filter_classes

    return filter_classes(X.detections(spark, sf_dir), ["ao", "Nf"]).groupBy("class").agg(F.count("*").alias("n"))