"""Poses: arrays of 33 landmarks (x, y, confidence), null where one is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.functions.ladder import first_true, ladder

# fixed values: places of landmarks in the array
NOSE, L_EYE, R_EYE, L_EAR, R_EAR = 0, 2, 5, 7, 8
L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW, L_WRIST, R_WRIST = 11, 12, 13, 14, 15, 16
L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE = 23, 24, 25, 26, 27, 28
UPPER_BODY = [L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW, L_WRIST, R_WRIST, NOSE, L_EYE, R_EYE, L_EAR, R_EAR]


def _at(points: Column, k: int) -> Column:
    return F.get(points, F.lit(k))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def pose_confidence(points: Column) -> Column:
    """Mean confidence of shoulders and elbows, of all points where there are fewer than these, 0 without points."""
    arms = F.filter(F.array(*[_at(points, k)["confidence"] for k in (L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW)]), lambda c: c.isNotNull())
    every = F.transform(points, lambda p: p["confidence"])
    return F.when(F.size(arms) > 0, _mean(arms)).when(F.size(points) > 0, _mean(every)).otherwise(F.lit(0.0))


def sure_points(points: Column, places: list[int] = UPPER_BODY, threshold: float = 0.7) -> Column:
    """The landmarks at `places` that are surer than the threshold."""
    return F.filter(F.array(*[_at(points, k) for k in places]), lambda p: p["confidence"] > threshold)


def padded_box(points: Column, w: Column, h: Column) -> Column:
    """Padded pixel box (struct x, y, w, h) around points (ratios), the whole image where there are none."""

    def side(part: str, n: Column, pad: float) -> tuple[Column, Column]:
        low, high = F.array_min(points[part]), F.array_max(points[part])
        p = (high - low) * pad
        return F.greatest(F.lit(0), ((low - p) * n).cast("bigint")), F.least(n, ((high + p) * n).cast("bigint"))

    (x1, x2), (y1, y2) = side("x", w, 0.2), side("y", h, 0.3)
    some = F.size(points) > 0
    pick = lambda a, b, name: F.when(some, a).otherwise(b).alias(name)
    return F.struct(pick(x1, F.lit(0), "x"), pick(y1, F.lit(0), "y"), pick(x2 - x1, w, "w"), pick(y2 - y1, h, "h"))


def with_upper_body(poses: DataFrame, points: str, w: Column, h: Column, name: str = "box", threshold: float = 0.7) -> DataFrame:
    """poses with `name`, the padded_box of the sure upper-body points of the column `points`.

    The points are chosen in one step and measured in the next, so they are looked at once, and the code made
    for a row stays small enough to be compiled.
    """
    sure = poses.withColumn("_sure", sure_points(F.col(points), UPPER_BODY, threshold))
    return sure.withColumn(name, padded_box(F.col("_sure"), w, h)).drop("_sure")


def landmarks_to_image(points: Column, x: Column, y: Column, w: Column, h: Column, visible: float = 0.5) -> Column:
    """Region-relative points in pixels of the image, null where hardly visible."""
    return F.transform(points, lambda p: F.when(p["confidence"] > visible, F.struct((x + p["x"] * w).cast("bigint").alias("x"), (y + p["y"] * h).cast("bigint").alias("y"), p["confidence"].alias("confidence"))))


def pose_traits(points: Column) -> Column:
    """Struct of quality, orientation, arms, legs and type; ten landmarks are needed."""
    seen = F.filter(points, lambda p: p.isNotNull())
    few = F.size(seen) < 10
    quality = ladder(_mean(F.transform(seen, lambda p: p["confidence"])), [(0.8, "excellent"), (0.6, "good"), (0.4, "fair")], "poor", lambda v, t: v > t)
    left, right = _at(points, L_SHOULDER), _at(points, R_SHOULDER)
    angle = F.abs(F.degrees(F.atan2(right["y"] - left["y"], right["x"] - left["x"])))
    known = _at(points, NOSE).isNotNull() & left.isNotNull() & right.isNotNull()
    orientation = first_true([(~known, "unknown"), (angle < 30, "facing_camera"), (angle > 150, "facing_away")], "side_view")
    above = lambda a, b: F.coalesce(_at(points, a)["y"] < _at(points, b)["y"], F.lit(False))

    def raised(one: Column, two: Column) -> Column:
        found = F.filter(F.array(F.when(one, F.lit("left_raised")), F.when(two, F.lit("right_raised"))), lambda c: c.isNotNull())
        return F.when(F.size(found) == 0, F.array(F.lit("both_down"))).otherwise(found)

    arm = above(L_WRIST, L_ELBOW) | above(R_WRIST, R_ELBOW)
    leg = above(L_ANKLE, L_KNEE) | above(R_ANKLE, R_KNEE)
    kind = first_true([(arm & leg, "dynamic"), (arm, "arm_action"), (leg, "leg_action")], "static")
    unknown = F.lit("unknown")
    return F.struct(
        F.when(few, F.lit("poor")).otherwise(quality).alias("quality"), F.when(few, unknown).otherwise(kind).alias("pose_type"), F.when(few, unknown).otherwise(orientation).alias("orientation"),
        F.when(few, F.array(unknown)).otherwise(raised(above(L_WRIST, L_ELBOW), above(R_WRIST, R_ELBOW))).alias("arms"), F.when(few, F.array(unknown)).otherwise(raised(above(L_ANKLE, L_KNEE), above(R_ANKLE, R_KNEE))).alias("legs"),
    )


def pose_features(points: Column) -> dict[str, Column]:
    """Shoulder and hip width, leg angles (absolute degrees) and lean, in thousandths of the image; null where a point is missing."""
    x, y = (lambda k: _at(points, k)["x"] * 1000), (lambda k: _at(points, k)["y"] * 1000)
    angle = lambda a, b: F.abs(F.degrees(F.atan2(y(b) - y(a), x(b) - x(a))))
    return {
        "shoulder_width": F.abs(x(R_SHOULDER) - x(L_SHOULDER)),
        "hip_width": F.abs(x(R_HIP) - x(L_HIP)),
        "left_leg_angle": angle(L_HIP, L_KNEE),
        "right_leg_angle": angle(R_HIP, R_KNEE),
        "body_lean": F.abs((x(L_SHOULDER) + x(R_SHOULDER)) / 2 - (x(L_HIP) + x(R_HIP)) / 2),
    }


def classify_action(left: Column, right: Column, lean: Column, threshold: float = 0.6) -> tuple[Column, Column]:
    """(action, score) of the best of seven rules, the first on ties, null under the threshold; null inputs add nothing."""
    plus = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    apart, mean = F.abs(left - right), (left + right) / 2
    scores = {
        "running": plus(apart.between(30, 120), 0.4) + plus(lean > 10, 0.3),
        "jumping": plus(mean > 120, 0.5),
        "kicking": plus(apart > 30, 0.6),
        "tackling": plus(lean > 15, 0.5) + plus(mean < 90, 0.4),
        "passing": plus(lean.between(5, 20), 0.4),
        "shooting": plus(F.greatest(left, right) > 140, 0.6),
        "standing": F.lit(0.5) + plus(apart < 20, 0.3),
    }
    ranked = F.array(*[F.struct(s.alias("s"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, s) in enumerate(scores.items())])
    best = F.array_max(ranked)
    ok = best["s"] >= threshold
    return F.when(ok, best["name"]), F.when(ok, best["s"])


def classify_action_simple(points: Column) -> Column:
    """Array of (type, confidence): every action whose legs fit, standing if none does."""
    y = lambda k: _at(points, k)["y"]
    cases = [
        (F.abs(F.abs(y(L_HIP) - y(L_KNEE)) - F.abs(y(R_HIP) - y(R_KNEE))) > 0.1, "running", 0.7),
        ((y(L_KNEE) + y(R_KNEE)) / 2 < 0.3, "jumping", 0.6),
        (F.abs(y(L_KNEE) - y(R_KNEE)) > 0.2, "kicking", 0.8),
    ]
    one = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    found = F.filter(F.array(*[F.when(test, one(t, c)) for test, t, c in cases]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(one("standing", 0.5))).otherwise(found)
