"""Boxes (x, y, width, height) and points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photoflow.functions.ladder import first_true, ladder

Box = tuple[Column, Column, Column, Column]


def _int(c: Column) -> Column:
    """Truncation towards zero."""
    return c.cast("bigint")


def _clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(c, F.lit(high) if not isinstance(high, Column) else high))


def bbox_to_ratio(b: Box, w: Column, h: Column) -> Box:
    return b[0] / w, b[1] / h, b[2] / w, b[3] / h


def rescale_bbox(b: Box, w: Column, h: Column, max_w: int = 1920, max_h: int = 1080) -> Box:
    """A box found in a downscaled image, in pixels of the original; corners are truncated before the size is taken."""
    scale = F.least(F.lit(max_w) / w, F.lit(max_h) / h, F.lit(1.0))
    x1, y1, x2, y2 = (_int(c / scale) for c in (b[0], b[1], b[0] + b[2], b[1] + b[3]))
    return x1, y1, x2 - x1, y2 - y1


def unletterbox(b: Box, scale: Column, ox: Column, oy: Column, w: Column, h: Column) -> Box:
    """Remove the border of a centred image, undo its scale, keep the box inside the image."""
    x, y = _int((b[0] - ox) / scale), _int((b[1] - oy) / scale)
    x, y = _clamp(x, 0, w - 1), _clamp(y, 0, h - 1)
    return x, y, F.least(_int(b[2] / scale), w - x), F.least(_int(b[3] / scale), h - y)


def crop_percent(b: Box, pad: float = 0.25) -> Box:
    """x1, y1, x2, y2 of a ratio box, padded by a share of its size on each side, within the unit square."""
    px, py = b[2] * pad, b[3] * pad
    return F.greatest(F.lit(0.0), b[0] - px), F.greatest(F.lit(0.0), b[1] - py), F.least(F.lit(1.0), b[0] + b[2] + px), F.least(F.lit(1.0), b[1] + b[3] + py)


def crop_pixels(b: Box, w: Column, h: Column, pad: int = 20) -> Box:
    return F.greatest(F.lit(0), b[0] - pad), F.greatest(F.lit(0), b[1] - pad), F.least(w, b[0] + b[2] + pad), F.least(h, b[1] + b[3] + pad)


def center(b: Box) -> tuple[Column, Column]:
    return F.floor((b[0] * 2 + b[2]) / 2), F.floor((b[1] * 2 + b[3]) / 2)


def area(b: Box) -> Column:
    return b[2] * b[3]


def aspect(b: Box) -> Column:
    return F.when(b[2] > 0, b[3] / b[2]).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that do not overlap and for empty ones."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def size_category(b: Box, w: Column, h: Column) -> Column:
    return ladder(area(b) / (w * h), [(0.1, "large"), (0.05, "medium"), (0.01, "small")], "tiny", lambda v, t: v > t)


def grid_position(b: Box, w: Column, h: Column) -> Column:
    """vertical_horizontal third of the image in which the centre lies."""
    cx, cy = center(b)
    third = lambda n, c, low, high, mid: first_true([(c < F.floor(n / 3), low), (c > F.floor(n * 2 / 3), high)], mid)
    return F.concat_ws("_", third(h, cy, "top", "bottom", "middle"), third(w, cx, "left", "right", "center"))


def player_box(b: Box, w: Column, h: Column) -> Box:
    """From a face to the player: twice as wide, three times as high, moved half a face up and left, within the image."""
    x, y = F.greatest(F.lit(0), b[0] - F.floor(b[2] / 2)), F.greatest(F.lit(0), b[1] - F.floor(b[3] / 2))
    return x, y, F.least(b[2] * 2, w - x), F.least(b[3] * 3, h - y)


def circularity(a: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * F.pi() * a / (perimeter * perimeter)).otherwise(F.lit(0.0))


def is_ball_contour(a: Column, perimeter: Column, radius: Column) -> Column:
    return (circularity(a, perimeter) > 0.7) & (a >= 50) & radius.between(5, 100)


def circle_score(x: Column, y: Column, r: Column, w: Column, h: Column, edges: Column, variance: Column, circular: Column) -> Column:
    """0.3 edge density + 0.3 colour uniformity + 0.2 circularity + 0.2 size; 0 outside the image, at most 1."""
    ratio = F.pi() * r * r / (w * h)
    size = first_true([(ratio.between(0.001, 0.01), 1.0), (ratio.between(0.0005, 0.02), 0.8)], 0.3)
    total = edges * 0.3 + F.greatest(F.lit(0.0), 1 - variance / 10000) * 0.3 + circular * 0.2 + size * 0.2
    return F.when((x - r < 0) | (x + r >= w) | (y - r < 0) | (y + r >= h), F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def field_side(x: Column) -> Column:
    return first_true([(x < 0.33, "left"), (x > 0.67, "right")], "center")


def field_zone(x: Column) -> Column:
    return first_true([(x < 0.25, "left_goal"), (x > 0.75, "right_goal")], "center_field")


def goal_distance(x: Column, y: Column) -> Column:
    return F.least(F.hypot(x, y - 0.5), F.hypot(1 - x, y - 0.5))


def center_distance(x: Column, y: Column) -> Column:
    return F.hypot(x - 0.5, y - 0.5)


def offside(x: Column, y: Column, simple: bool = False) -> Column:
    """Right of 0.6 and near a goal; the simple rule takes the upper 0.3 of the image instead."""
    return (x > 0.6) & ((y if simple else goal_distance(x, y)) < 0.3)


def zone_boxes(w: Column, h: Column) -> Column:
    """The five generated zones of an image: name, type, x1, y1, x2, y2, center_x, center_y, area."""
    half = F.floor(h / 2)
    frac = lambda c, n, d: F.floor(c * n / d)

    def zone(name: str, kind: str, x1: Column, x2: Column, reach: int, cx: Column, size: Column) -> Column:
        parts = {"zone": F.lit(name), "zone_type": F.lit(kind), "x1": x1, "y1": half - reach, "x2": x2, "y2": half + reach, "center_x": cx, "center_y": half, "area": size}
        return F.struct(*[(v if k.startswith("zone") else v.cast("bigint")).alias(k) for k, v in parts.items()])

    mid = F.floor(w / 2)
    return F.array(
        zone("center_field", "neutral", mid - 100, mid + 100, 100, mid, F.lit(40000)),
        zone("left_goal_area", "defensive", F.lit(0), frac(w, 1, 4), 50, frac(w, 1, 8), frac(w * h, 1, 8)),
        zone("right_goal_area", "defensive", frac(w, 3, 4), w, 50, frac(w, 7, 8), frac(w * h, 1, 8)),
        zone("left_penalty_area", "defensive", F.lit(0), frac(w, 1, 3), 100, frac(w, 1, 6), frac(w * h, 1, 6)),
        zone("right_penalty_area", "defensive", frac(w, 2, 3), w, 100, frac(w, 5, 6), frac(w * h, 1, 6)),
    )


def player_zone(x: Column, y: Column, w: Column, h: Column, reference: bool = False) -> Column:
    """First zone whose centre is within 0.2 of the normalised point; with `reference` centres stay in pixels."""
    cx = lambda z: z["center_x"] / (F.lit(1) if reference else w)
    cy = lambda z: z["center_y"] / (F.lit(1) if reference else h)
    return F.get(F.filter(zone_boxes(w, h), lambda z: (F.abs(x - cx(z)) < 0.2) & (F.abs(y - cy(z)) < 0.2)), F.lit(0))["zone"]
