"""Colours as column expressions; triples are separate columns, which keeps them in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photoflow.functions.ladder import first_true

Triple = tuple[Column, Column, Column]

# fixed values: name, red, green, blue, tolerance
PALETTE = [
    ("red", 200, 0, 0, 50),
    ("blue", 0, 0, 200, 50),
    ("green", 0, 200, 0, 50),
    ("yellow", 255, 255, 0, 50),
    ("white", 255, 255, 255, 30),
    ("black", 0, 0, 0, 30),
    ("orange", 255, 165, 0, 50),
    ("purple", 128, 0, 128, 50),
]


def lab_distance(a: Triple, b: Triple) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))) / 100


def rgb_to_hsv(c: Triple, scale: float = 255.0) -> Triple:
    """Degrees, saturation and value, all times `scale` (the default keeps the historic scaling of every part)."""
    r, g, b = (x / 255.0 for x in c)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    hue = first_true([(delta == 0, 0.0), (top == r, F.pmod((g - b) / delta, F.lit(6.0))), (top == g, (b - r) / delta + 2)], (r - g) / delta + 4)
    return hue * 60 * scale, F.when(top == 0, 0.0).otherwise(delta / top) * scale, top * scale


def rgb_to_lab(c: Triple) -> Triple:
    """Linear approximation, times 255."""
    r, g, b = (x / 255.0 for x in c)
    return (r * 0.299 + g * 0.587 + b * 0.114) * 255, (r - g) * 0.5 * 255, (r + g - b * 2) * 0.25 * 255


def hsv_to_rgb(c: Triple) -> Triple:
    """From degrees and saturation and value in their own scale."""
    h, s, v = c[0] / 60.0, c[1], c[2]
    i = h.cast("int")
    f = h - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *xs: first_true([(i == k, x) for k, x in enumerate(xs[:5])], xs[5])
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def lab_to_rgb(c: Triple) -> Triple:
    l, a, b = (x / 255.0 for x in c)  # noqa: E741
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255 for x in (l + a * 0.5, l - a * 0.25 + b * 0.25, l - b * 0.25))


def color_name(r: Column, g: Column, b: Column) -> Column:
    """Name by the largest channel; a colour whose channel rules all fail is named by its numbers."""
    plain = F.concat_ws("_", F.lit("RGB"), r.cast("string"), g.cast("string"), b.cast("string"))

    def ruled(main: Column, side: Column, other: Column, pure: str, mixed: str, second: Column, third: Column) -> Column:
        return first_true([((main > 200) & (side < 100) & (other < 100), pure), ((main > 150) & (second > 100) & (third < 100), mixed)], plain)

    return first_true(
        [
            ((r > g) & (r > b), ruled(r, g, b, "Red", "Orange", g, b)),
            ((g > r) & (g > b), ruled(g, r, b, "Green", "Yellow", r, b)),
            ((b > r) & (b > g), ruled(b, r, g, "Blue", "Purple", r, g)),
            ((r > 200) & (g > 200) & (b > 200), "White"),
            ((r < 50) & (g < 50) & (b < 50), "Black"),
        ],
        plain,
    )


def classify_color(c: Triple, palette: list[tuple[str, int, int, int, int]] = PALETTE) -> tuple[Column, Column]:
    """(name, confidence) of the nearest palette colour within its tolerance, ties to the first; confidence 1 - 0.3 d / tolerance."""
    dist = [F.sqrt((c[0] - r) * (c[0] - r) + (c[1] - g) * (c[1] - g) + (c[2] - b) * (c[2] - b)) for _, r, g, b, _ in palette]
    fits = F.array(*[F.when(d <= p[4], F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(p[0]).alias("name"), (1 - d / p[4] * 0.3).alias("conf"))) for k, (d, p) in enumerate(zip(dist, palette, strict=True))])
    best = F.array_min(F.filter(fits, lambda x: x.isNotNull()))
    return best["name"], best["conf"]


def hue_name(hue: Column) -> Column:
    """Name of a hue in 0..179."""
    return first_true([((hue < 10) | (hue > 170), "red"), (hue <= 25, "orange"), (hue <= 35, "yellow"), (hue <= 85, "green"), (hue <= 130, "blue"), (hue <= 170, "purple")], "unknown")


def is_jersey(saturation: Column, threshold: float = 0.3) -> Column:
    return ~(saturation < threshold)


def ball_type(h: Column, s: Column, v: Column, variant: str = "combined") -> Column:
    """Kind of ball from dominant hue, saturation and value.

    Variants: combined and modern (red counts as soccer, else sports ball), tuned (else unknown), field
    (no saturation tests; a light ball is soccer only with a hue near red, and nothing else).
    """
    light = (v > 200) & (s < 50)
    if variant == "field":
        return first_true([(light, F.when((h < 20) | (h > 160), "soccer").otherwise("unknown")), (h.between(5, 15), "basketball"), (h.between(20, 30), "tennis"), (h.between(10, 20), "rugby")], "unknown")
    rules = [(light, "soccer"), (h.between(5, 15) & (s > 120), "basketball"), (h.between(20, 30) & (s > 120), "tennis"), (h.between(10, 20) & (s > 80), "rugby")]
    if variant == "tuned":
        return first_true(rules, "unknown")
    return first_true([*rules, ((h < 10) | (h > 170), "soccer")], "sports ball")
