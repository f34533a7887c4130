"""Photo quality: scores in 0 to 1 from measured columns, their weighting, grades and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photoflow.functions.ladder import first_true, ladder

# fixed values: weights of the overall score and the advice given for a score under 0.5
WEIGHTS = {"sharpness": 0.15, "focus": 0.20, "exposure": 0.20, "composition": 0.15, "action": 0.15, "color": 0.10, "noise": 0.05, "contrast": 0.05}
FOCUS = {"tenengrad": (10000, 0.25), "sobel_var": (0.1, 0.25), "brenner": (5000, 0.15), "laplacian_var": (0.1, 0.15), "var_of_laplacian": (0.01, 0.10), "modified_laplacian": (1000, 0.10)}
ADVICE = {
    "sharpness": "Consider using faster shutter speed or better focus technique",
    "focus": "Image appears out of focus - check autofocus settings or manual focus",
    "exposure": "Adjust exposure settings - image may be over/under exposed",
    "composition": "Consider applying rule of thirds for better composition",
    "action": "Use faster shutter speed to freeze action",
    "color": "Consider adjusting saturation or white balance",
    "noise": "Reduce ISO or use noise reduction techniques",
    "contrast": "Increase contrast in post-processing",
}
GOOD = "Image quality is good - no major improvements needed"


def sharpness(laplacian: Column) -> Column:
    return ladder(laplacian, [(1000, 1.0), (500, 0.8), (200, 0.6), (100, 0.4), (50, 0.2)], 0.0)


def exposure(brightness: Column) -> Column:
    far = F.when(brightness < 30, (30 - brightness) / 30).otherwise((brightness - 220) / 35)
    return first_true([(brightness.between(50, 200), 1.0), (brightness.between(30, 220), 0.8)], F.greatest(F.lit(0.0), 0.4 - far * 0.4))


def contrast(deviation: Column) -> Column:
    return ladder(deviation, [(0.7, 1.0), (0.5, 0.8), (0.3, 0.6), (0.2, 0.4)], 0.2)


def noise(level: Column) -> Column:
    return ladder(level, [(100, 1.0), (500, 0.8), (1000, 0.6), (2000, 0.4)], 0.2, lambda v, t: v < t)


def action(gradient_variance: Column) -> Column:
    return ladder(gradient_variance, [(10000, 1.0), (5000, 0.8), (2000, 0.6), (1000, 0.4)], 0.2, lambda v, t: v > t)


def color(saturation: Column, unique_colors: Column) -> Column:
    return (F.least(F.lit(1.0), saturation / 128) + F.least(F.lit(1.0), unique_colors / 10000)) / 2


def focus(measures: dict[str, Column], w: Column, h: Column) -> Column:
    """Weighted measures, each relative to its usual value for the image's size, through a logistic curve."""
    size = w * h / 1e6
    total = sum(F.least(F.lit(1.0), measures[m] / (size * usual)) * weight for m, (usual, weight) in FOCUS.items())
    return 1 / (1 + F.exp((total - 0.5) * -10))


def composition(densities: list[Column]) -> Column:
    return F.least(F.lit(1.0), sum(F.least(F.lit(0.5), d * 10) for d in densities))


def overall(scores: dict[str, Column]) -> Column:
    """Weighted sum; with only sharpness and exposure their mean."""
    if set(scores) == {"sharpness", "exposure"}:
        return (scores["sharpness"] + scores["exposure"]) / 2
    return sum(scores[m] * w for m, w in WEIGHTS.items())


def grade(score: Column) -> Column:
    return ladder(score, [(0.85, "A"), (0.70, "B"), (0.55, "C"), (0.40, "D")], "F")


def recommendations(scores: dict[str, Column]) -> Column:
    found = F.filter(F.array(*[F.when(scores[m] < 0.5, F.lit(text)) for m, text in ADVICE.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(GOOD))).otherwise(found)
