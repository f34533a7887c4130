"""Step functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, object]], otherwise: object, test: Callable[[Column, float], Column] = lambda v, t: v >= t) -> Column:
    """The result of the first step whose threshold the value passes."""
    out = None
    for t, result in steps:
        out = F.when(test(value, t), F.lit(result)) if out is None else out.when(test(value, t), F.lit(result))
    return out.otherwise(F.lit(otherwise))


def first_true(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    out = None
    for c, result in cases:
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(c, result) if out is None else out.when(c, result)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
