"""Body expressions: BMI, imputation, range scores, widths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def bmi(height: Column, weight: Column) -> Column:
    return weight / ((height / 100) * (height / 100))


def impute(measure: str, given: Column, gender: Column, height: Column, weight: Column) -> Column:
    """The given value, or a linear estimate from height and BMI when it is missing or zero."""
    women, men, slope = dims.IMPUTE[measure]
    share = F.when(gender == "women", F.lit(women)).otherwise(F.lit(men))
    estimate = height * share + (bmi(height, weight) - dims.BMI_CENTRE) * slope
    return F.coalesce(F.nullif(given, F.lit(0.0)), F.bround(estimate, 1))


def build_class(value: Column) -> Column:
    chain = None
    for limit, label in dims.BUILD_BANDS:
        chain = F.when(value < limit, label) if chain is None else chain.when(value < limit, label)
    return chain.otherwise("fuller")


def range_distance(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - value, value - high, F.lit(0.0))


def body_score(height: Column, weight: Column, shape: Column, shapes: Column, height_lo: Column, height_hi: Column,
               bmi_lo: Column, bmi_hi: Column, photo: Column) -> Column:
    shape_hit = F.coalesce(F.array_contains(shapes, shape), F.lit(False))
    h, w = F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(170.0)), F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(65.0))
    penalty = (F.least(F.lit(45.0), range_distance(h, height_lo, height_hi) * 2.2)
               + F.least(F.lit(35.0), range_distance(bmi(h, w), bmi_lo, bmi_hi) * 7))
    measured = F.greatest(F.lit(20), F.floor(90 - penalty + F.when(shape_hit, 10).otherwise(0) + 0.5))
    return F.when(photo, F.when(shape_hit, 96).otherwise(72)).otherwise(measured).cast("long")


def ellipse_width(circumference: Column, measure: str) -> Column:
    """Frontal width of a torso ellipse with the measure's depth ratio (Ramanujan's perimeter)."""
    r = dims.DEPTH_RATIOS[measure]
    factor = math.pi * (3 * (1 + r) - math.sqrt((3 + r) * (1 + 3 * r)))
    return 2 * (circumference / F.lit(factor))


def head_index(height: Column) -> Column:
    return F.least(F.lit(8.1), F.greatest(F.lit(6.9), 7.0 + (height - 155) / 35 * 1.1))
