"""Garment similarity: one expression tree over a joined (item, requirement) row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import matches

S = dims.SIM


def set_similarity(actual: Column, wanted: Column, groups: Sequence[Sequence[str]] = ()) -> Column:
    """Best token-pair score of two token arrays."""
    def same_group(a: Column, b: Column) -> Column:
        hit = F.lit(False)
        for group in groups:
            pattern = "|".join(group)
            hit = hit | (a.rlike(pattern) & b.rlike(pattern))
        return hit

    def pair(a: Column, b: Column) -> Column:
        return (
            F.when(a == b, F.lit(1.0))
            .when(F.contains(a, b) | F.contains(b, a), F.lit(S["substring"]))
            .when(same_group(a, b), F.lit(S["synonym"]))
            .otherwise(F.lit(0.0))
        )

    best = F.array_max(F.flatten(F.transform(actual, lambda a: F.transform(wanted, lambda b: pair(a, b)))))
    return F.when((F.size(actual) == 0) | (F.size(wanted) == 0), F.lit(S["unknown_set"])).otherwise(best)


def forms_agree(left: Column, right: Column) -> Column:
    return (left == "unknown") | (right == "unknown") | (left == right)


def subtype_agrees(actual: Column, required: Column) -> Column:
    """A polo or a T-shirt that is asked for must be there."""
    missing = lambda pattern: matches(required, pattern) & ~matches(actual, pattern)
    return ~missing(dims.POLO_PATTERN) & ~missing(dims.TEE_PATTERN)


def visual_score(cosine: Column) -> Column:
    """Half marks where vectors do not compare (least and greatest would pass over the null)."""
    return F.when(cosine.isNull(), F.lit(S["unknown_visual"])).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1) / 2)))


def total_similarity(color: Column, material: Column, fit: Column, detail: Column, visual: Column,
                     comparable: Column, same_category: Column, direct: Column) -> Column:
    base = (F.lit(S["base"]) + color * S["color"] + material * S["material"] + fit * S["fit"]
            + detail * S["detail"] + visual * S["visual"])
    floored = (
        F.when(direct & same_category, F.greatest(base, F.lit(S["direct_floor"])))
        .when(comparable & (visual >= S["visual_floor"]) & same_category, F.greatest(base, F.lit(S["visual_floor"])))
        .otherwise(base)
    )
    return F.round(F.least(F.lit(1.0), floored), 9)
