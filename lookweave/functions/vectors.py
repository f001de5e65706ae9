"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null when the lengths differ or a side is empty."""
    comparable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(comparable, dot(a, b) / F.greatest(F.lit(1e-12), norm(a) * norm(b)))


def unit(a: Column) -> Column:
    length = F.greatest(F.lit(1e-12), norm(a))
    return F.transform(a, lambda x: x.cast("double") / length)


def engine_family(engine: Column) -> Column:
    """Vectors compare only within one family."""
    return F.when(engine.startswith("siglip:"), F.lit("siglip")).when(engine == "local-fingerprint-v1", F.lit("local"))
