"""Body and garment measure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import body


def imputed(people: DataFrame) -> DataFrame:
    """Given measures stay; missing or zero ones are estimated."""
    c = F.col
    return people.withColumns({m: body.impute(m, c(m), c("gender"), c("height"), c("weight")) for m in dims.IMPUTE})


def fit_errors(achieved: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rounded gap per shared measure and the mean absolute error of the rounded gaps."""
    measures = list(dims.IMPUTE)
    joined = achieved.select(key, *[F.col(m).alias(f"_a_{m}") for m in measures]).join(target.select(key, *measures), key)
    gaps = F.array_compact(F.array(*[F.bround(F.col(f"_a_{m}") - F.col(m), 1) for m in measures]))
    rows = joined.select(key, gaps.alias("gaps"))
    mean = F.aggregate("gaps", F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size("gaps")
    return rows.select(key, F.size("gaps").alias("shared"), F.when(F.size("gaps") == 0, 0.0).otherwise(F.round(mean + 1e-9, 2)).alias("mae"))


def ease(garments: DataFrame, bodies: DataFrame, key: str, garment_map: str, body_map: str, keep: list[str]) -> DataFrame:
    """Garment minus body measure for every part measured on both."""
    pairs = garments.join(bodies, key)
    shared = F.array_intersect(F.map_keys(garment_map), F.map_keys(body_map))
    return pairs.select(*keep, garment_map, body_map, F.explode(shared).alias("part")).select(
        *keep, "part", (F.try_element_at(garment_map, F.col("part")) - F.try_element_at(body_map, F.col("part"))).alias("ease"))
