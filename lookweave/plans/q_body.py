"""Body measure queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import dims
from ..functions import body
from ..operators import measures
from .bindings import view
from .oracle import add_view
from .registry import query

_BMI = "(weight / ((height / 100) * (height / 100)))"


def _estimate(m):
    women, men, slope = dims.IMPUTE[m]
    return f"coalesce(nullif({m}, 0.0), round_even(height * (CASE WHEN gender = 'women' THEN {women} ELSE {men} END)::DOUBLE + ({_BMI} - 21.5) * {slope}::DOUBLE, 1))"


add_view("full_v", "SELECT id, gender, height, weight, " + ", ".join(f"{_estimate(m)} AS {m}" for m in dims.IMPUTE) + " FROM person_v")


@query("impute_measures", "SELECT id, " + ", ".join(dims.IMPUTE) + " FROM full_v")
def impute_measures(spark, sf):
    return measures.imputed(view(spark, sf, "person_v")).select("id", *dims.IMPUTE)


_gaps = ", ".join(f"round_even(f.{m} + 0.25 * (f.id % 7) - p.{m}, 1)" for m in dims.IMPUTE)


@query("fit_error", f"""
SELECT id, CAST(len(gaps) AS INT) AS shared, CASE WHEN len(gaps) = 0 THEN 0.0 ELSE round(list_sum(list_transform(gaps, lambda g: abs(g))) / len(gaps) + 1e-9, 2) END AS mae
FROM (SELECT f.id, list_filter([{_gaps}], lambda g: g IS NOT NULL) AS gaps FROM full_v f JOIN person_v p ON p.id = f.id)""")
def fit_error(spark, sf):
    people = view(spark, sf, "person_v")
    made = measures.imputed(people)
    achieved = made.select("id", *[(F.col(m) + 0.25 * (F.col("id") % 7)).alias(m) for m in dims.IMPUTE])
    return measures.fit_errors(achieved, people, "id")


@query("garment_ease", """
SELECT look, pos, part, ease FROM (
SELECT q.look, q.pos, unnest(['chest', 'waist', 'hip']) AS part, unnest([80.0 + q.part % 50 - f.chest, 60.0 + q.part % 45 - f.waist, CASE WHEN q.part % 3 = 0 THEN 85.0 + q.part % 40 - f.hip END]) AS ease
FROM req_v q JOIN look_v l ON l.id = q.look JOIN full_v f ON f.id = l.person) WHERE ease IS NOT NULL""")
def garment_ease(spark, sf):
    p = F.col("part")
    size = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("chest"), 80.0 + p % 50), F.struct(F.lit("waist"), 60.0 + p % 45),
        F.struct(F.when(p % 3 == 0, "hip"), 85.0 + p % 40), F.struct(F.lit("inseam_inner"), F.lit(1.0))), lambda e: e["col1"].isNotNull()))
    garments = view(spark, sf, "req_v").select("look", "pos", size.alias("garment"))
    owners = view(spark, sf, "look_v").select(F.col("id").alias("look"), F.col("person").alias("id"))
    people = measures.imputed(view(spark, sf, "person_v")).select(
        "id", F.create_map(*[x for m in ("chest", "waist", "hip", "shoulder") for x in (F.lit(m), F.col(m))]).alias("body"))
    return measures.ease(garments, owners.join(people, "id"), "look", "garment", "body", ["look", "pos"])


@query("body_build", f"""
SELECT id, CASE WHEN {_BMI} < 20 THEN 'lean' WHEN {_BMI} < 24 THEN 'average' WHEN {_BMI} < 28 THEN 'solid' ELSE 'fuller' END AS build,
  CASE WHEN nullif(waist, 0) IS NOT NULL AND nullif(hip, 0) IS NOT NULL THEN round(waist / hip + 1e-9, 2) END AS waist_hip FROM person_v""")
def body_build(spark, sf):
    c = F.col
    ratio = F.round(F.nullif(c("waist"), F.lit(0.0)) / F.nullif(c("hip"), F.lit(0.0)) + 1e-9, 2)
    return view(spark, sf, "person_v").select("id", body.build_class(body.bmi(c("height"), c("weight"))).alias("build"), ratio.alias("waist_hip"))


def _factor(m):
    r = dims.DEPTH_RATIOS[m]
    return math.pi * (3 * (1 + r) - math.sqrt((3 + r) * (1 + 3 * r)))


@query("body_widths", "SELECT id, " + ", ".join(
    f"round(2 * ({m} / {_factor(m)!r}::DOUBLE), 6) AS {m}_front, round(2 * ({m} / {_factor(m)!r}::DOUBLE) * {r}::DOUBLE, 6) AS {m}_side" for m, r in dims.DEPTH_RATIOS.items())
    + ", round(least(8.1, greatest(6.9, 7.0 + (height - 155) / 35 * 1.1)), 6) AS head_index FROM full_v")
def body_widths(spark, sf):
    c = F.col
    people = measures.imputed(view(spark, sf, "person_v"))
    columns = []
    for m, r in dims.DEPTH_RATIOS.items():
        front = body.ellipse_width(c(m), m)
        columns += [F.round(front, 6).alias(f"{m}_front"), F.round(front * r, 6).alias(f"{m}_side")]
    return people.select("id", *columns, F.round(body.head_index(c("height")), 6).alias("head_index"))


@query("photo_defaults", """
SELECT id, CASE WHEN photo THEN CASE WHEN gender = 'men' THEN 175.0 ELSE 165.0 END ELSE height END AS height,
  CASE WHEN photo THEN CASE WHEN gender = 'men' THEN 70.0 ELSE 55.0 END ELSE weight END AS weight, coalesce(shape, '보통') AS shape FROM person_v""")
def photo_defaults(spark, sf):
    c = F.col
    pick = lambda at: F.when(c("gender") == "men", float(dims.PHOTO_DEFAULTS["men"][at])).otherwise(float(dims.PHOTO_DEFAULTS["women"][at]))
    return view(spark, sf, "person_v").select("id", F.when(c("photo"), pick(0)).otherwise(c("height")).alias("height"),
                                              F.when(c("photo"), pick(1)).otherwise(c("weight")).alias("weight"), F.coalesce("shape", F.lit("보통")).alias("shape"))
