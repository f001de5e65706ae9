"""Evaluation reports over judged cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import number_rows


def case_scores(cases: DataFrame, expected: str, present: str, extra: str, merged: str) -> DataFrame:
    """Set-based item checks: everything expected is there, nothing extra, nothing merged; recall is 1 for no expectation."""
    want, have = F.array_distinct(expected), F.array_distinct(present)
    hit = F.size(F.array_intersect(want, have))
    empty = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    return cases.withColumns({
        "items_ok": (F.size(F.array_except(want, have)) == 0) & empty(F.col(extra)) & empty(F.col(merged)),
        "item_recall": F.when(F.size(want) == 0, 1.0).otherwise(F.round(hit / F.size(want), 3))})


def exact_median(rows: DataFrame, key: str, value: str, name: str, chunk: int = 100_000) -> DataFrame:
    """Median per key from running counts of its distinct values, so equal values are one row.

    The values are numbered by a range sort and their counts added up in chunks of positions, so one key may hold any
    share of them; a window per key sees one row per chunk.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    placed = materialize(number_rows(counted, [F.col(value)], "_n", [key]).withColumn("_chunk", F.floor(F.col("_n") / chunk)))
    sums = placed.groupBy(key, "_chunk").agg(F.sum("_c").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(key, "_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_to", F.sum("_c").over(inside)).join(carried, [key, "_chunk"]).withColumn("_to", F.col("_to") + F.col("_carry"))
    placed = placed.join(sums.groupBy(key).agg(F.sum("_sum").alias("_size")), key)
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    holds = lambda at: (at <= F.col("_to")) & (at > F.col("_to") - F.col("_c"))
    at = lambda middle: F.max(F.when(holds(middle), F.col(value)))
    return placed.groupBy(key).agg(((at(low) + at(high)) / 2).alias(name))


def rate(flag: str) -> Column:
    return F.round(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")), 3)


def summarize(cases: DataFrame, key: str) -> DataFrame:
    """One row per run: rates and mean recall to three digits, mean artifacts to two, exact median seconds to one."""
    means = cases.groupBy(key).agg(
        F.count("*").alias("cases"), rate("layering_ok").alias("layering_accuracy"), rate("items_ok").alias("item_accuracy"),
        F.round(F.avg("item_recall"), 3).alias("item_recall"), rate("accessories_ok").alias("accessory_accuracy"),
        rate("identity_ok").alias("identity_preservation"), F.round(F.avg("artifacts"), 2).alias("mean_artifacts"))
    middle = exact_median(cases, key, "seconds", "median_seconds")
    return means.join(middle.withColumn("median_seconds", F.round("median_seconds", 1)), key, "left")


def compare_runs(summary: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Metrics both runs have, side by side with their difference."""
    metrics = [c for c in summary.columns if c != key]
    long = summary.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(key, "m.*")
    left = long.where(F.col(key) == before).select("metric", F.col("value").alias("before"))
    right = long.where(F.col(key) == after).select("metric", F.col("value").alias("after"))
    return left.join(right, "metric").where("before IS NOT NULL AND after IS NOT NULL").withColumn("delta", F.col("after") - F.col("before"))
