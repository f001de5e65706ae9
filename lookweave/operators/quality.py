"""Detection quality: thresholds, gates, funnels and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .ranking import top_k


def with_thresholds(rows: DataFrame) -> DataFrame:
    """Default thresholds per category, overridden key by key per model."""
    spark = rows.sparkSession
    names = ["min_area", "min_fill", "min_confidence"]
    base = spark.createDataFrame([(c, *t) for c, t in dims.QUALITY.items()], "category string, " + ", ".join(f"{n} double" for n in names))
    over = spark.createDataFrame([(m, c, *t) for (m, c), t in dims.QUALITY_OVERRIDES.items()],
                                 "model string, category string, " + ", ".join(f"o_{n} double" for n in names))
    joined = rows.join(F.broadcast(base), "category").join(F.broadcast(over), ["model", "category"], "left")  # constant tables
    return joined.select(*rows.columns, *[F.coalesce(f"o_{n}", n).alias(n) for n in names])


def gate(fixed_fill: float | None = None) -> Column:
    """First failing gate in the order area, fill, confidence."""
    c = F.col
    least_fill = c("min_fill") if fixed_fill is None else F.lit(fixed_fill)
    return (F.when(c("area") < c("min_area"), "area").when(c("fill") < least_fill, "fill")
            .when(c("confidence") < c("min_confidence"), "confidence").otherwise("pass"))


def reject_reason() -> Column:
    """Readable reason of the first failing gate, empty when the detection passes."""
    c = F.col
    pct2 = lambda v: F.format_string("%.2f", F.bround(v * 100, 2))
    pct0 = lambda v: F.format_string("%d", F.bround(v * 100, 0).cast("long"))
    num2 = lambda v: F.format_string("%.2f", F.bround(v, 2))
    f = dims.REJECT_FORMATS
    return (F.when(c("area") < c("min_area"), F.format_string(f["area"], pct2(c("area")), pct2(c("min_area"))))
            .when(c("fill") < c("min_fill"), F.format_string(f["fill"], pct0(c("fill")), pct0(c("min_fill"))))
            .when(c("confidence") < c("min_confidence"), F.format_string(f["confidence"], num2(c("confidence")), num2(c("min_confidence"))))
            .otherwise(""))


def funnel(detections: DataFrame, fixed_fill: float | None = None) -> DataFrame:
    """Passed and rejected detections per model and category."""
    g = F.col("gate")
    return (with_thresholds(detections).withColumn("gate", gate(fixed_fill)).groupBy("model", "category")
            .agg(F.count_if(g == "pass").alias("passed"), F.count_if(g == "area").alias("area"), F.count_if(g == "fill").alias("fill"),
                 F.count_if(g == "confidence").alias("confidence"), F.avg("confidence_value").alias("mean_confidence")))


def detection_rates(detections: DataFrame, photos: DataFrame, fixed_fill: float | None = None) -> DataFrame:
    """Passed detections over all photos, with or without a detection."""
    order = F.array(*[F.lit(c) for c in dims.CATEGORIES])
    table = funnel(detections.withColumn("confidence_value", F.col("confidence")), fixed_fill)
    total = photos.agg(F.count("*")).scalar()
    return table.select(
        "model", "category", F.array_position(order, F.col("category")).alias("place"), "passed", (F.col("passed") / total).alias("rate"), "mean_confidence")


def refine_selection(detections: DataFrame, requests: DataFrame, tie: list[str], most: int = dims.REFINE_LIMIT) -> DataFrame:
    """The detections that each photo's request asks to refine: the first ``most``, and how many were left out.

    ``detections``: photo, category, area, accepted and the ``tie`` columns.  ``requests``: photo, include_rejected, categories (an array, empty
    or null for all), overrides (a map from category to category, or null).  Accepted ones go first, larger ones first.
    """
    c = F.col
    asked = detections.join(requests, "photo").where(c("accepted") | F.coalesce("include_rejected", F.lit(False)))
    every = F.coalesce(F.size("categories"), F.lit(0)) <= 0
    asked = asked.where(every | F.array_contains(F.coalesce("categories", F.array().cast("array<string>")), c("category")))
    totals = asked.groupBy("photo").agg(F.greatest(F.lit(0).cast("long"), F.count("*") - most).alias("skipped"))
    first = top_k(asked, ["photo"], [F.desc("accepted"), F.desc("area"), *[c(t) for t in tie]], most)
    target = F.coalesce(F.try_element_at("overrides", c("category")), c("category"))
    return first.join(totals, "photo").withColumn("target", target)
