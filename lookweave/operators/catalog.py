"""Catalogue jobs: quotas, overlays, corrections, numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import infer_category, pad3
from .ranking import first_per, number_rows, top_k


def quota_per_group(rows: DataFrame, key: str, group: str, order: str, quota: int) -> DataFrame:
    """First row per key, then the first ``quota`` rows of every group."""
    unique = first_per(rows, [key], F.col(order), [group, order])
    return top_k(unique, [group], [F.col(order)], quota, "n")


def wearable(name: Column, label: Column) -> Column:
    """Products of a known category whose name is not that of another kind of goods."""
    return ~F.regexp_like(F.coalesce(name, F.lit("")), F.lit(f"(?i){dims.NOT_WEARABLE}")) & (F.coalesce(infer_category(name, label), F.lit("")) != "")


def quota_fill(feed: DataFrame, quotas: dict[int, int], additions: int) -> DataFrame:
    """Sources in turn take their best products that no earlier source took, ``additions`` in all.

    Earlier sources can take at most the sum of the quotas, so each source's first
    ``sum(quotas)`` products decide the outcome.  That shortlist is bounded by the quotas
    alone and is walked once, in order.
    """
    total = sum(quotas.values())
    short = top_k(feed.where(F.col("source").isin(list(quotas))), ["source"], [F.col("rank"), F.col("product")], total, "n")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for source, quota in quotas.items():
            mine = group[group["source"] == source].sort_values("n")
            fresh = mine[~mine["product"].isin(taken)].head(min(quota, additions - len(taken)))
            taken.update(fresh["product"])
            rows.append(fresh)
        return pd.concat(rows)

    columns = feed.select("source", "product", "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    return short.select("source", "product", "rank", "n").withColumn("all", F.lit(1)).groupBy("all").applyInPandas(
        lambda g: fill(g)[["source", "product", "rank"]], schema)


def overlay_merge(base: DataFrame, stored: DataFrame, tombstones: DataFrame, key: str, overridden: list[str]) -> DataFrame:
    """Stored values win over base values, stored-only rows are appended, deleted rows leave."""
    s = stored.select(key, *[F.col(c).alias(f"_s_{c}") for c in overridden])
    merged = base.join(s, key, "full").select(
        key, *[F.coalesce(f"_s_{c}", c).alias(c) for c in overridden], *[c for c in base.columns if c not in (key, *overridden)])
    return merged.join(tombstones, key, "left_anti")


def dense_renumber(rows: DataFrame, order: list[Column]) -> DataFrame:
    """1, 2, 3 … over all rows in the given order."""
    return number_rows(rows, order, "rank")


def apply_overrides(items: DataFrame, fixes: DataFrame, subcategory: str) -> DataFrame:
    """Category corrections joined on the number in the image name; changed rows get a new subcategory and name.

    ``fixes``: (number, fixed).
    """
    c = F.col
    numbered = items.withColumn("number", F.regexp_extract("image", r"look-(\d+)", 1).cast("long"))
    joined = numbered.join(fixes, "number", "left").withColumn("_category", F.coalesce("fixed", "category"))
    changed = c("_category") != c("category")
    return joined.select(
        *[n for n in items.columns if n not in ("category", "name", "subcategory")], changed.alias("changed"),
        F.when(~changed, c(subcategory)).when(c("fixed") == "아우터", "재킷·가디건").otherwise(c("fixed")).alias("subcategory"),
        F.concat_ws(" ", "color", "_category", pad3(c("id"))).alias("name"), c("_category").alias("category"))


def correct_sources(sources: DataFrame, corrected: DataFrame) -> DataFrame:
    """Source records with the fields of the corrected catalogue item of the same rank, and how many categories changed in all.

    The image paths of the two differ, so the rank joins them.  A corrected record loses its brand; one without an item stays.
    """
    fields = ["category", "subcategory", "color", "name"]
    new = corrected.select("rank", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    updated = F.coalesce("_hit", F.lit(False))
    joined = sources.join(new, "rank", "left").withColumns({**{f: F.when(updated, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}, "brand": F.when(~updated, F.col("brand")), "updated": updated})
    changed = corrected.agg(F.count_if("changed").alias("changed_categories"))  # one row
    return joined.drop("_hit", *[f"_{f}" for f in fields]).join(F.broadcast(changed), F.lit(True))


def short_groups(rows: DataFrame, key: str, group: str, wanted: DataFrame) -> DataFrame:
    """Groups of ``wanted`` (group, least) with fewer different keys than they need: group, found, least.  Rows without a group are one."""
    found = rows.groupBy(F.col(group).alias("_group")).agg(F.count_distinct(key).alias("found"))
    joined = wanted.join(found, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(0))).where("found < least").select(group, "found", "least")


def backfill(pieces: DataFrame, refined: DataFrame, keys: list[str], order: str, image: str, vector: str) -> DataFrame:
    """Latest refined image per key joined to the pieces; a new image makes the stored vector stale."""
    last = refined.groupBy(*keys).agg(F.max_by(image, order).alias(image))
    return pieces.join(last, keys, "left").withColumn(vector, F.when(F.col(image).isNull(), F.col(vector)))
