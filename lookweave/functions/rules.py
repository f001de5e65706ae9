"""Attribute rules: garment attributes read off the product name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .text import array_of, first_rule, lookup, matches


def seed_attributes(items: DataFrame, name: str = "name", category: str = "category", color: str = "color") -> DataFrame:
    """Add the rule-derived attributes.  Material and fit come first; the rest depends on them."""
    n = F.coalesce(F.col(name), F.lit(""))
    first = items.withColumns({
        "subcategory": first_rule(n, dims.SUBCATEGORY_RULES,
                                  F.when(F.coalesce(F.col(category), F.lit("")) == "", F.lit("의류")).otherwise(F.col(category))),
        "sleeve_length": first_rule(n, dims.SLEEVE_RULES, dims.UNKNOWN),
        "length": first_rule(n, dims.LENGTH_RULES, "기본"),
        "neckline": first_rule(n, dims.NECKLINE_RULES, "라운드넥"),
        "material": first_rule(n, dims.MATERIAL_RULES, "혼방"),
        "fit": first_rule(n, dims.FIT_RULES, "레귤러"),
        "pattern": first_rule(n, dims.PATTERN_RULES, "무지"),
        "primary_color": F.when(F.coalesce(F.col(color), F.lit("")) == "", F.lit(dims.UNSORTED_COLOR)).otherwise(F.col(color)),
    })
    material, fit = F.col("material"), F.col("fit")
    found = F.array_compact(F.array(*[F.when(matches(n, p), F.lit(v)) for p, v in dims.CONSTRUCTION_RULES]))
    second = first.withColumns({
        "texture": lookup(material, dims.TEXTURE_BY_MATERIAL, dims.DEFAULT_TEXTURE),
        "wrinkle": lookup(material, dims.WRINKLE_BY_MATERIAL, dims.DEFAULT_WRINKLE),
        "finish": F.when(matches(n, dims.WASHED_PATTERN), F.lit(dims.WASHED_FINISH))
        .when(material == "레더", F.lit(dims.LEATHER_FINISH))
        .when(matches(n, dims.GLOSS_PATTERN), F.lit(dims.GLOSS_FINISH)).otherwise(F.lit(dims.DEFAULT_FINISH)),
        "construction": F.when(F.size(found) > 0, found).otherwise(array_of([dims.DEFAULT_CONSTRUCTION])),
        "season": F.when((material == "나일론") & matches(n, dims.WINTER_PATTERN), array_of(dims.WINTER_SEASON))
        .when(matches(n, dims.SUMMER_PATTERN), array_of(dims.SUMMER_SEASON)).otherwise(array_of(dims.DEFAULT_SEASON)),
        "silhouette": lookup(fit, dims.SILHOUETTE_BY_FIT, dims.DEFAULT_SILHOUETTE),
        "weather": F.when(material == "나일론", array_of(dims.NYLON_WEATHER))
        .when(matches(n, dims.HOT_PATTERN), array_of(dims.HOT_WEATHER)).otherwise(array_of(dims.DEFAULT_WEATHER)),
    })
    return second.withColumn("summary", F.format_string(
        "%s %s. %s 핏, %s, %s, %s.", "primary_color", "subcategory", "fit", "texture", "finish", "wrinkle"))


def canonical_form(value: Column, category: Column) -> Column:
    return first_rule(F.concat_ws(" ", F.coalesce(value, F.lit("")), F.coalesce(category, F.lit(""))), dims.FORM_RULES, "unknown")
