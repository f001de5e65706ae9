"""Filters and row-wise clean-up of catalogue, look and measurement rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def visible(gender: str | Column | None) -> Column:
    """Not deleted, and uploaded by the user or of a matching gender: a given one, that of a column, or any."""
    mine = F.lit(True) if gender is None else F.col("gender").isin("all", gender)
    return ~F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("user_added") | mine)


def search(category: str, text: str, columns: Sequence[str]) -> Column:
    wanted = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    hit = F.contains(hay, F.lit(wanted))
    return hit if category == dims.ALL_LABEL else hit & (F.col("category") == category)


def scope(items: DataFrame, only_mine: bool, categories: Sequence[str], limit: int, order: str) -> DataFrame:
    rows = items.where("user_added") if only_mine else items
    if categories:
        rows = rows.where(F.col("category").isin(list(categories)))
    return rows.orderBy(order).limit(limit)


def aspect_ok(stage: str, width: Column, height: Column) -> Column:
    """Rejects only sizes that are known and too small or too wide."""
    least_w, least_h, least_ratio = dims.ASPECT_RULES[stage]
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    return ~(known & ((width < least_w) | (height < least_h) | (height / width < least_ratio)))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def trusted(url: Column) -> Column:
    found = F.lit(False)
    for pattern in dims.TRUSTED_DOMAINS:
        found = found | host(url).rlike(pattern)
    return F.coalesce(found, F.lit(False))


def safe_url(url: Column) -> Column:
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), url).otherwise(F.lit(""))


def mentions(title: Column, name: Column, handle: Column) -> Column:
    squeeze = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    return F.contains(squeeze(title), squeeze(name)) | F.contains(squeeze(title), F.lower(handle))


def clean_list(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


PIECE = {"piece_id": "string", "label": "string", "layer": "string", "category": "string", "bbox": "array<double>", "confidence": "double", "subcategory": "string",
         **{n: "array<string>" for n in ("colors", "materials", "fits", "details")}, **{n: "string" for n in ("color", "material", "fit", "sleeve_length", "length", "pattern", "neckline")},
         "visual_embedding": "array<double>", "visual_embedding_engine": "string"}


def normalize_pieces(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw look pieces -> (usable pieces with all their fields, looks without any).

    ``raw``: look, pos and any of the columns of ``PIECE``; anything may be missing.  A list that is absent is replaced by the single
    value beside it (colors by color, and so on), an empty list stays empty.  A usable piece has a known category, a colour and
    a confidence of one half or more.
    """
    c = F.col
    raw = raw.withColumns({n: F.lit(None).cast(t) for n, t in PIECE.items() if n not in raw.columns})
    given = lambda name: F.nullif(c(name), F.lit(""))
    listed = lambda many, one: clean_list(F.coalesce(many, F.when(c(one).isNotNull(), F.array(one))))
    known = lambda name: F.coalesce(given(name), F.lit(dims.UNKNOWN)).alias(name)
    number = c("pos").cast("string")
    normal = raw.select(
        "look", "pos", F.coalesce(given("piece_id"), F.concat(F.lit("piece-"), number)).alias("piece_id"),
        F.coalesce(given("label"), given("subcategory"), given("category"), F.concat(F.lit("의류 "), number)).alias("label"),
        F.coalesce(given("layer"), F.lit("단독")).alias("layer"), F.trim(F.coalesce("category", F.lit(""))).alias("category"),
        F.when(F.size("bbox") == 4, F.transform("bbox", lambda v: clamp(F.coalesce(v, F.lit(0.0)), 0, 1000))).alias("bbox"),
        listed("colors", "color").alias("colors"), listed("materials", "material").alias("materials"), listed("fits", "fit").alias("fits"), clean_list(c("details")).alias("details"),
        known("sleeve_length"), known("length"), F.coalesce(given("subcategory"), given("label"), F.lit(dims.UNKNOWN)).alias("subcategory"), known("pattern"), known("neckline"),
        "visual_embedding", F.coalesce("visual_embedding_engine", F.lit("")).alias("visual_embedding_engine"),
        clamp(F.coalesce("confidence", F.lit(0.8)), 0, 1).alias("confidence"))
    good = c("category").isin(dims.CATEGORIES) & (F.size("colors") > 0) & (c("confidence") >= 0.5)
    counted = normal.groupBy("look").agg(F.bool_or(good).alias("any"))
    return normal.where(good), counted.where(~c("any")).select("look")


def violations(ranges: dict[str, tuple[float, float]] = dims.MEASURE_RANGES) -> Column:
    """Names of the measures that are given but out of range."""
    return F.array_compact(F.array(*[F.when(~F.col(m).between(lo, hi), F.lit(m)) for m, (lo, hi) in ranges.items()]))


def apply_analysis(category: Column, color: Column, found_category: Column, found_color: Column) -> tuple[Column, Column]:
    """Analysed category and colour replace the stored ones only when they are usable."""
    cat, col = F.trim(F.coalesce(found_category, F.lit(""))), F.trim(F.coalesce(found_color, F.lit("")))
    return (F.when(cat.isin(dims.CATEGORIES), cat).otherwise(category),
            F.when((col != "") & ~F.contains(col, F.lit(dims.UNKNOWN)), col).otherwise(color))


def relevance(title: Column, source: Column) -> Column:
    """Fashion relevance of a search hit: source bonus plus word weights."""
    lowered, where = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    bonus = None
    for domain, points in dims.RELEVANCE_SOURCES:
        hit = F.contains(where, F.lit(domain))
        bonus = F.when(hit, points) if bonus is None else bonus.when(hit, points)
    total = bonus.otherwise(0)
    for word, points in dims.RELEVANCE_WEIGHTS:
        total = total + F.when(F.contains(lowered, F.lit(word.lower())), points).otherwise(0)
    return total
