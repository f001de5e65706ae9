"""Numbering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.text import pad3
from ..operators import quality, ranking
from ..operators.catalog import dense_renumber
from .bindings import view
from .registry import query


@query("renumber", f"""
SELECT photo, line, part, CAST(n AS BIGINT) AS rank, concat('look-', CASE WHEN n > 99 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END) AS file, concat('{dims.GARMENT_ID}-', photo, '-', category) AS id
FROM (SELECT *, row_number() OVER (ORDER BY round(area * confidence, 9) DESC, photo, line, part) AS n FROM gate_v WHERE gate = 'pass')""")
def renumber(spark, sf):
    """Accepted garments numbered by area times confidence."""
    rows = quality.with_thresholds(view(spark, sf, "det_v")).where(quality.gate() == "pass")
    rows = rows.withColumn("weight", F.round(F.col("area") * F.col("confidence"), 9))
    ranked = dense_renumber(rows, [F.desc("weight"), F.col("photo"), F.col("line"), F.col("part")])
    return ranked.select("photo", "line", "part", "rank", F.concat(F.lit("look-"), pad3(F.col("rank"))).alias("file"),
                         F.concat_ws("-", F.lit(dims.GARMENT_ID), F.col("photo").cast("string"), F.col("category")).alias("id"))


PAGE = 24
_LISTED = f"""SELECT *, count(*) OVER () AS total FROM (SELECT source_rank, id, name, CAST(row_number() OVER (ORDER BY source_rank, id) AS BIGINT) AS n
  FROM (SELECT coalesce(source_rank, 999) AS source_rank, id, name FROM item_v WHERE NOT deleted AND (gender = 'all' OR gender = 'women' OR user_added)))"""


def _wardrobe(spark, sf):
    """What a woman's wardrobe lists, by rank."""
    shown = view(spark, sf, "item_v").where("NOT deleted AND (gender = 'all' OR gender = 'women' OR user_added)")
    return shown.select(F.coalesce("source_rank", F.lit(999)).alias("source_rank"), "id", "name")


@query("wardrobe_pages", f"""
SELECT CAST((n - 1) // {PAGE} AS BIGINT) AS page, count(*) AS rows, arg_min(id, n) AS first_id, arg_max(id, n) AS last_id, max(n) < any_value(total) AS more FROM ({_LISTED}) GROUP BY 1""")
def wardrobe_pages(spark, sf):
    """Bounds of every page of the wardrobe."""
    bounds = ranking.page_bounds(_wardrobe(spark, sf), ["source_rank", "id"], PAGE)
    return bounds.select("page", "rows", F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"), "more")


@query("wardrobe_page", f"""
SELECT page, CAST(n - page * {PAGE} AS INT) AS place, id, name, page < last AS more FROM (SELECT *, CAST((n - 1) // {PAGE} AS BIGINT) AS page, CAST((total - 1) // {PAGE} AS BIGINT) AS last FROM ({_LISTED}))
WHERE page IN (0, last // 2, last)""")
def wardrobe_page(spark, sf):
    """First, middle and last page of the wardrobe."""
    listed = _wardrobe(spark, sf)
    bounds = ranking.page_bounds(listed, ["source_rank", "id"], PAGE)
    last = bounds.agg(F.max("page")).first()[0] or 0
    pages = [ranking.page(listed, bounds, n) for n in sorted({0, last // 2, last})]
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out.select("page", "place", "id", "name", "more")
