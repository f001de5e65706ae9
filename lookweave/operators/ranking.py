"""Ranking: numbering that survives hot groups, and bounded top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def number_rows(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row, overall or within ``keys``.

    A range sort spreads even a single huge group over all tasks.  The sorted rows are
    written once, so the partition offsets and the rows they number cannot disagree; the
    offset table has one row per partition.
    """
    placed = materialize(df.sort(*[F.col(k) for k in keys], *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _SHIFT)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = placed.withColumn("_part", part)
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(
        "_pos", F.col("_offset") + F.col("_at").bitwiseAND((1 << _SHIFT) - 1) + 1).drop("_at", "_part", "_offset")
    if not keys:
        return numbered.withColumnRenamed("_pos", name)
    starts = numbered.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    return numbered.join(starts, list(keys)).withColumn(name, F.col("_pos") - F.col("_start") + 1).drop("_pos", "_start")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows per key; the limit is applied before the shuffle as well."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def first_per(df: DataFrame, keys: Sequence[str], by: Column, values: Sequence[str]) -> DataFrame:
    """Row with the smallest ``by`` per key, as a plain aggregate (hot keys combine before the shuffle)."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), by).alias("_v")).select(*keys, "_v.*")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Every row with the ``values`` of the row before it within ``keys`` as ``prev_*``, and its overall position ``n``.

    Rows meet on their position, which is spread evenly, instead of in one window per key.
    """
    numbered = materialize(number_rows(df, [*[F.col(k) for k in keys], *order], "n"))
    names = [*keys, *values]
    before = numbered.select((F.col("n") + 1).alias("n"), *[F.col(v).alias(f"prev_{v}") for v in names])
    joined = numbered.join(before, "n", "left")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"prev_{k}"))
    return joined.withColumns({f"prev_{v}": F.when(same, F.col(f"prev_{v}")) for v in names})


def last_marked(df: DataFrame, position: str, marked: Column, name: str, chunk: int = 100_000) -> DataFrame:
    """Position of the last marked row at or before every row, over the whole order.

    Positions are cut into chunks; a chunk inherits the last mark of the chunks before it
    from a table with one row per chunk.
    """
    rows = df.withColumns({"_mark": F.when(marked, F.col(position)), "_chunk": F.floor(F.col(position) / chunk)})
    tops = rows.groupBy("_chunk").agg(F.max("_mark").alias("_top"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_chunk", F.max("_top").over(earlier).alias("_carry"))
    inside = Window.partitionBy("_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, "_chunk").withColumn(name, F.coalesce(F.max("_mark").over(inside), "_carry")).drop("_mark", "_chunk", "_carry")


def page_bounds(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """One row per page of ``size`` rows in the order of ``keys`` (which name a row): page (from 0), rows, first and last key, more.

    Written once per listing; a page is then found by its keys, whatever lies before it.
    """
    numbered = number_rows(df.select(*keys), [F.col(k) for k in keys], "_n")
    key = F.struct(*keys)
    bounds = numbered.groupBy(F.floor((F.col("_n") - 1) / size).alias("page")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    following = bounds.select((F.col("page") - 1).alias("page"), F.lit(True).alias("_next"))
    return materialize(bounds.join(following, "page", "left").withColumn("more", F.coalesce("_next", F.lit(False))).drop("_next"))


def page(df: DataFrame, bounds: DataFrame, number: int) -> DataFrame:
    """The rows of one page with page, place (from 1) and more; no rows beyond the last page.

    The page's bounds are one row; rows are read by a filter on their keys, which reaches the scan, and no row is skipped.
    """
    known = bounds.where(F.col("page") == number).first()
    if known is None:
        return df.where("false").withColumns({"page": F.lit(number).cast("long"), "place": F.lit(0), "more": F.lit(False)})
    keys = list(known["first"].asDict())
    inside = df.where((F.col(keys[0]) >= known["first"][0]) & (F.col(keys[0]) <= known["last"][0]))
    if len(keys) > 1:
        ends = [F.struct(*[F.lit(known[e][k]).cast(df.schema[k].dataType).alias(k) for k in keys]) for e in ("first", "last")]
        inside = inside.where((F.struct(*keys) >= ends[0]) & (F.struct(*keys) <= ends[1]))
    place = F.row_number().over(Window.partitionBy("page").orderBy(*keys))  # a page holds ``size`` rows at most
    return inside.withColumn("page", F.lit(number).cast("long")).withColumns({"place": place, "more": F.lit(bool(known["more"]))})


def accepted_first(df: DataFrame, keys: Sequence[str], accepted: str, area: str, tie: Sequence[str], name: str = "place") -> DataFrame:
    """Position within ``keys``: accepted rows first, the larger area first among either, then by ``tie``."""
    return number_rows(df, [F.desc(accepted), F.desc(area), *[F.col(t) for t in tie]], name, keys)
