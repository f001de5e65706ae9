"""Deduplication: first row per key, and rows that clash on either of two keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import first_per


def first_by(rows: DataFrame, key: str, order: Column, keep: list[str]) -> DataFrame:
    return first_per(rows, [key], order, keep)


def first_by_two_keys(rows: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Rows kept by a scan in ``order`` that skips a row when a kept row has its first or second key.

    Rounds instead of a scan: a row that is earliest for both of its keys among the open
    rows is certainly kept, and rows sharing a key with a kept row are certainly skipped.
    """
    open_rows, kept = materialize(rows.select(order, first, second)), None
    while not open_rows.isEmpty():
        heads = [open_rows.groupBy(k).agg(F.min(order).alias(order)) for k in (first, second)]
        chosen = open_rows.join(heads[0], [first, order], "left_semi").join(heads[1], [second, order], "left_semi")
        chosen = materialize(chosen)
        kept = chosen if kept is None else kept.unionByName(chosen)
        open_rows = materialize(open_rows.join(chosen.select(first), first, "left_anti").join(chosen.select(second), second, "left_anti"))
    return rows.where("false").select(order, first, second) if kept is None else kept
