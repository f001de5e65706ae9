"""Exact top-k inner products by vector-approximation files.

Every vector is a row of cell codes, one byte a dimension, of a grid over the values' range, beside the table of its exact
integers.  Queries meet the codes in blocks: the cells bound a score from both sides, and a row whose upper bound is below
the k-th best lower bound is out.  The survivors' exact vectors are read in the order of their upper bounds, a first
wave of ``WAVE`` per query, then every row that the k-th exact score of the wave doesn't rule out.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch

SCALE = 1024
CELLS = 64  # to a dimension
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
WAVE = 3  # times k
LARGEST = 1 << 53
FLOAT = 1e-12  # relative error of a sum of products, with room to spare


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the components as floor(1024 * x); rows with a null vector or a null, NaN or infinite component are out.

    Components beyond 2^53 on either side, where doubles no longer tell whole numbers apart, count as 2^53.
    """
    vector = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.col(column).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x * SCALE))
    return rows.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(held(x))).cast("array<long>").alias("v"))


def _codes(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, scale (integers to a cell) and code (bytes) of every vector.

    The grid of a vector spans its own range, so one wide vector does not coarsen the others.
    """
    low, high = F.coalesce(F.array_min("v"), F.lit(0)), F.coalesce(F.array_max("v"), F.lit(0))
    step = F.greatest(F.lit(1), F.ceil((high - low + 1) / CELLS)).cast("long")
    cells = F.transform("v", lambda x: F.floor((x - low) / step).cast("int"))
    code = F.unhex(F.concat_ws("", F.transform(cells, lambda c: F.lpad(F.hex(c), 2, "0"))))
    return vectors.select("vec_id", F.size("v").alias("dim"), low.alias("low"), step.alias("step"), code.alias("code"))


def _exact(a: Column, b: Column) -> Column:
    """The whole inner product; it is counted in 38 digits and ends at the limits of a long."""
    digits = "decimal(38,0)"
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast(digits)), F.lit(0).cast(digits), lambda s, x: (s + x).cast(digits))
    ends = [F.lit(Decimal(n)).cast(digits) for n in (-(1 << 63), (1 << 63) - 1)]
    return F.greatest(ends[0], F.least(ends[1], total)).cast("long")


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products per query, ties to the smaller vec_id.

    ``rows`` and ``queries`` are (vec_id, v).  A query meets every row of its dimension but those of its own id; queries
    with fewer than k such rows get all of them.  Repeated rows of one id are candidates each for itself, while a repeated
    query is asked once.  Empty tables give no rows.  Scores are exact; beyond the limits of a long
    they count as the limit, ties then going to the smaller vec_id as always.
    """
    with scratch(rows.sparkSession) as keep:
        return keep(_top_k(rows, queries.dropDuplicates(["vec_id"]), k))


def _top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    stored = materialize(rows)
    row_blocks = max(1, -(-stored.count() // ROW_BLOCK))
    asked = materialize(queries)
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    codes = _codes(stored).select("*", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("rb"))
    codes = codes.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    blocks = asked.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    blocks = blocks.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, own in left.assign(dim=left["v"].map(len)).groupby("dim"):
            held = right[right["dim"] == dim]
            if not len(held):
                continue
            q = np.array(own["v"].tolist(), dtype=np.float64).reshape(len(own), dim)
            ids = held["vec_id"].to_numpy()
            low, step = (held[c].to_numpy(np.float64)[:, None] for c in ("low", "step"))
            cell = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), dim)
            floor = low + cell * step  # the smallest value of the cell; the largest is step - 1 more
            under, over = np.minimum(q, 0), np.maximum(q, 0)
            base, width = q @ floor.T, (step - 1).T
            upper, lower = base + over.sum(axis=1)[:, None] * width, base + under.sum(axis=1)[:, None] * width
            slack = FLOAT * (np.abs(q).sum(axis=1)[:, None] * np.abs(floor).max(axis=1, initial=0)[None, :] + over.sum(axis=1)[:, None] * width - under.sum(axis=1)[:, None] * width)
            upper, lower = upper + slack, lower - slack  # what sums of large doubles may be off
            itself = own["query_id"].to_numpy()[:, None] == ids[None, :]
            lower[itself] = -np.inf
            cut = np.partition(lower, -k, axis=1)[:, -k][:, None] if len(held) > k else -np.inf
            at, to = np.nonzero((upper >= cut) & ~itself)
            out.append(pd.DataFrame({"query_id": own["query_id"].to_numpy()[at], "vec_id": ids[to], "lower": lower[at, to], "upper": upper[at, to]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "lower": [], "upper": []})

    met = blocks.groupBy("qb", "rb").cogroup(codes.groupBy("qb", "rb")).applyInPandas(bound, "query_id long, vec_id long, lower double, upper double")
    met = materialize(met)
    by_query = Window.partitionBy("query_id")
    kth = met.withColumn("at", F.row_number().over(by_query.orderBy(F.desc("lower")))).where(F.col("at") == k).select("query_id", F.col("lower").alias("cut"))
    left = met.join(kth, "query_id", "left").where("cut IS NULL OR upper >= cut").select("query_id", "vec_id", "upper").distinct()
    ordered = left.withColumn("turn", F.row_number().over(by_query.orderBy(F.desc("upper"), "vec_id")))
    ordered = materialize(ordered)
    first = _read(ordered.where(F.col("turn") <= WAVE * k), asked, stored)
    certain = first.withColumn("at", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("at") == k).select("query_id", F.col("score").alias("kth"))
    later = ordered.where(F.col("turn") > WAVE * k).join(certain, "query_id", "left").where("kth IS NULL OR upper >= kth").select("query_id", "vec_id", "upper", "turn")
    best = first.union(_read(later, asked, stored))
    ranked = best.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _read(wanted: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Exact scores of the wanted pairs."""
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = wanted.join(rows, "vec_id").join(asked, "query_id").where(F.size("q") == F.size("v"))
    return pairs.select("query_id", "vec_id", _exact(F.col("q"), F.col("v")).alias("score"))
