"""Embedding tables: prototypes, exact top-k search, incremental encoding plans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.vectors import cosine, unit
from ..session import materialize

BLOCK = 2048  # vectors of either side that meet in one task


def prototypes(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key: (key, family, vector)."""
    parts = vectors.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    gathered = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p"))
    return gathered.select(key, F.lit("siglip").alias("family"), F.col("p.x").alias("vector"))


def prototype_cosines(protos: DataFrame, key: str) -> DataFrame:
    """(vec, r_vec, cosine) of the prototypes of one family.

    One row per class on either side, so the pair count follows the number of classes.
    """
    a = protos.select(F.col(key).alias("vec"), "family", F.col("vector").alias("va"))
    b = protos.select(F.col(key).alias("r_vec"), "family", F.col("vector").alias("vb"))
    return a.join(b, "family").select("vec", "r_vec", F.round(cosine(F.col("va"), F.col("vb")), 9).alias("cosine"))


def _block_top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best ``k`` rows per query within one block of rows; only vectors of one family and length compare."""
    kinds = lambda frame: [frame["family"], frame["vector"].map(len)]
    held = dict(iter(rows.groupby(kinds(rows)))) if len(rows) else {}
    out = []
    for kind, wanted in queries.groupby(kinds(queries)):
        if kind not in held or kind[1] == 0:
            continue
        same = held[kind].sort_values("id")
        q = np.stack(wanted["vector"].to_numpy()).astype("float64")
        v = np.stack(same["vector"].to_numpy()).astype("float64")
        scale = np.maximum(1e-12, np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)))
        scores = np.round(q @ v.T / scale, 9)
        n = min(k, scores.shape[1])
        kth = np.partition(scores, -n, axis=1)[:, -n]
        at, to = np.nonzero(scores >= kth[:, None])  # ties at the edge stay until they are ordered by id
        found = pd.DataFrame({"query": wanted["query"].to_numpy()[at], "id": same["id"].to_numpy()[to], "cosine": scores[at, to]})
        out.append(_best_of(found, k))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "cosine": []}).astype({"query": "int64", "id": "int64"})


def _best_of(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    return frame.sort_values(["query", "cosine", "id"], ascending=[True, False, True]).groupby("query").head(k)


def top_similar(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Exact ``k`` nearest rows by cosine for every query: (query, id, cosine, rank).

    ``queries``: query, family, vector.  ``rows``: id, family, vector.  Blocks of queries meet blocks of rows on a grid,
    whatever their number, and a cell holds about ``block`` vectors of either side.  It keeps its best ``k`` per query and a
    window, limited before its shuffle, picks the global ones.
    """
    q, v = materialize(queries.select("query", "family", "vector")), materialize(rows.select("id", "family", "vector"))
    counts = [max(1, -(-n // block)) for n in (q.count(), v.count())]
    spread = lambda df, key, name, n: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = spread(q, "query", "qb", counts[0]).withColumn("vb", every(counts[1]))
    right = spread(v, "id", "vb", counts[1]).withColumn("qb", every(counts[0]))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _block_top(a, b, k)

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(cell, "query long, id long, cosine double")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def normalized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("unit", unit(F.col(vector)))


def cached_vectors(items: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Items with the vector that may be reused: same id, model and content, or stored by the same engine."""
    hit = cache.where(F.col("model") == model).select("id", F.col("hash").alias("c_hash"), F.col("vector").alias("c_vector"))
    joined = items.join(hit, "id", "left")
    stored = F.when((F.col("stored_engine") == f"siglip:{model}") & (F.size("stored_vector") > 0), F.col("stored_vector"))
    return joined.withColumn("ready", F.coalesce(F.when(F.col("c_hash") == F.col("hash"), F.col("c_vector")), stored)).drop("c_hash", "c_vector")


def encode_plan(missing: DataFrame, key: str = "id", size: int = dims.EMBED_BATCH) -> DataFrame:
    """Batches of at most ``size`` items still to encode, in key order."""
    from .ranking import number_rows

    return number_rows(missing, [F.col(key)], "n").withColumn("batch", F.floor((F.col("n") - 1) / size)).drop("n")


def encode(batches: DataFrame, encoder, schema: str) -> DataFrame:
    """Run a pluggable encoder (an iterator of pandas frames) over the planned items."""
    return batches.mapInPandas(encoder, schema)


def best_pieces(items: DataFrame, pieces: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` pieces closest to every item: (id, piece, cosine, rank)."""
    found = top_similar(items.select(F.col("id").alias("query"), "family", "vector"), pieces.select(F.col("piece").alias("id"), "family", "vector"), k, block)
    return found.select(F.col("query").alias("id"), F.col("id").alias("piece"), "cosine", "rank")


PIVOTS = 6


def with_angles(rows: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """Angles to the pivots, null where the lengths differ."""
    angle = lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in p])))))
    return rows.withColumn("angles", F.array(*[F.when(F.size("vector") == len(p), angle(p)) for p in pivots]).cast("array<double>"))


def close_pairs(items: DataFrame, pieces: DataFrame, least: float, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Pairs (id, piece, cosine) of one family with a cosine of ``least`` or more, and the pairs (id, piece) that were computed for it.

    Angles obey the triangle inequality: two vectors within an angle of each other differ by no more than that in their angle to
    any third one.  Pairs meet on bins of the angle to the first pivot, three bins wide, and the other pivots rule out more
    before a cosine is computed; no pair above the threshold is lost.  The pivots are the pieces whose numbers have the smallest
    md5, ``pivots`` of them at most.
    """
    width = math.acos(least) + 1e-6  # more than the error of an arc cosine
    first = [r["vector"] for r in pieces.where(F.size("vector") > 0).orderBy(F.md5(F.col("piece").cast("string")), "piece").limit(pivots).select("vector").collect()]
    bins = lambda df: with_angles(df, first).withColumns({"dim": F.size("vector"), "bin": F.floor(F.coalesce(F.try_element_at("angles", F.lit(1)), F.lit(0.0)) / width)})
    left = bins(items.select("id", "family", "vector"))
    right = bins(pieces.select("piece", "family", "vector")).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    right = right.withColumnsRenamed({"vector": "p_vector", "angles": "p_angles"})
    apart = F.exists(F.zip_with("angles", "p_angles", lambda a, b: F.abs(a - b) > width), lambda x: F.coalesce(x, F.lit(False)))
    met = left.join(right, ["family", "dim", "bin"]).where(~apart)
    scored = met.withColumn("cosine", F.round(cosine(F.col("vector"), F.col("p_vector")), 9))
    return scored.where(F.col("cosine") >= least).select("id", "piece", "cosine"), met.select("id", "piece")


def relink_uploads(items: DataFrame, pieces: DataFrame) -> DataFrame:
    """``relink`` for uploads that have no reference look: items (id, family, vector, user_added, reference_look).

    A best score of ``relink_best`` bounds the cosine from below, so only items with such a piece get their two best pieces.
    """
    least = round(2 * dims.SIM["relink_best"] - 1, 9) - 1e-9
    mine = materialize(items.where("user_added AND reference_look IS NULL").select("id", "family", "vector"))
    pieces = materialize(pieces.select("piece", "family", "vector"))
    close, _ = close_pairs(mine, pieces, least)
    worth = materialize(mine.join(close.select("id").distinct(), "id", "left_semi"))
    return relink(best_pieces(worth, pieces, 2))


def relink(best: DataFrame) -> DataFrame:
    """Items whose best piece is close enough and clearly ahead of the second one."""
    s = dims.SIM
    at = lambda rank, value: F.max(F.when(F.col("rank") == rank, F.col(value)))
    rows = best.groupBy("id").agg(at(1, "piece").alias("piece"), at(1, "cosine").alias("_c1"), at(2, "cosine").alias("_c2"))
    scored = rows.select("id", "piece", F.round((F.col("_c1") + 1) / 2, 9).alias("best"), F.round(F.coalesce((F.col("_c1") - F.col("_c2")) / 2, F.lit(1.0)), 9).alias("gap"))
    return scored.where((F.col("best") >= s["relink_best"]) & (F.col("gap") >= s["relink_gap"])).withColumn("takes_category", F.col("best") >= s["relink_category"])


def stale(stored: DataFrame, replaced: DataFrame, version: int) -> DataFrame:
    """Mark vectors whose image was replaced or whose analysis version is another one."""
    marked = stored.join(replaced.distinct().withColumn("_r", F.lit(True)), "id", "left")
    return marked.withColumn("state", F.when(F.col("_r"), "replaced image").when(F.col("version") != version, "old version").otherwise("valid")).drop("_r")
