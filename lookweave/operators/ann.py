"""Approximate nearest neighbours: an inverted file over coarse centroids, kept as tables.

Centroids are a bounded sample of the rows themselves.  Every row is stored in its nearest lists, every query reads the rows
of the lists nearest to it and ranks them by exact cosine.  Lists of many rows are cut into parts and meet their queries on
a grid, so neither a crowded list nor a popular one becomes one task.  ``operators.vectors.top_similar`` is the exact way,
``recall`` compares the two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import top_k
from .vectors import BLOCK, _block_top

MOST = 4096  # centroids at most: what travels to every task
DENSITY = 4  # centroids for n rows: DENSITY x sqrt(n)
COPIES = 3  # lists that store a row
SHARE = 0.4  # of the lists of its family that a query reads; vectors without any structure need that many
CELLS = 1 << 20  # cosines that a task holds at a time, whatever the size of its batches
REST = -1  # list of rows that have no centroid of their family and length


@dataclass(frozen=True)
class Index:
    """``centroids``: list, family, vector.  ``lists``: list, id, family, vector."""

    centroids: DataFrame
    lists: DataFrame


def _nearest(rows: DataFrame, key: str, centroids: DataFrame, wanted) -> DataFrame:
    """(list, key, family, vector) with the first ``wanted(number of comparable centroids)`` lists of every row, ties to the smaller list."""
    held: dict[tuple, list] = {}
    for c in centroids.orderBy("list").collect():  # MOST rows at most
        held.setdefault((c["family"], len(c["vector"])), []).append((c["list"], c["vector"]))
    known = {kind: (np.array([x for x, _ in v]), np.array([x for _, x in v], dtype="float64")) for kind, v in held.items()}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, own in frame.groupby([frame["family"], frame["vector"].map(len)], dropna=False):
                if kind not in known:
                    out.append(own.assign(list=REST))
                    continue
                numbers, c = known[kind]
                n = min(len(numbers), wanted(len(numbers)))
                step = max(1, CELLS // len(numbers))
                for at in range(0, len(own), step):
                    part = own.iloc[at:at + step]
                    v = np.stack(part["vector"].to_numpy()).astype("float64")
                    cosines = np.round(v @ c.T / np.maximum(1e-12, np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(c, axis=1))), 9)
                    first = np.argsort(-cosines, axis=1, kind="stable")[:, :n]
                    yield part.loc[part.index.repeat(n)].assign(list=numbers[first].ravel())[["list", key, "family", "vector"]]
            if out:
                yield pd.concat(out)[["list", key, "family", "vector"]]

    return rows.select(key, "family", "vector").mapInPandas(place, f"list long, {key} long, family string, vector array<double>")


def build(rows: DataFrame) -> Index:
    """Index of ``rows`` (id, family, vector): every row is stored, none is sampled away.

    The centroids are the min(MOST, DENSITY x sqrt(rows)) rows whose ids have the smallest md5; empty vectors are never
    centroids.  Rows without a centroid of their family and length go to a list that every query of that family reads.
    """
    stored = rows.select("id", "family", "vector").where("vector IS NOT NULL AND family IS NOT NULL")
    some = min(MOST, math.ceil(DENSITY * math.sqrt(stored.count())))
    first = stored.where(F.size("vector") > 0).orderBy(F.md5(F.col("id").cast("string")), "id").limit(some)
    centroids = materialize(first.select(F.monotonically_increasing_id().alias("list"), "family", "vector"))
    return Index(centroids, materialize(_nearest(stored, "id", centroids, lambda n: COPIES)))


def add(index: Index, rows: DataFrame) -> Index:
    """The index with more rows, placed by the same centroids; stored rows stay where they are."""
    new = _nearest(rows.where("vector IS NOT NULL AND family IS NOT NULL"), "id", index.centroids, lambda n: COPIES)
    return Index(index.centroids, materialize(index.lists.unionByName(new)))


def search(index: Index, queries: DataFrame, k: int, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(query, id, cosine, rank): the best ``k`` stored rows of the lists that every query (query, family, vector) reads.

    ``share`` of the lists of its family are read, 1.0 makes the search exact.  A list of more than ``block`` rows or
    queries is cut, and every pair of cuts is a task of its own.
    """
    asked = _nearest(queries, "query", index.centroids, lambda n: math.ceil(share * n))
    rest = queries.select(F.lit(REST).cast("long").alias("list"), "query", "family", "vector")
    asked = materialize(asked.where(F.col("list") != REST).unionByName(rest))
    cuts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / block).cast("long").alias(name))
    sizes = materialize(cuts(index.lists, "parts").join(cuts(asked, "groups"), "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    right = index.lists.join(sizes, "list").withColumn("part", spread("id", "parts")).withColumn("group", every("groups"))
    left = asked.join(sizes, "list").withColumn("group", spread("query", "groups")).withColumn("part", every("parts"))
    columns = ["list", "part", "group"]

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _block_top(a, b, k)

    met = left.select(*columns, "query", "family", "vector").groupBy(*columns).cogroup(right.select(*columns, "id", "family", "vector").groupBy(*columns))
    found = met.applyInPandas(cell, "query long, id long, cosine double").distinct()  # a row stored in two lists is found twice
    return top_k(found, ["query"], [F.desc("cosine"), F.col("id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, expected, hits): how many of the exact neighbours of every query were found."""
    hit = found.select("query", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("expected"), F.count("hit").alias("hits"))
