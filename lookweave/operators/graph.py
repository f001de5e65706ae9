"""Connected components by contraction: every round works on the vertices that are still undecided."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

JUMPS = 3  # doublings of the hooks within a round


def _hooks(edges: DataFrame, keys: Sequence[str], round_: int) -> DataFrame:
    """(keys, a, to): every vertex with a lower neighbour, and the vertex it reaches over up to 2^JUMPS hooks to lowest neighbours.

    The first order is that of the numbers, which settles flat components at once; later ones are hashes that change with the
    round, so hooks form shallow trees even along a chain of rising numbers.
    """
    rank = lambda x: F.struct(F.xxhash64(F.lit(round_), x) if round_ else F.lit(0).cast("long"), F.col(x))
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy(*keys, "a").agg(F.min(rank("b")).alias("low"))
    hooks = lowest.where(F.col("low") < rank("a")).select(*keys, "a", F.col("low")["b"].alias("to"))
    for _ in range(JUMPS):
        onward = hooks.select(*keys, F.col("a").alias("to"), F.col("to").alias("_next"))
        hooks = hooks.join(onward, [*keys, "to"], "left").select(*keys, "a", F.coalesce("_next", "to").alias("to"))
    return hooks


def components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, label) of every vertex whose label, the smallest vertex of its component, is not itself.

    ``edges``: keys, a, b; vertices are numbers within ``keys``.  A round hooks every vertex to its lowest neighbour, follows the
    hooks and draws the edges between what is left.  Components that are one vertex drop out, and from the second round
    on about a third of the vertices of the others stay, so the tables of the rounds shrink.  In the end the hooks are put together backwards.
    """
    def other(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges, rounds = materialize(other(edges)), []
    while not edges.isEmpty():
        hooks = materialize(_hooks(edges, keys, len(rounds)))
        rounds.append(hooks)
        for end in ("a", "b"):
            moved = hooks.select(*keys, F.col("a").alias(end), F.col("to").alias("_to"))
            edges = edges.join(moved, [*keys, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = materialize(other(edges))
    if not rounds:
        return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("label"))
    tops = rounds[-1]
    for hooks in reversed(rounds[:-1]):
        onward = tops.select(*keys, F.col("a").alias("to"), F.col("to").alias("_end"))
        own = hooks.join(onward, [*keys, "to"], "left").select(*keys, "a", F.coalesce("_end", "to").alias("to"))
        tops = materialize(own.join(tops.select(*keys, "a"), [*keys, "a"], "left_anti").unionByName(tops))
    tops = tops.where("a <> to")  # a hook may lead away from a vertex that the rounds come back to
    smallest: Column = F.least(F.min("a"), F.col("to"))
    labels = tops.groupBy(*keys, "to").agg(smallest.alias("label"))
    named = tops.unionByName(labels.select(*keys, F.col("to").alias("a"), "to")).join(labels, [*keys, "to"])
    return named.where("a <> label").select(*keys, F.col("a").alias("node"), "label")
