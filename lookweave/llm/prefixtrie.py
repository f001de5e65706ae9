"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is known by the length of its prefix and 128 bits that exclusive-or the hashes of (place, role, text) of its turns, so
prefixes come from running sums over chunks of a conversation and no text travels.  The tree is contracted in rounds: rake
takes all leaves and adds their totals to their parents; compress takes, of every chain of nodes with one child, those whose
depth has fewer trailing zero bits than both neighbours, and hangs their child to their parent.  Long chains halve and bushy
parts lose their leaves, so rounds follow the logarithm of the tree's size, whatever its shape.  Then the taken chain nodes come
back in the opposite order, each with its own sum and its child's total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..session import materialize, scratch

STEP, HEADS = 5, 9  # conversations that share a first one, and the numbers of its turns they may take
CHUNK = 1024  # turns of a conversation, or ids of a node, that one task looks at together

NODE = ["depth", "pa", "pb"]


def _turns(conversations: DataFrame) -> DataFrame:
    """c, pos (from 1), ha, hb and bytes of every turn; turns of equal number go by role, then by the text's md5."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn"), role.alias("role"), F.md5(text).alias("tie"), F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(role, text).alias("ha"), F.xxhash64(F.lit("second"), F.octet_length(text), text, role).alias("hb"))
    return number_rows(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")], "pos", ["c"]).select("c", "pos", "ha", "hb", "bytes")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, length) and their turns (c, depth, ha, hb, bytes) after the first ones are taken from a shared one."""
    own = turns.groupBy("c").agg(F.max("pos").alias("n")).withColumns({
        "h": (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS), "base": F.col("c") - F.col("c") % STEP})
    base = own.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = materialize(own.join(base, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))))
    heads = turns.where(F.col("pos") < HEADS).select(F.col("c").alias("base"), F.col("pos").alias("depth"), "ha", "hb", "bytes")
    taken = convs.select("c", "base", "h").join(heads, "base").where("depth <= h").select("c", "depth", "ha", "hb", "bytes")
    kept = turns.join(convs.select("c", "h", "k"), "c").where("pos > h").select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "ha", "hb", "bytes")
    return convs.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), taken.unionByName(kept)


def _prefixes(turns: DataFrame) -> DataFrame:
    """c, depth, bytes, the prefix's bits (pa, pb) and those of the prefix before it (qa, qb)."""
    rows = turns.select("c", "depth", "bytes", F.xxhash64("depth", "ha", "hb").alias("fa"), F.xxhash64(F.lit("second"), "hb", "ha", "depth").alias("fb"),
                        F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"))
    sums = rows.groupBy("c", "chunk").agg(F.bit_xor("fa").alias("ca"), F.bit_xor("fb").alias("cb"))
    later = sums.groupBy("c").agg(F.max("chunk").alias("last")).where("last > 0").select("c")
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.join(later, "c", "left_semi").select("c", "chunk", F.bit_xor("ca").over(before).alias("ca"), F.bit_xor("cb").over(before).alias("cb"))
    inside = Window.partitionBy("c", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"pa": F.bit_xor("fa").over(inside), "pb": F.bit_xor("fb").over(inside)}).join(carried, ["c", "chunk"], "left")
    rows = rows.withColumns({x: F.col(x).bitwiseXOR(F.coalesce(y, F.lit(0))) for x, y in (("pa", "ca"), ("pb", "cb"))})
    return rows.select("c", "depth", "bytes", "pa", "pb", F.col("pa").bitwiseXOR(F.col("fa")).alias("qa"), F.col("pb").bitwiseXOR(F.col("fb")).alias("qb"))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's chunks, which come in order; one running hash is held."""
    node, running, done = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
            if key != node:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(f",{ids}".encode())
    if node is not None:
        done.append((*node, running.hexdigest()))
    for at in range(0, len(done), 1 << 14):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done[at:at + (1 << 14)]), kinds)], names=[*NODE, "ends_sha256"])


def _ends(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """depth, pa, pb, ends_sha256 of the nodes where conversations end.

    Ids are joined in chunks of CHUNK by all tasks; only a node of more chunks is read in one stream, as its hash has to be.
    """
    whole = convs.where("length > 0").join(prefixes.select("c", F.col("depth").alias("length"), "pa", "pb"), ["c", "length"]).select("c", F.col("length").alias("depth"), "pa", "pb")
    empty = convs.where("length = 0").select("c", *[F.lit(0).cast("long").alias(x) for x in NODE])
    placed = number_rows(whole.unionByName(empty), [F.col("c")], "pos", NODE).withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK))
    parts = materialize(placed.groupBy(*NODE, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids")))
    large = materialize(parts.where("chunk = 1").select(*NODE))
    small = parts.join(large, NODE, "left_anti").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    streams = parts.join(large, NODE, "left_semi").select(*NODE, "chunk", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return small.unionByName(streams.mapInArrow(_hash_chunks, "depth long, pa long, pb long, ends_sha256 string"))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values) with every value summed over the node's subtree, itself included.

    ``tree``: id, parent (null at a root), depth (of the parent plus one) and the values, whole numbers.
    """
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    state = materialize(tree.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    done: list[DataFrame] = []  # rows whose total is known, of one round each
    taken: list[DataFrame] = []  # chain nodes, of one round each
    marks: list[int] = []  # rows of ``done`` before the round
    rank = F.struct(F.expr("bit_count((depth & -depth) - 1)"), F.xxhash64("id"), F.col("id"))
    while True:
        # rake
        leaves = state.where("kids = 0")
        done.append(leaves.select("id", *values))
        up = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("gone"), *[F.sum(v).alias(f"up_{v}") for v in values])
        rest = state.where("kids > 0").join(up, "id", "left")
        rest = materialize(rest.withColumns({"kids": F.col("kids") - F.coalesce("gone", F.lit(0)), **{v: F.col(v) + F.coalesce(f"up_{v}", F.lit(0)) for v in values}})
                           .drop("gone", *[f"up_{v}" for v in values]).withColumns({"chain": F.expr("kids = 1 AND parent IS NOT NULL"), "rank": rank}))
        if rest.isEmpty():
            break
        # compress
        above = rest.select(F.col("id").alias("parent"), F.col("chain").alias("p_chain"), F.col("rank").alias("p_rank"))
        placed = rest.where("parent IS NOT NULL").join(above, "parent")
        below = placed.where("p_chain").select(F.col("parent").alias("id"), F.col("id").alias("child"), F.col("chain").alias("c_chain"), F.col("rank").alias("c_rank"))
        out = placed.where("chain").join(below, "id").where("(NOT p_chain OR rank < p_rank) AND (NOT c_chain OR rank < c_rank)")
        out = materialize(out.select("id", "parent", "child", *values))
        zero = [F.lit(0).cast("long").alias(v) for v in values]
        none = F.lit(None).cast("long")
        changes = out.select(F.col("child").alias("id"), F.col("parent").alias("to"), F.lit(False).alias("out"), *zero)
        changes = changes.unionByName(out.select(F.col("parent").alias("id"), none.alias("to"), F.lit(False).alias("out"), *values))
        changes = changes.unionByName(out.select("id", none.alias("to"), F.lit(True).alias("out"), *zero))
        changes = changes.groupBy("id").agg(F.max("to").alias("to"), F.max("out").alias("out"), *[F.sum(v).alias(f"up_{v}") for v in values])
        state = rest.join(changes, "id", "left").where("out IS NULL OR NOT out")
        state = materialize(state.select("id", F.coalesce("to", "parent").alias("parent"), "depth", *[(F.col(v) + F.coalesce(f"up_{v}", F.lit(0))).alias(v) for v in values], "kids"))
        taken.append(out)
        marks.append(len(done))
    later = done[marks[-1]:] if marks else []
    for round_, out in reversed(list(enumerate(taken))):
        totals = reduce(DataFrame.unionByName, later).select(F.col("id").alias("child"), *[F.col(v).alias(f"c_{v}") for v in values])
        found = materialize(out.join(totals, "child").select("id", *[(F.col(v) + F.col(f"c_{v}")).alias(v) for v in values]))
        later = [*done[marks[round_ - 1] if round_ else 0:marks[round_]], found, *later]
    return reduce(DataFrame.unionByName, later or done)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations``: conv_id, turn, role, text; other columns are ignored.  Rows without conv_id belong to no conversation.
    Turns go by number, null first, equal ones by role and the md5 of the text, so repeated rows are turns of their own; a null
    role or text is empty.  An id's conversation may take all its turns from the shared one or have none left; it is then a member of
    the root alone.  An empty table has no nodes, not even a root.
    """
    with scratch(conversations.sparkSession) as keep:
        turns = materialize(_turns(conversations))
        convs, rows = _rebuilt(turns)
        convs, prefixes = materialize(convs), materialize(_prefixes(rows))
        nodes = prefixes.groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("qa").alias("qa"), F.max("qb").alias("qb"))
        zero = F.lit(0).cast("long")
        root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*[zero.alias(x) for x in NODE], "conv_id", "n_convs", zero.alias("bytes"), zero.alias("qa"), zero.alias("qb"))
        nodes = materialize(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        nodes = nodes.join(above, ["depth", "qa", "qb"], "left").drop("qa", "qb")
        children = materialize(nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children")).where("id IS NOT NULL"))
        nodes = materialize(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
        tree = nodes.select("id", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
        totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
        out = nodes.join(totals, "id").join(_ends(convs, prefixes), NODE, "left")
        return keep(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
