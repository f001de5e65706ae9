"""Near-duplicate groups by an LSH forest, links confirmed on full shingle sets.

A class is a distinct shingle set.  Every class has one MinHash signature; a tree of the forest sorts the classes by
its own order of the signature values.  Classes that share a tree's first ``DEPTH`` values are a region of it.  A region
of at most ``SMALL`` classes yields all its pairs; a larger one is searched deeper: the sort puts the longest common
prefixes side by side, and each class meets its ``NEAR`` neighbours.  After the links of these pairs are confirmed, larger
regions that still hold several groups are compared in blocks, everything outside a region's main group against the
whole region, so the neighbour limit costs no link.  A pair at the threshold .85 shares no region of any tree with
probability (1 - .85 ** 4) ** 16 < 1e-5.

Sorted rows are numbered by position and cut into equal blocks with a halo, so a region may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..session import materialize, scratch
from .common import FILTER_BITS, bit_filter, passing, slices, words_of
from .graph import components

WIDTH = 5
TREES, DEPTH, KEY = 16, 4, 6  # trees, values that make a region, values that order a tree
VALUES = TREES * DEPTH
SMALL, NEAR = 12, 2
BLOCK, HALO = 8192, 2 * SMALL
AGREE = 38  # of 64 values; a pair at .85 agrees on fewer with probability below 1e-6
SET_BLOCK = 1 << 20  # shingles to a task's group of confirmations

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(20260101)
_MULTIPLY = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h = h * _MIX
    return h ^ h >> np.uint64(32)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A text of fewer words is one shingle; without words there is none.  Equal hashes stand for equal shingles: within a
    pair of documents a collision has a probability of about (shingles / 2^32)^2.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=1)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = h[:n].copy()
    for k in range(1, width):
        s = s * _FACTOR + h[k:k + n]
    return np.unique(_mixed(s))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of ``VALUES`` hash functions over the set, in slices of bounded size."""
    low, out = hashes.astype(np.uint32), np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (low[None, at:at + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, n (set size), mark (128-bit fingerprint of the set), sig (64 values; null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ns, marks, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                ns.append(len(s))
                marks.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(marks, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, mark binary, sig binary")


def _forest(classes: DataFrame) -> DataFrame:
    """One row per class and tree: tree, key (the values that order it), node."""
    schema = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            if n:
                # big-endian, so that the order of the bytes is that of the values
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, VALUES).astype(">u4")
                for tree in range(TREES):
                    at = (np.arange(KEY) + tree * DEPTH) % VALUES
                    keys = np.ascontiguousarray(sig[:, at]).view(f"V{4 * KEY}").ravel().tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), pa.array(keys, pa.binary()), batch.column(0)], schema=schema)

    return classes.select("node", "sig").mapInArrow(run, "tree int, key binary, node long")


def _neighbours(block: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) of a block's own rows with rows before them, and (a, region) of rows in large regions."""
    block = block.sort_values("pos")
    node, own = block["node"].to_numpy(), (block["pos"] // BLOCK == block["block"]).to_numpy()
    region = np.array([t.to_bytes(2, "big") + k[:4 * DEPTH] for t, k in zip(block["tree"], block["key"])], dtype=object)
    n = len(node)
    start = np.r_[True, region[1:] != region[:-1]] if n else np.empty(0, bool)
    run = np.cumsum(start) - 1
    large = np.bincount(run, minlength=1)[run] > SMALL
    out = []
    for step in range(1, SMALL):
        hit = np.flatnonzero((run[step:] == run[:-step]) & own[step:] & (~large[step:] | (step <= NEAR))) if n > step else []
        if len(hit):
            a, b = node[hit], node[hit + step]
            out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "region": None}).query("a != b"))
    at = np.flatnonzero(large & own)
    out.append(pd.DataFrame({"a": node[at], "b": pd.array([None] * len(at), "Int64"), "region": region[at]}))
    return pd.concat(out)


def _halo(pos: Column) -> Column:
    own, within = F.floor(pos / BLOCK).cast("long"), pos % BLOCK
    return F.array_compact(F.array(own, F.when((within < HALO) & (own > 0), own - 1), F.when(within >= BLOCK - HALO, own + 1)))


def _sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the documents that take part in a comparison."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << FILTER_BITS))
    bitmap = bit_filter(nodes.select(place("node").alias("slot")), "slot")
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            few = batch.take(pa.array(passing(bitmap, batch.column(2).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array([shingles(t).tobytes() for t in few.column(1).to_pylist()], pa.binary())], schema=schema)

    held = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place("doc_id").alias("slot"))
    return held.mapInArrow(run, "node long, hashes binary").join(nodes, "node", "left_semi")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of stars that connect what the confirmed pairs connect.

    Pairs are gathered by the smallest neighbour of their first node, so a set travels to one place for a whole group;
    a group is cut into parts of about ``SET_BLOCK`` shingles.
    """
    lowest = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("low"))
    placed = pairs.join(lowest, "a", "left").withColumn("low", F.coalesce("low", "a"))
    parts = placed.groupBy("low").agg(F.ceil(F.sum("weight") / SET_BLOCK).alias("parts"))
    placed = placed.join(parts, "low").select("low", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), "a", "b")
    needed = placed.select(F.col("low").alias("low"), F.col("part").alias("part"), F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list[np.ndarray]] = {}
        for node, hashes in zip(right["node"], right["hashes"]):
            held.setdefault(node, []).append(np.frombuffer(hashes, np.uint64))
        root: dict[int, int] = {}

        for a, b in zip(left["a"], left["b"]):
            x, y = _find(root, a), _find(root, b)
            if x != y and any(_linked(p, q, percent) for p in held.get(a, ()) for q in held.get(b, ())):
                root[max(x, y)] = min(x, y)
        return _stars(root)

    return placed.groupBy("low", "part").cogroup(needed.groupBy("low", "part")).applyInPandas(check, "a long, b long")


def _find(root: dict[int, int], x: int) -> int:
    while root.setdefault(x, x) != x:
        root[x] = x = root[root[x]]
    return x


def _stars(root: dict[int, int]) -> pd.DataFrame:
    return pd.DataFrame([(x, _find(root, x)) for x in list(root) if root[x] != x], columns=["a", "b"], dtype="int64")


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _remaining(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between groups that neighbours may have missed: in a large region, its main group against the others.

    Every class outside a region's main group is held against the whole region, in blocks of about ``SET_BLOCK`` shingles
    on either side: signatures first, sets where enough values agree.  A pair that shares an earlier tree's region was
    held together there.  A task returns the groups it joins, not their pairs.
    """
    known = members.join(labels, "node", "left").select("region", "node", F.coalesce("label", "node").alias("label"))
    full = known.join(classes.select("node", "n", "sig"), "node")
    groups = full.groupBy("region", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    split = groups.groupBy("region").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most"), F.sum("n").alias("n")).where("all > most")
    count = F.ceil(F.col("n") / SET_BLOCK).cast("int")
    full = full.join(split.select("region", "main", count.alias("blocks")), "region").join(sets, "node")
    turn, every = F.pmod(F.xxhash64("node", "region"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    kept = [F.col(c).alias(c) for c in ("region", "node", "label", "sig", "hashes")]
    rows = full.select(*kept, turn.alias("block"), every.alias("other"))
    odd = full.where("label <> main").select(*kept, every.alias("block"), turn.alias("other"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}
        if len(left) and len(right):
            values = np.frombuffer(b"".join(right["sig"]), np.uint32).reshape(-1, VALUES)
            tree = int.from_bytes(left["region"].iloc[0][:2], "big")
            label = right["label"].to_numpy()
            hashes = [np.frombuffer(h, np.uint64) for h in right["hashes"]]
            for own, sig, held in zip(left["label"], left["sig"], left["hashes"]):
                same = values == np.frombuffer(sig, np.uint32)
                met = same.reshape(-1, TREES, DEPTH)[:, :tree].all(axis=2).any(axis=1)
                mine = np.frombuffer(held, np.uint64)
                for i in np.flatnonzero((same.sum(axis=1) >= AGREE) & ~met & (label != own)):
                    x, y = _find(root, own), _find(root, label[i])
                    if x != y and _linked(mine, hashes[i], percent):
                        root[max(x, y)] = min(x, y)
        return _stars(root)

    return odd.groupBy("region", "block", "other").cogroup(rows.groupBy("region", "block", "other")).applyInPandas(compare, "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets.  component_id is the smallest
    doc_id that links reach.  Null, empty and blank texts have the empty set and are linked with nothing.  Repeated rows
    are one document.  A row without doc_id joins its class, but a class without any id is linked with nothing, has a null
    component_id and is kept.  Columns other than doc_id and text are not read.
    """
    with scratch(documents.sparkSession) as keep:
        sketched = materialize(sketch(documents))
        grouped = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("sig").alias("sig"))
        classes = materialize(grouped)
        placed = number_rows(_forest(classes), [F.col("tree"), F.col("key"), F.col("node")], "pos").withColumn("pos", F.col("pos") - 1)
        blocks = placed.select(F.explode(_halo(F.col("pos"))).alias("block"), "pos", "tree", "key", "node")
        found = materialize(blocks.groupBy("block").applyInPandas(_neighbours, "a long, b long, region binary"))
        size = classes.groupBy("node").agg(F.max("n").alias("n"))
        pairs = found.where("region IS NULL").select("a", "b").distinct()
        pairs = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        pairs = materialize(pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("weight")))
        members = found.where("region IS NOT NULL").select("region", F.col("a").alias("node"))
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct()
        nodes = materialize(nodes)
        sets = materialize(_sets(documents, nodes))
        stars = materialize(_confirm(pairs, sets, percent))
        labels = components(stars)
        rest = _remaining(members, labels, classes, sets, percent)
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(rest))
        known = classes.select("mark", "node").join(labels, "node", "left").select("mark", F.coalesce("label", "node").alias("component"))
        out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "mark").join(known, "mark", "left")
        component = F.coalesce("component", F.when(F.col("n_shingles") == 0, F.col("doc_id")))
        return keep(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
