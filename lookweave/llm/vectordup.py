"""Embedding near-dedup: int8 tile products with error bounds, full precision only for pairs they leave open.

Equal vectors of one label are one class.  A class is scaled to unit length and stored as one signed byte a dimension, a
step and the length of what rounding left over.  Classes of a label are dealt into tiles and tiles meet on a grid, so a
label's size decides how many tasks it has, not how large one is.  A product of codes lies within the two leftovers of the
real cosine (Cauchy-Schwarz): most pairs are ruled out or in by it, the rest are computed in double precision.  A cell
returns sums and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from . import graph

TILE = 1024  # classes of either side that meet in one cell
STRIP = 256  # rows of a tile product that are held at once
BINS = 1 << 16  # labels of few rows share cells
SLACK = 1e-9  # more than the float error of the bounds


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    """id, label, v (doubles, no negative zeros) of the rows that may link."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select("id", "label", v.alias("v")).where(fine & finite & F.exists("v", lambda x: x != 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length; the power of two before keeps huge and tiny components from overflowing."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), steps, and the length of the leftovers, rounded up."""
    step = np.abs(u).max(axis=1, keepdims=True) / 127
    code = np.rint(u / step).clip(-127, 127)
    left = u - code * step
    return code.astype(np.int8), step[:, 0], np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9) + 1e-12


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            lists = part.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            out: dict[str, list] = {"exact": [None] * len(sizes), "code": [None] * len(sizes)}
            step, left = np.zeros(len(sizes)), np.zeros(len(sizes))
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                u = unit(flat[starts[own][:, None] + np.arange(dim)])
                code, step[own], left[own] = quantised(u)
                for i, k in enumerate(own):
                    out["exact"][k], out["code"][k] = u[i].tobytes(), code[i].tobytes()
            columns = {n: part.column(n) for n in ("cls", "label", "dim", "size")}
            columns |= {n: pa.array(out[n], pa.binary()) for n in out} | {"step": pa.array(step), "left": pa.array(left)}
            yield pa.RecordBatch.from_pydict(columns)


class _Side:
    def __init__(self, frame: pd.DataFrame, dim: int) -> None:
        self.cls, self.size = frame["cls"].to_numpy(), frame["size"].to_numpy()
        exactly = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of code products stay whole numbers
        self.code = np.frombuffer(b"".join(frame["code"]), np.int8).reshape(len(frame), dim).astype(exactly)
        self.exact = np.frombuffer(b"".join(frame["exact"])).reshape(len(frame), dim)
        self.step, self.left = frame["step"].to_numpy(), frame["left"].to_numpy()


def _linked(a: _Side, b: _Side, at: slice, least: float) -> np.ndarray:
    """Which classes of the strip ``at`` of ``a`` have a cosine of ``least`` or more with which of ``b``."""
    about = (a.code[at] @ b.code.T) * a.step[at, None] * b.step
    # |u||w| - |Su||Sw| with |Su| <= 1 + left: what the leftovers can add or take
    off = a.left[at, None] * (1 + b.left) + b.left * (1 + a.left[at, None]) + a.left[at, None] * b.left + SLACK
    sure = about - off >= least
    i, j = np.nonzero((about + off >= least) & ~sure)
    for some in range(0, len(i), 1 << 14):
        p, q = i[some:some + (1 << 14)], j[some:some + (1 << 14)]
        sure[p, q] = np.einsum("nd,nd->n", a.exact[at][p], b.exact[q]) >= least
    return sure


def _cell(frame: pd.DataFrame, a: _Side, b: _Side | None, least: float) -> pd.DataFrame:
    """Rows (cls, links, other): links found for a class, or one edge of the cell's spanning forest."""
    same = b is None
    b = a if same else b
    first, second = np.zeros(len(a.cls), np.int64), np.zeros(len(b.cls), np.int64)
    names = a.cls if same else np.concatenate([a.cls, b.cls])
    shift = 0 if same else len(a.cls)
    root, edges = np.arange(len(names)), []
    for start in range(0, len(a.cls), STRIP):
        at = slice(start, start + STRIP)
        links = _linked(a, b, at, least)
        if same:
            links[np.arange(len(links)), start + np.arange(len(links))] = False
        first[at] = links @ b.size
        if not same:
            second += a.size[at] @ links
        for i in np.flatnonzero(links.any(axis=1)):
            near = np.flatnonzero(links[i]) + shift
            mine = root[start + i]
            roots, where = np.unique(root[near], return_index=True)
            new = roots != mine
            if new.any():
                edges += [(names[start + i], names[near[k]]) for k in where[new]]
                root[np.isin(root, roots[new])] = mine
    counts = np.concatenate([first, second]) if not same else first
    found = np.flatnonzero(counts)
    rows = pd.DataFrame({"cls": names[found], "links": counts[found], "other": np.full(len(found), -1)})
    return pd.concat([rows, pd.DataFrame([(x, 0, y) for x, y in edges], columns=["cls", "links", "other"])])


def near_duplicates(rows: DataFrame, least: float, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key``, n_links, component_id and kept of every row of ``rows`` (with ``key``, ``vector`` and label).

    Two rows link if label and dimension are equal and the cosine is ``least`` (above 0) or more.  A row whose id, label or
    vector is null, or whose vector is empty, zero or holds a null or non-finite component, links with nothing: 0 links, itself
    its component (null for a null id), kept.  Repeated rows and rows that repeat an id are vectors of their own and link like
    others.  ``component_id`` is the smallest id reachable over links; other columns are ignored; an empty table gives no rows.
    """
    with scratch(rows.sparkSession) as keep:
        return keep(_near_duplicates(rows.select(F.col(key).cast("long").alias("id"), "label", F.col(vector).alias("v")), least)
                    .withColumnRenamed("id", key))


def _near_duplicates(rows: DataFrame, least: float) -> DataFrame:
    spark = rows.sparkSession
    usable = _usable(rows, "v").withColumn("h", F.xxhash64("label", "v"))
    classes = usable.groupBy("h", "label", "v").agg(F.count("*").alias("size"), F.min("id").alias("top"))
    # a global sort by the smallest id: the smallest class number of a component belongs to its smallest id
    classes = materialize(classes.sort("top").withColumns({"cls": F.monotonically_increasing_id(), "dim": F.size("v")}))
    groups = materialize(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    bins = max(BINS, total // TILE)
    schema = classes.select("cls", "label", "dim", "size").schema.simpleString()[7:-1].replace(":", " ")
    codes = classes.select("cls", "label", "dim", "size", "v").mapInArrow(_encode, f"{schema}, exact binary, code binary, step double, left double")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = codes.join(groups, ["label", "dim"]).withColumns({
        "tile": F.pmod(F.xxhash64("cls"), tiles).cast("int"), "bin": F.pmod(F.xxhash64("label", "dim"), F.lit(bins)),
        "with": F.explode(F.sequence(F.lit(0), tiles - 1))}).drop("n")
    dealt = dealt.withColumns({"lo": F.least("tile", "with"), "hi": F.greatest("tile", "with")})

    def cells(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"cls": [], "links": [], "other": []}, dtype="int64")]
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        for (_, dim), own in frame.groupby(["label", "dim"]):
            parts = [_Side(own[own["tile"] == t], dim) for t in {lo, hi}]
            if lo == hi:
                out.append(_cell(own, parts[0], None, least))
            elif all(len(p.cls) for p in parts):
                out.append(_cell(own, parts[0], parts[1], least))
        return pd.concat(out)

    found = materialize(dealt.groupBy("bin", "lo", "hi").applyInPandas(cells, "cls long, links long, other long"))
    counts = found.where("other < 0").groupBy("cls").agg(F.sum("links").alias("links"))
    joined = graph.components(found.where("other >= 0").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    tops = classes.select(F.col("cls").alias("label"), F.col("top").alias("reach"))
    reach = joined.join(tops, "label").select(F.col("node").alias("cls"), "reach")
    known = classes.join(counts, "cls", "left").join(reach, "cls", "left").select(
        "h", "label", "v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("reach", "top").alias("reach"), "size", "top")
    known = materialize(known)
    result = lambda df: df.select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    # a class of one row needs no join: its row is known by its id
    alone = known.where("size = 1").select(F.col("top").alias("id"), "n_links", F.col("reach").alias("component_id"))
    several = known.where("size > 1").select("h", "label", "v", "n_links", F.col("reach").alias("component_id"))
    copies = usable.join(several, ["h", "label", "v"]).select("id", "n_links", "component_id")
    return result(alone.unionByName(copies).unionByName(_unlinked(rows)))


def _unlinked(rows: DataFrame) -> DataFrame:
    """The rows that _usable leaves out."""
    v = F.transform("v", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    out = F.col("id").isNull() | F.col("label").isNull() | F.coalesce(bad, F.lit(True))
    return rows.where(out).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
