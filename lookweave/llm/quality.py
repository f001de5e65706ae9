"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(w.x - t_k)): the weights w of hashed text features are shared by all grades, the thresholds
t_0 < t_1 < ... are ordered by construction.  Features are byte trigrams and buckets of a few surface ratios, hashed into
``DIM`` places; log counts, scaled to unit length.  The fit takes a bounded sample of rated rows; scoring maps over
the documents without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BITS = 14
DIM = 1 << BITS
SAMPLE = 4000  # rated documents to fit on, at most
ROUNDS = 150
SLICE = 1 << 20  # bytes of a text that are counted at once


def _buckets(data: bytes) -> list[int]:
    """Places of the surface features: share of repeated neighbours, of distinct words, of capitals, of marks."""
    words = data.split()
    n = max(1, len(words))
    repeated = sum(map(eq, words, words[1:])) / n
    distinct = len(set(words)) / n ** 0.9
    size = max(1, len(data))
    capitals = sum(w.isupper() for w in words) / n
    marks = len(data.translate(None, _PLAIN)) / size
    named = [("repeated", repeated), ("distinct", distinct), ("capitals", capitals), ("marks", marks)]
    return [zlib.crc32(f"{name} {min(20, int(20 * value))}".encode()) % DIM for name, value in named]


_PLAIN = bytes([*b" \t\n\r.,;:'\"-()", *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the whole text; none for a null or empty one."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(data) - 2, SLICE):
        b = np.frombuffer(data, np.uint8, min(SLICE + 2, len(data) - at), at).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        counts += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS), minlength=DIM)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]).astype(np.float32)
    values /= max(1e-9, float(np.sqrt((values * values).sum())))
    if data:
        extra = np.array(_buckets(data))
        at, values = np.concatenate([at, extra]), np.concatenate([values, np.full(len(extra), 0.5, np.float32)])
    return at.astype(np.int32), values


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades; empty without any rating

    def tails(self, x: float) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -50, 50)))

    def score(self, text: str | None) -> np.ndarray:
        at, values = features(text)
        return self.tails(float(self.weights[at] @ values))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, rounds: int = ROUNDS, decay: float = 1e-5) -> Ordinal:
    """Maximum likelihood by Adam steps over the (bounded) sample.

    Without rows every grade is equally likely.
    """
    if not rows:
        return Ordinal(np.zeros(DIM, np.float32), np.log(np.arange(1, top + 1) / np.arange(top, 0, -1)))
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.clip([(grades < k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    # the first threshold, then logs of the steps to the next ones
    state = np.concatenate([np.zeros(DIM), start[:1], np.log(np.maximum(1e-3, np.diff(start)))])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        w, t = state[:DIM], np.cumsum(np.concatenate([state[DIM:DIM + 1], np.exp(state[DIM + 1:])]))
        x = np.bincount(owner, w[index] * value, len(rows))
        below = 1 / (1 + np.exp(np.clip(x[:, None] - t[None, :], -50, 50)))
        full = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        upper, lower = full[at, grades + 1], full[at, grades]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gx = (du - dl) / len(rows)
        gt = np.array([-du[grades == k].sum() + dl[grades == k + 1].sum() for k in range(top)]) / len(rows)
        tail = np.cumsum(gt[::-1])[::-1]
        gradient = np.concatenate([np.bincount(index, gx[owner] * value, DIM) + decay * w, tail[:1], tail[1:] * np.exp(state[DIM + 1:])])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        state = state - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Ordinal(state[:DIM].astype(np.float32), np.cumsum(np.concatenate([state[DIM:DIM + 1], np.exp(state[DIM + 1:])])))


def fit(documents: DataFrame, ratings: DataFrame, grade: Column, top: int, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` rated rows, those with the smallest hashes of their ids.

    ``ratings`` has doc_id; ``grade`` (0 to ``top``) is an expression over it.  Rows without id or grade take no part.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # at most `sample` small rows, so the broadcast has a fixed bound
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].tobytes() for x in found], pa.binary())], names=["doc_id", "grade", "places", "weights"])

    rows = held.mapInArrow(count, "doc_id long, grade int, places binary, weights binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["grade"]))
    pairs = [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in rows]
    return fit_rows(pairs, np.array([r["grade"] for r in rows], int), top)


def score(documents: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected grade and tail probability per grade of every row, texts read whole.

    Null and empty texts score by the thresholds alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tails = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))], names=["doc_id", "expected", "tails"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected double, tails array<double>")


def select(documents: DataFrame, model: Ordinal, grade: int = 1, least: float = 0.5) -> DataFrame:
    """The rows, all columns kept, whose probability of at least ``grade`` is ``least`` or more."""
    schema, name = documents.schema, "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(name)).to_pylist()
            yield batch.filter(pa.array([bool(model.score(t)[grade - 1] >= least) for t in texts], pa.bool_()))

    return documents.mapInArrow(run, schema)
