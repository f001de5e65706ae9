"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the tokens at a mask's ones; the zeros are ignored.  Every window of ``WINDOW`` aligned tokens with at
most a fifth substituted holds a whole seed of one of the two masks (a test enumerates the patterns), so joining the seeds
of documents and benchmark items finds all such windows.  A hit names a diagonal: an item at an offset in a document;
the tokens on it are compared, substitutions allowed, and the best window decides.

A bitmap of the benchmark's seeds, of fixed size, keeps other seeds from leaving the scan; what passes is joined exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import FILTER_BITS, bit_filter, fresh, passing, slices, words_of

MASKS = ("110111", "11111")
WINDOW = 16
SHARE = 5  # one token in this many may be substituted
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def substitutions(window: int) -> int:
    """Substitutions allowed in a window: a fifth of it, fewer where a short one could then hold no seed; -1: too short."""
    most = -1
    for k in range(window // SHARE + 1):
        for gone in combinations(range(window), k):
            kept = "".join("0" if i in gone else "1" for i in range(window))
            if not any(all(m == "0" or c == "1" for m, c in zip(mask, kept[at:])) for mask in MASKS for at in range(window - len(mask) + 1)):
                return most
        most = k
    return most


def hashes_of(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of the seeds of every mask."""
    out, at = [], []
    for number, mask in enumerate(MASKS, 1):
        n = len(tokens) - len(mask) + 1
        if n > 0:
            h = np.full(n, number, np.uint64)
            for k, bit in enumerate(mask):
                if bit == "1":
                    h = h * _FACTOR + tokens[k:k + n]
            h = (h ^ h >> np.uint64(31)) * _MIX
            out.append((h ^ h >> np.uint64(29)).view(np.int64))
            at.append(np.arange(n, dtype=np.int64))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def _slots(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a seed in the bitmap."""
    wide = seed.view(np.uint64)
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return wide & mask, wide >> np.uint64(40) & mask


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per distinct token sequence of at least a mask's length: key, tokens, and the items that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = [hashes_of(t) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_64_intdigest(t.tobytes()) - (1 << 63) for t in tokens]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["item_id", "item", "tokens"])
            yield out.filter(pa.array([len(t) >= 5 for t in tokens], pa.bool_()))

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, item long, tokens binary")


def _item_seeds(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed, at = seeds(np.frombuffer(tokens, np.uint64))
                a, b = _slots(seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seed), item, np.int64)), pa.array(seed), pa.array(at), *(pa.array(x.astype(np.int64)) for x in (a, b))], names=["item", "seed", "at", "slot_1", "slot_2"])

    return items.select("item", "tokens").mapInArrow(run, "item long, seed long, at long, slot_1 long, slot_2 long")


def _scan(documents: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows (key, null, null, tokens) of documents with seeds that pass the bitmap, and (key, seed, at, null) of these seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = hashes_of(text)
                seed, at = seeds(tokens)
                if not len(seed):
                    continue
                a, b = _slots(seed)
                hit = passing(bitmap, a)
                hit = hit[passing(bitmap, b[hit])]
                if len(hit):
                    n = len(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, key, np.int64)), pa.concat_arrays([pa.array([None], pa.int64()), pa.array(seed[hit])]), pa.concat_arrays([pa.array([None], pa.int64()), pa.array(at[hit])]), pa.array([tokens.tobytes(), *[None] * n], pa.binary())], names=["key", "seed", "at", "tokens"])

    return documents.select("key", "text").mapInArrow(run, "key long, seed long, at long, tokens binary")


def best_window(document: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(equal, window, start in the document, equal on the whole diagonal) of the best window; None if it has too many substitutions."""
    first, last = max(0, -diagonal), min(len(item), len(document) - diagonal)
    window = min(WINDOW, len(item))
    if last - first < window:
        return None
    equal = document[first + diagonal:last + diagonal] == item[first:last]
    sums = np.cumsum(np.concatenate([[0], equal]))
    held = sums[window:] - sums[:-window]
    at = int(np.argmax(held))
    if substitutions(window) < 0 or window - held[at] > substitutions(window):
        return None
    return int(held[at]), window, first + diagonal + at, int(sums[-1])


def _keyed(documents: DataFrame) -> DataFrame:
    """Adds key: a hash of id and text, so that rows that repeat both are one."""
    return documents.withColumn("key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))


def _overlaps(keyed: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, item, equal, window, start, matched), the best diagonal of each pair, and (item, item_id)."""
    known = materialize(_items(benchmark))
    items = materialize(known.groupBy("item").agg(F.max("tokens").alias("tokens")))
    seeded = materialize(_item_seeds(items))
    places = seeded.select(F.explode(F.array("slot_1", "slot_2")).alias("slot")).distinct()
    found = materialize(_scan(keyed, bit_filter(places, "slot")))
    diagonals = found.where("seed IS NOT NULL").join(seeded.select("seed", "item", F.col("at").alias("item_at")), "seed")
    diagonals = diagonals.select("key", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    texts = found.where("tokens IS NOT NULL").select("key", F.col("tokens").alias("document")).dropDuplicates(["key"])
    pairs = diagonals.join(texts, "key").join(items, "item").select("key", "item", "diagonal", "document", "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for key, item, diagonal, document, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                best = best_window(np.frombuffer(document, np.uint64), np.frombuffer(tokens, np.uint64), diagonal)
                if best:
                    out.append((key, item, *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["key", "item", "equal", "window", "start", "matched"])

    confirmed = pairs.mapInArrow(verify, "key long, item long, equal long, window long, start long, matched long")
    best = confirmed.groupBy("key", "item").agg(F.max(F.struct("equal", "matched", -F.col("start"), "window")).alias("b"))
    best = materialize(best)
    return best.select("key", "item", F.col("b.equal").alias("equal"), F.col("b.window").alias("window"), (-F.col("b.col3")).alias("start"), F.col("b.matched").alias("matched")), known.select("item", "item_id").distinct()


def contaminations(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, equal, window, start, matched: every document and benchmark item with an overlap.

    An overlap is a window of ``WINDOW`` tokens in a row of the item (all of a shorter item) that stands in the document with
    at most ``substitutions(window)`` tokens replaced.  Tokens are runs of anything but ASCII white space, A-Z lower-cased.
    The pair's best window is given, the first of equals, and the equal tokens on its whole diagonal.  Items of fewer than five
    tokens and null or empty texts overlap with nothing.  Repeated rows, and items of one text, count once per id.
    """
    keyed = _keyed(documents)
    with scratch(documents.sparkSession) as keep:
        best, ids = _overlaps(keyed, benchmark)
        # the key stands for id and text, so a document is found by it alone
        owners = keyed.select("key", F.col("doc_id").cast("long").alias("doc_id")).join(best.select("key").distinct(), "key", "left_semi").distinct()
        return keep(best.join(owners, "key").join(ids, "item").select("doc_id", "item_id", "equal", "window", "start", "matched"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any overlap, all columns kept, whatever their names."""
    own = {c: fresh(documents, "__key") for c in documents.columns if c.lower() == "key"}
    keyed = _keyed(documents.withColumnsRenamed(own))
    with scratch(documents.sparkSession) as keep:
        gone = keep(_overlaps(keyed, benchmark)[0].select("key").distinct())
    left = keyed.join(gone, "key", "left_anti").drop("key")
    return left.withColumnsRenamed({spare: c for c, spare in own.items()}).select(documents.columns)
