"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SLICE = 512  # rows of a batch that are Python objects at once


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batches took


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column, parts: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``parts``; an absent id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but ASCII white space."""
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


_FOLDED = bytes(32 if c in b"\t\r\v\f" else c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z lower-cased, white space but the line feed a space
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG_WORD = 64


def line_counts(texts: list[bytes | None]) -> np.ndarray:
    """The number of lines of each text, one more than line feeds."""
    return np.array([1 + t.count(b"\n") if t else 1 for t in texts], np.int64)


def _word_places(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All lines in turn, A-Z lower-cased, start and size of their words (as of ``words_of``), and the number of words of each line."""
    if not texts:
        return b"", *[np.empty(0, np.int64)] * 3
    text = b"\n".join(t or b"" for t in texts).translate(_FOLDED)
    b = np.frombuffer(text, np.uint8)
    feeds = b == 10
    blank = np.concatenate([[True], feeds | (b == 32), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts = edges[::2]
    return text, starts, edges[1::2] - starts, np.diff(np.searchsorted(starts, np.flatnonzero(feeds)), prepend=0, append=len(starts))


def word_counts(texts: list[bytes | None]) -> np.ndarray:
    """The number of words of each line of all texts in turn."""
    return _word_places(texts)[3]


def line_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in turn, and the number of words of each line.

    Eight bytes of all words are taken in at a time.
    """
    text, starts, sizes, counts = _word_places(texts)
    eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    h, open_ = sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407), np.flatnonzero(sizes <= _LONG_WORD)
    for at in range(0, _LONG_WORD, 8):
        open_ = open_[sizes[open_] > at] if at else open_
        if not len(open_):
            break
        taken = eight[starts[open_] + at] & _LOWEST[np.minimum(sizes[open_] - at, 8)]
        mixed = (h[open_] ^ taken) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h[open_] = mixed ^ mixed >> np.uint64(32)
    for k in np.flatnonzero(sizes > _LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[starts[k]:starts[k] + sizes[k]])
    return h, counts


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that ``frame`` does not have, in whatever case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


FILTER_BITS = 24


def bit_filter(slots: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the hashed places in ``column`` (0 to 2^bits - 1), as words of 64.

    It is of fixed size, so it may travel to every task; it only ever lets too much through.
    """
    words = slots.select(F.shiftright(F.col(column).cast("long"), 6).alias("word"), F.expr(f"shiftleft(1L, CAST({column} % 64 AS INT))").alias("bit"))
    out = np.zeros(1 << bits - 6, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def passing(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Positions of the slots whose bit is set."""
    slots = slots.astype(np.uint64)
    return np.flatnonzero(bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1))
