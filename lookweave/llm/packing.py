"""Best-fit packing by minimum bin slack.

Documents become token pieces; what a bin can hold depends only on how many pieces of each length are
left, so the packing is planned on the length histogram (at most ``capacity`` rows) and never sees a
document.  Per bin, subset-sum reachability over the available lengths, kept as a bitset, gives the fullest
feasible combination with the longest piece left; a combination is taken as often as the counts allow,
which is what repeating the search would find.  Pieces then look their place up by their rank within their
length.  Ranks come from per-task counters and a table of task offsets, so no length, however common, is
gathered in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import slices

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
SLOTS = 1 << 21  # places of a worker's table of words
KNOWN = 3 * SLOTS // 4  # words in it, at most
LEARNT, DOCS = 2048, 128  # words that are encoded and documents that are split at a time, as their objects are large
_STOPS = re.compile(rb"(.*[a-z])([.,]+)", re.DOTALL)
_SHIFT = 45  # a key of the place table is length << 45 | rank

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of texts by a tokenizer that lower-cases and drops white space, each word encoded once.

    No token spans white space in such a vocabulary, so the ids of a text are those of its words in turn.  Full stops and
    commas after a letter are tokens of their own, so a word that ends in them needs no encoding of its own.

    Known words are a hash table of arrays, looked up for all words of a slice at once: 64-bit hashes, and the stretch of
    a pool that holds a word's ids.  Two of ``KNOWN`` words share a hash with a probability below 1e-6; a full table starts
    anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.entries = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.start, self.size, self.count = np.zeros(KNOWN, np.int32), np.zeros(KNOWN, np.int32), 0
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry per hash, -1 for unknown ones."""
        out, at, open_ = np.full(len(h), -1, np.int64), h & np.uint64(SLOTS - 1), np.arange(len(h))
        at = at.astype(np.int64)
        while len(open_):
            held = self.hashes[at[open_]]
            hit = held == h[open_]
            out[open_[hit]] = self.entries[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
            at[open_] = at[open_] + 1 & SLOTS - 1
        return out

    def _add(self, hashes: list[int], ids: list[list[int]]) -> None:
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.pool[self.used:self.used + len(flat)] = flat
        sizes = np.array([len(x) for x in ids], np.int64)
        new = slice(self.count, self.count + len(ids))
        self.size[new], self.start[new] = sizes, self.used + np.cumsum(sizes) - sizes
        table, entries, mask = self.hashes, self.entries, SLOTS - 1
        for entry, h in enumerate(hashes, self.count):
            at = h & mask
            while table[at]:
                at = at + 1 & mask
            table[at], entries[at] = h, entry
        self.count, self.used = new.stop, self.used + len(flat)

    def _learn(self, words: list[bytes], hashes: list[int]) -> None:
        """Take in words, each once."""
        cuts = [_STOPS.fullmatch(w) for w in words]
        parts = list(dict.fromkeys(x for w, c in zip(words, cuts) for x in (c.groups() if c else (w,))))
        held = self._find(_word_hashes(parts))
        fresh = [w for w, e in zip(parts, held) if e < 0]
        found = {}
        for at in range(0, len(fresh), LEARNT):
            some = fresh[at:at + LEARNT]
            made = self.model.encode_batch_fast([w.decode("utf-8") for w in some], add_special_tokens=False)
            found |= {w: x.ids for w, x in zip(some, made)}
        known = {w: self.pool[self.start[e]:self.start[e] + self.size[e]].tolist() for w, e in zip(parts, held) if e >= 0}
        ids = found | known
        rows = {h: ids[w] if not c else ids[c[1]] + ids[c[2]] for w, h, c in zip(words, hashes, cuts)}
        rows |= {h: found[w] for w, h in zip(fresh, _word_hashes(fresh).tolist())}
        self._add(list(rows), list(rows.values()))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's ids end."""
        split = [(t or b"").lower().split() for t in texts]
        words = list(chain.from_iterable(split))
        h = _word_hashes(words)
        entry = self._find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            fresh, at = np.unique(h[missing], return_index=True)
            if self.count + 3 * len(fresh) > KNOWN:
                self._clear()
                missing = np.arange(len(h))
                fresh, at = np.unique(h, return_index=True)
                if 3 * len(fresh) > KNOWN:
                    return self._halves(texts)
            self._learn([words[i] for i in missing[at]], fresh.tolist())
            entry[missing] = self._find(h[missing])
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[entry] - (ends - size), size) + np.arange(int(size.sum()))]
        return ids, np.concatenate([[0], ends])[np.cumsum([len(w) for w in split])]

    def _halves(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts with more words than a table takes; a single text is cut between words."""
        whole = len(texts) == 1
        parts = texts[0].split() if whole else texts
        half = len(parts) // 2
        left, right = ([b" ".join(parts[:half])], [b" ".join(parts[half:])]) if whole else (parts[:half], parts[half:])
        (a, to), (b, then) = self.encode(left), self.encode(right)
        ends = np.concatenate([to, then + len(a)])
        return np.concatenate([a, b]), ends[-1:] if whole else ends


def _word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.maximum(h, np.uint64(1))  # 0 marks free places of the table


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: its ids, then id 0, cut every ``capacity`` tokens.

    Null and empty texts are the one token 0.  ``part`` and ``rank`` count the pieces of one length within a
    task; they hold only for one evaluation, so write the result before using it twice.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(path or vocabulary_path()), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches, DOCS):
            rows, begin = [], 0
            ids, ends = words.encode(batch.column(1).cast(pa.binary()).to_pylist())
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist()):
                own = ids[begin:end].astype("<u4").tobytes() + b"\0\0\0\0"
                begin = end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    chunk = own[at:at + 4 * capacity]
                    length = len(chunk) // 4
                    rows.append((doc, piece, at // 4, length, zlib.crc32(chunk), part, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, f"{PIECES}, part int, rank long")


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination with the largest total of at most ``capacity``.

    Ties go to longer pieces: the search stops at the first prefix of the descending lengths that fills the bin,
    and the walk back takes as few short pieces as it can.
    """
    mask, reach, tried = (1 << capacity + 1) - 1, [1], []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        bits, left, step = reach[-1], min(counts[length], capacity // length), 1
        while left > 0:
            take = min(step, left)
            bits |= bits << length * take & mask
            left, step = left - take, 2 * step
        tried.append(length)
        reach.append(bits)
        if bits >> capacity & 1:
            break
    rest, chosen = reach[-1].bit_length() - 1, []
    for at in range(len(tried) - 1, -1, -1):
        copies = 0
        while not reach[at] >> rest & 1:
            rest, copies = rest - tried[at], copies + 1
        if copies:
            chosen.append((tried[at], copies))
    return chosen[::-1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places of the pieces of each length: (length, first rank, pieces, copies per bin, first bin, offset).

    The longest piece left opens a bin and ``fullest`` fills it.  Each combination is repeated until one of its
    lengths has fewer pieces than a bin takes, which a length with ``c`` copies to a bin can cause ``c`` times at most:
    at most capacity * (1 + ln capacity) combinations, whatever the number of documents.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    used, places, bins = dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        chosen = dict(fullest(rest, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(counts[k] // c for k, c in chosen.items()), 0
        for length, copies in sorted(chosen.items(), reverse=True):
            places.append((length, used[length], copies * times, copies, bins, offset))
            offset += copies * length
            used[length] += copies * times
            counts[length] -= copies * times
            if not counts[length]:
                del counts[length]
        bins += times
    return places


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Repeated rows are packed each for itself; an empty table gives no rows; columns other than doc_id and text
    are not read.  Needs a written stage in the shared folder, as ranks must not be computed twice.
    """
    with scratch(documents.sparkSession) as keep:
        return keep(_pack(materialize(token_pieces(documents, path, capacity)), capacity))


def _pack(pieces: DataFrame, capacity: int) -> DataFrame:
    tasks = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = sorted(plan(histogram, capacity))
    columns = np.array(places, dtype=np.int64).reshape(-1, 6).T
    keys = (columns[0] << _SHIFT) + columns[1]
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset"))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(keys, (length << _SHIFT) + rank, side="right") - 1
            _, first, _, copies, bins, offset = columns[:, at]
            within = rank - first
            sequence, slot = bins + within // copies, offset + within % copies * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(slot)], schema=out)

    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
