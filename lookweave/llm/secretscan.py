"""Secret scan: fixed patterns, and guess costs of values that stand in a credential's context.

The guess cost of a value is the cheapest way to cut it into words, dates, repeats, keyboard walks and brute-force
stretches, in bits; a dynamic programme over its places finds it.  A value next to a credential word counts as a secret if
even that way costs ``LEAST_BITS`` or more, whatever letters it is made of.  Words are ranked by a short list of common
passwords and then by the number of documents that hold them outside of such values.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs, as shorter ones fail anyway
KINDS = ("assign", "access", "hex", "guess")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|credentials?|private[_ -]?key|login)["']?[\x20\t]*(?::=|=>|->|:|=|\bis\b)[\x20\t]*["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
LEAST_BITS = 40.0
STRETCH = 32  # longest stretch of one kind
TABLE = 1 << 16  # counted words, at most
LEAST_DOCS = 5  # documents that a counted word needs
COUNTED = 200_000  # words that a task counts before it passes them on
BUCKETS = 16  # of document counts, to an octave
_PLAIN = re.compile(r"[^\W\d_]{3,32}")

# words that guessing tries first, the most common first
WORDS = ("password", "admin", "welcome", "secret", "login", "master", "qwerty", "dragon", "monkey", "letmein", "football", "baseball",
         "sunshine", "princess", "shadow", "superman", "batman", "trustno", "hello", "freedom", "whatever", "michael", "jordan",
         "summer", "winter", "spring", "autumn", "monday", "friday", "default", "changeme", "example", "test", "user", "root",
         "guest", "server", "database", "token", "key", "pass", "word", "love", "flower", "ninja", "hunter", "ranger", "access")
_RANK = {w: log2(i + 2) for i, w in enumerate(WORDS)}
_LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("1234567890-=", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
_BESIDE |= {(chr(c), chr(c + d)) for c in range(97, 123) for d in (1, -1) if 97 <= c + d < 123}
_DATE = re.compile(r"(?:19|20)\d\d(?:(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])?)?|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)?\d\d|(?:19|20)\d\d([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])")


def _letter_bits(c: str) -> float:
    return log2(10) if c.isdigit() else log2(26) if c.islower() or c.isupper() else log2(33)


def _repeated(value: str, size: int) -> list[int]:
    """How far from every place the value repeats its letters with period ``size``."""
    n = len(value)
    far = [n - at for at in range(n)]
    for at in range(n - size - 1, -1, -1):
        far[at] = far[at + 1] + 1 if value[at] == value[at + size] else size
    return far


def guess_bits(value: str, ranks: dict[str, float] = _RANK, enough: float = float("inf")) -> float:
    """Bits of the cheapest segmentation; each segment also costs one bit, for its kind.

    The work of a place is bounded.  A repeat may be of any length; of its ends only those near its start and near where it
    breaks off are looked at, as a cut elsewhere leaves more repeats of the same letters on both sides, which cost more.
    Where every way on costs ``enough`` or more already, the cost so far is returned.
    """
    n = len(value)
    best = [0.0] + [float("inf")] * n
    low = value.lower()
    plain = low.translate(_LEET)
    far = {size: _repeated(value, size) for size in range(1, min(8, n) + 1)}
    check = 16
    for at in range(n):
        if at == check:
            # what is offered from here on ends later and costs no less than the places that are reached by now
            check *= 2
            least = min(best[at:])
            if least >= enough:
                return least
        base = best[at]

        def offer(end: int, bits: float) -> None:
            if base + bits < best[end]:
                best[end] = base + bits

        offer(at + 1, _letter_bits(value[at]))  # brute force, one letter at a time
        for end in range(at + 3, min(n, at + STRETCH) + 1):
            rank = ranks.get(plain[at:end])
            if rank is not None:
                changed = low[at:end] != plain[at:end]
                cased = value[at:end] != low[at:end]
                offer(end, 1 + rank + 2 * changed + 2 * cased)
        walk = at + 1
        while walk < n and walk - at < STRETCH and (low[walk - 1], low[walk]) in _BESIDE:
            walk += 1
            if walk - at >= 3:
                offer(walk, 1 + log2(47) + log2(walk - at) + 1)
        for size in range(1, min(8, n - at) + 1):
            times = far[size][at] // size
            if times * size >= 3 and times > 1:
                bits = 1 + sum(map(_letter_bits, value[at:at + size]))
                near = min(times, 2 * STRETCH // size)
                for k in (*range(2, near + 1), *range(max(near + 1, times - 2 * STRETCH // size), times + 1)):
                    if k * size >= 3:
                        offer(at + k * size, bits + log2(k))
        dated = _DATE.match(value, at)
        if dated:
            offer(dated.end(), 1 + log2(365 * 120))
    return best[n]


@dataclass
class Found:
    base: list[tuple[int, int, str]]
    more: list[tuple[int, int, str]]

    def joined(self, spans: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))

    def row(self) -> tuple[int, int, int, str, str]:
        counts = [sum(s[2] == k for s in self.base) for k in KINDS[:3]]
        return (*counts, hashlib.sha256(self.joined(self.base).encode()).hexdigest(), self.joined(self.base + self.more))


def word_ranks(documents: DataFrame) -> dict[str, float]:
    """Bits of the words of ``WORDS`` and of up to ``TABLE`` words of the documents, those of most documents first.

    Values in a credential context are not counted, so a secret does not make itself a word.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(set(_PLAIN.findall(CONTEXT.sub(" ", text or "").lower())))
                if len(held) > COUNTED:
                    yield flush()
                    held.clear()
        yield flush()

    with scratch(documents.sparkSession):
        counted = documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
        counted = materialize(counted.withColumn("bucket", F.floor(F.log2("n") * BUCKETS).cast("int")))
        left, least = TABLE, None
        for r in sorted(counted.groupBy("bucket").agg(F.count("*").alias("words")).collect(), reverse=True):  # a fixed number of buckets
            left -= r["words"]
            if left < 0:
                break
            least = r["bucket"]
        rows = counted.where(F.col("bucket") >= least).select("n", "word").collect() if least is not None else []
    ranked = [*WORDS, *(r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"])) if r["word"] not in _RANK)]
    return {w: log2(i + 2) for i, w in enumerate(ranked)}


def scan_text(text: str | None, ranks: dict[str, float] = _RANK) -> Found:
    """Spans (start, end, kind) of a whole text, in code points, the end exclusive."""
    text = text or ""
    base = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    base += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    more = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        if not any(s <= start and end <= e for s, e, _ in base) and guess_bits(m[1], ranks, LEAST_BITS) >= LEAST_BITS:
            more.append((start, end, "guess"))
    return Found(base, more)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_guess of every row.

    Null and empty texts have no spans.  Repeated rows are scanned each for itself; other columns are not read.
    """
    ranks = word_ranks(documents)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan_text(t, ranks) for t in batch.column(1).to_pylist()]
            rows = list(zip(*((*f.row(), len(f.more)) for f in found))) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
