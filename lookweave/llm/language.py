"""Language identification: scripts narrow the candidates, a Viterbi search labels spans of words.

Every word has a score per language, the log likelihood of its letter groups under a learned model; languages that do not
use the word's script are out.  The best labelling of a text's words maximises the scores less a penalty for every
switch.  A text in which no stretch of words prefers another language by half the penalty has one label throughout, which
is proved from running sums; only the others go through the full search.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices

BITS = 16
SLOTS = 1 << BITS
GROUPS = (1, 2, 3, 4)  # letters to a group
SAMPLE = 1500  # training documents per language, at most
SWITCH = 12.0  # nats that a switch costs
FLOOR = -6.0  # least score of a word against the best language
SCRIPT_SHARE = 0.01  # of a language's letters that a script needs to belong to it
CACHE_ENTRIES = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")

# first and last code points of scripts: fixed values of the Unicode blocks
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def script_of(word: str) -> str:
    """Script of a word's first letter that a range holds."""
    if word[:1].isascii():
        return "latin"
    for c in word:
        for name, first, last in SCRIPTS:
            if first <= ord(c) <= last:
                return name
    return "other"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def groups_of(word: str) -> list[str]:
    """Letter groups of a word with its ends marked."""
    marked = f"<{word}>" if len(word) <= 64 else f"<{word[:32]}…{word[-32:]}>"
    return [marked[i:i + n] for n in GROUPS for i in range(len(marked) - n + 1)]


class _Slots(dict):
    """Hashed place of a letter group."""

    def __missing__(self, group: str) -> int:
        self[group] = slot = zlib.crc32(group.encode()) & SLOTS - 1
        return slot


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (languages, slots)
    scripts: list[set[str]]
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        self.table = np.empty((1024, len(self.languages)))
        self.groups = _Slots()
        self.by_slot = np.ascontiguousarray(self.logs.T)
        names = sorted(set().union(*self.scripts)) if self.scripts else []
        self.script_index = {name: i for i, name in enumerate(names)}
        # a script that no language uses rules none out
        self.absent = np.array([[name not in s for s in self.scripts] for name in names] + [[False] * len(self.scripts)], bool).reshape(len(names) + 1, -1)

    def __reduce__(self):
        return Model, (self.languages, self.logs, self.scripts)

    def _score(self, words: list[str]) -> np.ndarray:
        """Scores of new words per language, 0 for the best one."""
        if len(self.groups) > CACHE_ENTRIES:
            self.groups.clear()
        slots, sizes = [], []
        for word in words:
            found = groups_of(word)
            sizes.append(len(found))
            slots += map(self.groups.__getitem__, found)
        n = np.array(sizes)
        raw = np.add.reduceat(self.by_slot[slots], np.cumsum(n) - n, axis=0) / n[:, None]
        raw *= np.minimum([len(w) for w in words], 8)[:, None]
        out = self.absent[[self.script_index.get(script_of(w), -1) for w in words]]
        raw[out] = -np.inf
        return np.maximum(raw - raw.max(axis=1, keepdims=True), FLOOR)

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages); a word is scored once per worker while it stays in the cache."""
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        fresh = list(set(filterfalse(known.__contains__, words)))
        if fresh:
            n = len(known)
            if n + len(fresh) > len(self.table):
                grown = np.empty((2 * (n + len(fresh)), len(self.languages)))
                grown[:n] = self.table[:n]
                self.table = grown
            self.table[n:n + len(fresh)] = self._score(fresh)
            known.update(zip(fresh, range(n, n + len(fresh))))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def spans(self, words: list[str], scores: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(first word, end, language) of the best labelling."""
        if not words or not self.languages:
            return []
        s = self.scores(words) if scores is None else scores
        best = int(np.argmax(s.sum(axis=0)))
        if not _may_switch(s, best):
            return [(0, len(words), best)]
        path = viterbi(s)
        cuts = np.flatnonzero(np.diff(path)) + 1
        return [(int(a), int(b), int(path[a])) for a, b in zip([0, *cuts], [*cuts, len(words)])]

    def label(self, text: str | None) -> tuple[str, float, int]:
        """Language with most letters, its share of them weighted by the evidence, and the number of spans."""
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0, 0
        scores = self.scores(words)
        spans = self.spans(words, scores)
        sizes: Counter[int] = Counter()
        for a, b, k in spans:
            sizes[k] += sum(map(len, words[a:b]))
        k, letters = min(sizes.items(), key=lambda x: (-x[1], x[0]))
        total = scores.sum(axis=0)
        belief = np.exp(total - total.max())
        return self.languages[k], letters / sum(sizes.values()) * (float(belief[k] / belief.sum()) if len(sizes) == 1 else 1.0), len(spans)


def _may_switch(s: np.ndarray, best: int) -> bool:
    """Whether some stretch gains half the penalty or more by another language than the best whole one.

    A path that leaves the best language replaces stretches, each at the cost of a switch or more; if none gains half
    of that, staying wins.
    """
    gain = np.cumsum(s - s[:, best:best + 1], axis=0)
    gain = np.concatenate([np.zeros((1, s.shape[1])), gain])
    return bool(((gain - np.minimum.accumulate(gain, axis=0)) > SWITCH / 2).any())


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels that maximise the sum of scores less ``switch`` per change; ties stay."""
    n, k = s.shape
    moved = np.empty((n, k), bool)
    source = np.empty(n, np.int64)
    value = s[0].tolist()
    rows = s.tolist()
    span = range(k)
    for t in range(1, n):
        top = max(value)
        at = value.index(top)
        source[t] = at
        jump = top - switch
        row, stay = rows[t], moved[t]
        for j in span:
            if value[j] >= jump:
                stay[j] = False
                value[j] += row[j]
            else:
                stay[j] = True
                value[j] = jump + row[j]
    path = np.empty(n, np.int64)
    path[-1] = value.index(max(value))
    for t in range(n - 1, 0, -1):
        path[t - 1] = source[t] if moved[t, path[t]] else path[t]
    return path


def fit(documents: DataFrame, trainable: Column, sample: int = SAMPLE) -> Model:
    """Learn from ``sample`` documents of every non-null language, those with the smallest hashes of their ids.

    ``trainable`` is a condition on doc_id.  Without any, no language is known and every text is ``und``.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(trainable).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.select("lang", "text", F.xxhash64("doc_id").alias("place"))
    # the windows are limited before their shuffle; one row per language then meets the texts, which don't move
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    last = materialize(rows.select("lang", "place", nth.alias("nth")).where(F.col("nth") <= sample).groupBy("lang").agg(F.max("place").alias("last")))
    texts = rows.join(last, "lang").where(F.col("place") <= F.col("last")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, np.ndarray] = {}
        places = _Slots()
        scripts: Counter[tuple[str, str]] = Counter()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = slots.setdefault(lang, np.zeros(SLOTS, np.int64))
                for word, n in Counter(words_of(text)).items():
                    np.add.at(held, list(map(places.__getitem__, groups_of(word))), n)
                    scripts[lang, script_of(word)] += n * len(word)
        out = [(lang, int(i), None, int(held[i])) for lang, held in slots.items() for i in np.flatnonzero(held)]
        out += [(lang, None, script, n) for (lang, script), n in scripts.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "slot", "script", "n"])

    counted = texts.mapInArrow(count, "lang string, slot int, script string, n long").groupBy("lang", "slot", "script").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})
    index = {lang: i for i, lang in enumerate(languages)}
    counts, letters = np.zeros((len(languages), SLOTS)), [Counter() for _ in languages]
    for r in counted:
        if r["script"] is None:
            counts[index[r["lang"]], r["slot"]] = r["n"]
        else:
            letters[index[r["lang"]]][r["script"]] += r["n"]
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    used = [{s for s, n in c.items() if n >= SCRIPT_SHARE * sum(c.values())} for c in letters]
    return Model(languages, np.log(share + 1e-6), used)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and n_spans of every row, texts read whole; ``und`` for null texts and texts without letters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = list(zip(*(model.label(t) for t in batch.column(1).to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32())], names=["doc_id", "lang_pred", "score", "n_spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans int")


def spans(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and (start, end, lang) of every span in turn, in code points of the lower-cased text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, out = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                found = list(_WORD.finditer((text or "").lower()))
                out += [(doc, found[a].start(), found[b - 1].end(), model.languages[k]) for a, b, k in model.spans([m[0] for m in found])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "end", "lang"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, lang string")
