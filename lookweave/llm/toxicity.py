"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and scores of context windows.

Lexicon terms are words and word beginnings that training rows tie to the label.  Near copies of a text count once, by a
MinHash value of their terms, so the words of one copied text do not become terms.  A text's words walk the
trie with the states of an automaton that allows one edit, in whole words and in word beginnings; two neighbouring letters
in the wrong order count as one edit, too.  A hit counts by its weight, by whether it is exact, by whether quotation marks
hold it, and by how many other hits stand in its window.  A small logistic model joins these.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import slices

TOXIC_SAMPLE, OTHER_SAMPLE = 2000, 6000  # training rows of either label, at most
LEAST_ROWS = 4  # toxic rows that a term needs
LEAST_ODDS = 1.0  # lower bound of a term's log odds ratio, two standard errors down
PREFIX = (4, 8)  # lengths of word beginnings
EDIT_LENGTH = 5  # shorter terms allow no edit
WINDOW = 6  # words on either side
CACHE_ENTRIES = 500_000
BOUND = 0.3
_EDGES = "\"'«»“”„‘’‹›().,;:!?…*_[]{}<>|-#%&$~`"
_OPEN, _CLOSE = "\"«“„‘‹", "\"»”“’›"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def terms_of(text: str | None) -> set[str]:
    """Candidate terms of a text: its words, and their beginnings marked with a star."""
    out = set()
    for word in {w.strip(_EDGES) for w in set(tokens(text))}:
        if len(word) >= 3 and word.isalpha():
            out.add(word)
            out.update(word[:k] + "*" for k in range(PREFIX[0], min(PREFIX[1], len(word) - 1) + 1))
    return out


class Trie:
    """Terms as nested dicts; the key "" of a node holds (term, whole word only)."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.sides: set[tuple[int, str]] = set()
        self.later: dict[tuple[int, int], set[str]] = defaultdict(set)  # second halves of stems, by place and length
        for term in terms:
            plain, node = term.rstrip("*"), self.root
            for c in plain:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((term, not term.endswith("*")))
            if len(plain) >= EDIT_LENGTH:
                half = len(plain) // 2
                self.sides.add((0, plain[:half]))
                if term.endswith("*"):
                    self.later[half, len(plain) - half].add(plain[half:])
                else:
                    self.sides.add((1, plain[half:]))
        self.lengths = sorted({(side, len(s)) for side, s in self.sides})

    def exact(self, word: str) -> list[str]:
        """Terms that are the word, or stems of it."""
        found, node = [], self.root
        for at, c in enumerate(word):
            node = node.get(c)
            if node is None:
                return found
            found += [t for t, whole in node.get("", ()) if not whole or at == len(word) - 1]
        return found

    def _may_match(self, word: str) -> bool:
        # one edit leaves the first or the second half of a term whole; a stem's second half moves by one letter at most
        return (any((side, word[-k:] if side else word[:k]) in self.sides for side, k in self.lengths)
                or any(word[at:at + k] in held for (half, k), held in self.later.items() for at in (half - 1, half, half + 1)))

    def close(self, word: str) -> list[str]:
        """Terms of ``EDIT_LENGTH`` letters or more at an edit distance of exactly one: from the word, or, stems, from its beginning.

        The automaton's states after reading part of the trie are (place in the word, edits used), kept as two bit sets.
        """
        if len(word) < EDIT_LENGTH - 1 or not self._may_match(word):
            return []
        n, found = len(word), []
        places: dict[str, int] = defaultdict(int)
        for i, c in enumerate(word):
            places[c] |= 1 << i
        stack = [(self.root, 1, 2, 0)]  # no edit: at 0; one edit: the word's first letter skipped
        while stack:
            node, none, one, depth = stack.pop()
            if depth >= EDIT_LENGTH:
                # a stem has met some beginning of the word if any state is alive, and an exact one stays out
                found += [t for t, whole in node.get("", ()) if (one >> n & 1 and not none >> n & 1 if whole else one and not none)]
            for c, child in node.items():
                if c:
                    hit = places.get(c, 0)
                    kept = (none & hit) << 1
                    spent = (one & hit) << 1 | none << 1 | none | kept << 1  # match, substitute, a letter missing, a letter more
                    if kept | spent:
                        stack.append((child, kept, spent & (1 << n + 1) - 1, depth + 1))
        return found

    def swapped(self, word: str) -> list[str]:
        """Terms of ``EDIT_LENGTH`` letters or more that the word, or its beginning, is with two neighbouring letters swapped."""
        n, found, node = len(word), [], self.root
        for at in range(n - 1):
            a, b = word[at], word[at + 1]
            other = node.get(b, {}).get(a) if a != b else None
            end = at + 2
            while other is not None:
                if end >= EDIT_LENGTH:
                    found += [t for t, whole in other.get("", ()) if not whole or end == n]
                other, end = (other.get(word[end]), end + 1) if end < n else (None, end)
            node = node.get(a)
            if node is None:
                break
        return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    model: np.ndarray  # of the features, the constant last
    edited: dict[str, float] | None = None  # weights of the terms that allow an edit; without any, ``weights``
    trie: Trie = field(init=False)
    known: dict[str, tuple[float, bool] | None] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.trie = Trie(list(self.weights))

    def __reduce__(self):
        return Lexicon, (self.weights, self.model, self.edited)

    def close(self, word: str) -> dict[str, float]:
        """Weights of the terms that a word meets by one edit."""
        weights = self.weights if self.edited is None else self.edited
        return {t: weights[t] for t in (*self.trie.close(word), *self.trie.swapped(word)) if t in weights}

    def match(self, token: str) -> tuple[float, bool] | None:
        """Weight of the best term of a token and whether it matches exactly."""
        word = token.strip(_EDGES)
        exact = self.trie.exact(word)
        if exact:
            return max(self.weights[t] for t in exact), True
        close = self.close(word)
        return (max(close.values()), False) if close else None

    def hits(self, words: list[str]) -> list[tuple[int, float, bool]]:
        """(place, weight, exact) of every word that meets the lexicon."""
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = self.match(w)
        return [(i, *known[w]) for i, w in enumerate(words) if known[w]]

    def features(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        hits = self.hits(words)
        exact, edited, quoted, crowd, best = 0.0, 0.0, 0.0, 0.0, 0.0
        for k, (i, weight, same) in enumerate(hits):
            near = sum(abs(i - other[0]) <= WINDOW for other in hits[max(0, k - WINDOW):k + WINDOW + 1]) - 1
            if in_quotes(words, i):
                quoted += weight
                continue
            best = max(best, weight if same else weight / 2)
            crowd += near
            if same:
                exact += weight
            else:
                edited += weight
        share = (exact + edited) / max(1, len(words)) ** 0.5
        return np.array([np.log1p(exact), np.log1p(edited), np.log1p(quoted), np.log1p(crowd), best, share, 1.0])

    def misspelled(self, text: str | None) -> str:
        """The text with its second and third letter swapped, or one of two equal ones left out, in every word that meets the lexicon exactly."""
        words = tokens(text)
        for i, _, same in self.hits(words):
            word = words[i].strip(_EDGES)
            if same and len(word) >= EDIT_LENGTH:
                words[i] = words[i].replace(word, word[0] + (word[2] + word[1] if word[1] != word[2] else word[1]) + word[3:])
        return " ".join(words)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.model, -30, 30))))


def in_quotes(words: list[str], at: int) -> bool:
    """Whether marks that open within the window before the word close within the window after it."""
    first = next((i for i in range(at, max(-1, at - WINDOW - 1), -1) if words[i][0] in _OPEN), None)
    if first is None:
        return False
    last = next((i for i in range(first, min(len(words), at + WINDOW + 1)) if words[i].rstrip(".,;:!?…")[-1:] in _CLOSE and (i > first or len(words[i]) > 1)), None)
    return last is not None and last >= at


def sure_odds(held: dict[str, int], other: dict[str, int], toxic: int, others: int) -> dict[str, float]:
    """Log odds ratios of the terms that are surely tied to toxic rows, of ``LEAST_ROWS`` at least."""
    sure: dict[str, float] = {}
    for term, n in held.items():
        a, b = n + 0.5, other.get(term, 0) + 0.5
        odds = float(np.log(a / (toxic + 1)) - np.log(b / (others + 1)))
        if n >= LEAST_ROWS and odds - 2 * np.sqrt(1 / a + 1 / b) >= LEAST_ODDS:
            sure[term] = odds
    return sure


def choose_terms(held: dict[str, int], other: dict[str, int], toxic: int, others: int) -> dict[str, float]:
    """Weights (log odds ratios) of the terms that are surely tied to toxic rows.

    Whole words stay beside their stems, as edits are allowed on them.  Of the stems of nearly one weight that begin each
    other the shortest meets most words, and the longest is the safest one to allow an edit; those between add nothing.
    """
    sure = sure_odds(held, other, toxic, others)
    stems = {t: odds for t, odds in sure.items() if t.endswith("*")}
    longer = {t[:-2] + "*" for t, odds in stems.items() if odds > stems.get(t[:-2] + "*", np.inf) - 1}
    chosen: dict[str, float] = {}
    for term in sorted(sure, key=lambda t: (len(t.rstrip("*")), t)):
        size, odds = len(term.rstrip("*")), sure[term]
        begun = max((chosen.get(term[:k] + "*", -1.0) for k in range(PREFIX[0], size)), default=-1.0)
        if term not in stems or begun < odds - 1 or size >= EDIT_LENGTH and term not in longer:
            chosen[term] = odds
    return chosen


def fit(documents: DataFrame, labels: DataFrame, trainable: Column) -> Lexicon:
    """Learn from at most ``TOXIC_SAMPLE`` + ``OTHER_SAMPLE`` labelled rows, those with the smallest hashes of their ids.

    ``trainable`` is a condition on doc_id.  Without toxic rows the lexicon is empty and every score is near 0.
    Training rows hold few misspelled terms, so what an edited hit is worth is learned from the rows and their copies with
    the terms misspelled; a term whose edits meet many other rows allows none.
    """
    with scratch(documents.sparkSession):
        return _fitted(documents, labels, trainable)


def _fitted(documents: DataFrame, labels: DataFrame, trainable: Column) -> Lexicon:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(trainable)
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")
    chosen = marked.where("toxic = 1").orderBy(*order).limit(TOXIC_SAMPLE).union(marked.where("toxic = 0").orderBy(*order).limit(OTHER_SAMPLE))
    # a bounded number of small rows: the broadcast has a fixed bound; the sampled texts are read four times
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(trainable).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    texts = materialize(texts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, plain = [], Counter()
            for doc, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = terms_of(text)
                if toxic and found:
                    copy = min(zlib.crc32(t.encode()) for t in found)
                    out += [(t, copy, 0) for t in found]
                else:
                    plain.update(found)
            out += [(t, None, n) for t, n in plain.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["term", "copy", "n"])

    found = texts.mapInArrow(split, "term string, copy long, n long").groupBy("term").agg(F.count_distinct("copy").alias("held"), F.sum("n").alias("others"))
    rows = found.where((F.col("held") >= LEAST_ROWS) & (F.col("held") > F.col("others") / 4)).collect()  # terms of the sampled rows only
    count = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    held, other = {r["term"]: r["held"] for r in rows}, {r["term"]: r["others"] for r in rows}
    weights = choose_terms(held, other, count.get(1, 0), count.get(0, 0))
    plain = Lexicon(weights, np.zeros(7))

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[tuple[str, int]] = Counter()
        for batch in slices(batches):
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = {w.strip(_EDGES) for w in {*tokens(text), *tokens(plain.misspelled(text))}}
                met.update((t, toxic) for t in {t for w in words if not plain.trie.exact(w) for t in plain.close(w)})
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*((*t, n) for t, n in met.items())), (pa.string(), pa.int32(), pa.int64()))], names=["term", "toxic", "n"])

    near = {(r["term"], r["toxic"]): r["n"] for r in texts.mapInArrow(edits, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n")).collect()}
    lexicon = Lexicon(weights, np.zeros(7), sure_odds({t: near.get((t, 1), 0) for t in weights}, {t: near.get((t, 0), 0) for t in weights}, count.get(1, 0), count.get(0, 0)))

    # as there, a copy of every row with its terms misspelled stands beside it
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = batch.column(2).to_pylist()
            for form in (given, map(lexicon.misspelled, given)):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([lexicon.features(t).tolist() for t in form], pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    sample = texts.mapInArrow(measure, "doc_id long, toxic int, x array<double>").orderBy("doc_id", "toxic", "x").collect()
    lexicon.model = logistic(np.array([r["x"] for r in sample]).reshape(-1, 7), np.array([r["toxic"] for r in sample], float))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton steps; ``decay`` keeps separable data finite.  Without both labels only the constant is set."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 5.0 if len(y) and y.max() == 1 else -5.0
        return w
    ridge = np.full(len(w), decay)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return w


def score(documents: DataFrame, lexicon: Lexicon, bound: float = BOUND) -> DataFrame:
    """doc_id, score and predicted of every row, texts read whole.  Null and empty texts score as texts without hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [lexicon.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= bound) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
