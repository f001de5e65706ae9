"""Decontamination: the masks lose nothing, and overlaps against all diagonals."""

import random
from itertools import combinations

import numpy as np

from lookweave.llm import decontam


def test_masks_find_every_allowed_window():
    assert decontam.substitutions(4) == -1 and decontam.substitutions(5) == 0 and decontam.substitutions(16) == 3
    for window in range(5, decontam.WINDOW + 1):
        item = np.arange(1, window + 1, dtype=np.uint64)
        own = set(decontam.seeds(item)[0].tolist())
        for gone in combinations(range(window), decontam.substitutions(window)):
            other = item.copy()
            other[list(gone)] += 1000
            assert own & set(decontam.seeds(other)[0].tolist()), (window, gone)


def brute(docs, items):
    out = {}
    for d, text in enumerate(docs):
        a = decontam.hashes_of(text)
        for i, item in enumerate(items):
            b = decontam.hashes_of(item)
            if len(b) < 5:
                continue
            found = [w for diagonal in range(-len(b), len(a)) if (w := decontam.best_window(a, b, diagonal))]
            if found:
                equal, window, start, matched = max(found, key=lambda w: (w[0], w[3], -w[2]))
                out[d, i] = (equal, window, start, matched)
    return out


def test_overlaps(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(words, k=k)) for k in (4, 5, 9, 15, 16, 30, 30)] + [None, "", "same words in two items here"] + ["Same words in two  items here"]
    docs = [None, "", "w1"]
    for _ in range(60):
        text = rng.choices(words, k=rng.randint(0, 40))
        source = (rng.choice(items) or "").split()
        at = rng.randrange(max(1, len(source) - 15))
        piece = source[at:at + rng.choice((8, 16, 40))]
        for _ in range(rng.randint(0, 5)):
            if piece:
                piece[rng.randrange(len(piece))] = "zz"
        docs.append(" ".join(text[:20] + piece + text[20:]))
    frame = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(docs)], "doc_id long, text string, seed int, key string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["equal"], r["window"], r["start"], r["matched"]) for r in decontam.contaminations(frame, bench).collect()}
    assert got == want and len(want) > 20
    left = decontam.drop_contaminated(frame, bench)
    assert left.columns == frame.columns
    assert {r["doc_id"] for r in left.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert decontam.contaminations(frame, bench.limit(0)).count() == 0 and decontam.contaminations(frame.limit(0), bench).count() == 0
    assert decontam.drop_contaminated(frame.union(frame), bench.limit(0)).count() == 2 * len(docs)


def test_missing_ids(spark):
    text = "five words make a passage here"
    frame = spark.createDataFrame([(None, text), (2, text), (2, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.contaminations(frame, bench).collect()) == [("2", 9), ("None", 9)]


def test_dropped_rows_keep_columns_of_any_name(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage, "k", 1), (2, "something else", "l", 2)], "doc_id long, text string, KEY string, __key int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontam.drop_contaminated(docs, bench)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "something else", "l", 2)]
