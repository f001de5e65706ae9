"""The filter audit against plain loops over all orders; tries against dictionaries."""

import re
from itertools import permutations

import numpy as np
import pytest

from lookweave.llm import filteraudit


def brute(docs, labels):
    low = {}
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    marked = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > low[t])) if bad}
        marked.append((lang or "", fails, any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)))
    out, shares = {}, {}
    for part in {m[0] for m in marked}:
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in marked if m[0] == part]
            for step, f in enumerate(order, 1):
                here = [m for m in left if f in m[1]]
                redundant = sum(f in m[1] and bool(m[1] & set(order[:step - 1])) for m in marked if m[0] == part)
                only = sum(m[1] == {f} for m in marked if m[0] == part)
                left = [m for m in left if f not in m[1]]
                out[part, order, step] = [len(left), len(here), redundant, only, sum(m[2] for m in here), sum(m[3] for m in here)]
                shares[part, f] = shares.get((part, f), 0) + len(here)
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def found(spark, docs, labels):
    frame = spark.createDataFrame([(*d, 0, "x", 1) for d in docs], "doc_id long, text string, lang string, mask int, term string, quality int").repartition(3)
    said = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    return sorted(tuple(r) for r in filteraudit.audit(frame, said).collect())


def texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)] + ["é", "中文", "UPPER", "#tag", "a|b", "x y", "x\u0085y", "\x1c"]
    made = [" ".join(rng.choice(words, rng.integers(0, 260))) for _ in range(60)]
    head = "the same long beginning " * 30
    made += [head + t for t in made[:20]] + [head[:k] for k in range(0, 120, 7)] + ["", " \t\n", "A" * 3000, "ab\n" * 500]
    return made


@pytest.mark.parametrize("block,limit", [(16 << 20, 32 << 20), (2000, 1500)])
def test_all_orders(spark, monkeypatch, block, limit):
    for name, value in (("BLOCK", block), ("LIMIT", limit), ("LEAST", limit), ("FAN", 2 if block == 2000 else 8)):
        monkeypatch.setattr(filteraudit, name, value)
    made, rng = texts(), np.random.default_rng(2)
    docs = [(int(i), made[int(rng.integers(len(made)))], [None, "", "en", "de"][i % 4]) for i in rng.permutation(300)]
    docs += [(1000 + i, made[-1], "en") for i in range(60)] + [(2000, None, "en"), (2001, None, None), (None, made[0], "en"), (None, made[0], "en")]
    docs += [docs[0], docs[0], (-5, made[3], "fr"), (docs[1][0], "another text of a repeated id", "en")]
    labels = [(int(i), int(i % 2), int(i % 3 == 0)) for i in range(0, 250, 2)] + [(4, None, None), (6, 1, 1), (6, 0, 0), (None, 1, 1), (99999, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "x", "en")], []) == brute([(1, "x", "en")], [])


def test_trie_is_a_dictionary():
    rng, trie, seen = np.random.default_rng(4), filteraudit.Trie(), {}
    for k in range(3000):
        text, low = bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) * int(rng.integers(1, 4)), int(rng.integers(50))
        place = trie.add(text, low, k)
        seen.setdefault(text, []).append((low, k, place))
    for rows in seen.values():
        assert len({p for _, _, p in rows}) == 1
        assert trie.low[rows[0][2]] == min(rows)[0] and trie.owner[rows[0][2]] == min(rows)[1]
    assert len(trie.low) == len(seen)
