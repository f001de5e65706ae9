"""The prefix trie against a dictionary of prefixes; contraction on trees of every shape."""

import hashlib
import zlib

import numpy as np
import pytest

from lookweave.llm import prefixtrie


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made = own.get(base, [])[:h] + turns[h:]
        for d in range(len(made) + 1):
            nodes.setdefault(tuple(made[:d]), []).append((c, d == len(made)))
    kids, leaves, saved = ({p: 0 for p in nodes} for _ in range(3))
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    low = lambda p: min(c for c, _ in nodes[p])
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in nodes[p] if e)).encode()).hexdigest()
    return sorted(((low(p), len(p), low(p[:-1]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items()), key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth string, parent long, c int")
    return sorted((tuple(r) for r in prefixtrie.trie(frame).collect()), key=str)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_all_prefixes(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefixtrie, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    for c in range(-12, 60):
        if c % 7 == 3:
            continue  # shared firsts that are absent
        for t in range(int(rng.integers(1, 14))):
            rows.append((c, int(t), ["user", "assistant", None][int(rng.integers(3))], ["a", "b", "é", "", None][int(rng.integers(5))]))
    rows += [(61, t, "user", f"only {t}") for t in range(90)] + [(62, t, "user", f"only {t}") for t in range(70)]
    rows += [(65, None, "user", "first"), (65, None, "user", "also first"), (65, 0, None, "x"), (65, 0, "user", "x"), (65, 0, "user", "x"), (None, 1, "user", "no id"), (70, -1, "user", "long " * 20000)]
    rows += [(c, 0, "user", "hello") for c in range(100, 140)]  # most of them end where many end
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


SHAPES = {
    "chain": lambda k, rng: k - 1, "star": lambda k, rng: 0, "random": lambda k, rng: int(rng.integers(k)), "caterpillar": lambda k, rng: k - 1 if k % 2 else max(0, k - 2),
    "recent": lambda k, rng: max(0, k - 1 - int(rng.integers(3))),
}


def test_subtree_totals(spark):
    """A chain, a star, random trees and caterpillars side by side."""
    rng, n, rows, total = np.random.default_rng(1), 240, [], []
    for shape, pick in enumerate(SHAPES.values()):
        first = shape * n
        parent = [None] + [first + pick(k, rng) for k in range(1, n)]
        depth, value = [0] * n, [int(x) for x in rng.integers(-5, 9, n)]
        for k in range(1, n):
            depth[k] = depth[parent[k] - first] + 1
        rows += [(first + k, parent[k], depth[k], value[k]) for k in range(n)]
        own = list(value)
        for k in sorted(range(1, n), key=lambda k: -depth[k]):
            own[parent[k] - first] += own[k]
        total += own
    tree = spark.createDataFrame(rows, "id long, parent long, depth long, value long")
    got = {r["id"]: r["value"] for r in prefixtrie.subtree_totals(tree, ["value"]).collect()}
    assert got == dict(enumerate(total))
