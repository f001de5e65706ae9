"""Embedding near-duplicates against all cosines, with tiles of a few rows."""

import numpy as np
import pytest

from lookweave.llm import vectordup

SCHEMA = "vec_id long, embedding array<float>, label int, code string, size int"


def brute(rows, least):
    """(id, links, smallest reachable id, kept) of every row."""
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    near = {a: [] for a in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.float64(np.float32(rows[k][1])) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    near[a].append(b)
                    near[b].append(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        low = min(rows[b][0] for b in seen) if ok[a] else rows[a][0]
        out.append((rows[a][0], len(near[a]), low, rows[a][0] == low))
    return sorted(out, key=str)


def found(spark, rows, least):
    frame = spark.createDataFrame([(i, v, lab, "x", 0) for i, v, lab in rows], SCHEMA)
    return sorted((tuple(r) for r in vectordup.near_duplicates(frame, least).collect()), key=str)


@pytest.mark.parametrize("tile,strip,bins", [(1024, 256, 1 << 16), (7, 3, 1)])
def test_all_pairs(spark, monkeypatch, tile, strip, bins):
    for name, value in (("TILE", tile), ("STRIP", strip), ("BINS", bins)):
        monkeypatch.setattr(vectordup, name, value)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(4, 12))
    rows = []
    for i in range(160):  # noise that puts many cosines near the threshold
        v = centres[i % 4] + rng.normal(scale=0.05 + 0.1 * (i % 5), size=12)
        rows.append((1000 - i, [float(np.float32(x)) for x in v * 10.0 ** (i % 3)], i % 3))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(25)] + [rows[5], (5, rows[6][1], None), (6, None, 1), (7, [], 1)]
    rows += [(8, [0.0] * 12, 1), (9, [-0.0] * 12, 1), (10, [None] + [1.0] * 11, 1), (11, [float("nan")] * 12, 1), (12, [float("inf")] + [1.0] * 11, 1)]
    rows += [(None, rows[7][1], rows[7][2]), (13, [1.0, 0.0], 1), (14, [2.0, -0.0], 1), (15, [-1.0, 0.0], 1), (16, [3e38] * 12, 1), (17, [1e-40] * 12, 1)]
    assert found(spark, rows, 0.98) == brute(rows, 0.98)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for dim in (1, 2, 64, 300):
        u = vectordup.unit(np.concatenate([rng.normal(size=(200, dim)), rng.standard_cauchy(size=(200, dim))]))
        code, step, left = vectordup.quantised(u)
        about = (code.astype(float) @ code.T.astype(float)) * step[:, None] * step
        off = left[:, None] * (1 + left) + left * (1 + left[:, None]) + left[:, None] * left
        assert (np.abs(u @ u.T - about) <= off + vectordup.SLACK).all()


def test_empty_table(spark):
    assert found(spark, [], 0.98) == []


def test_one_large_group_is_linear(spark, monkeypatch):
    """Near copies of one vector: the cells return sums and a forest, not the pairs."""
    monkeypatch.setattr(vectordup, "TILE", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in 1 + rng.normal(scale=0.01, size=16)], 0) for i in range(500)]
    sizes, real = [], vectordup.materialize
    monkeypatch.setattr(vectordup, "materialize", lambda df: sizes.append((out := real(df)).count()) or out)
    assert found(spark, rows, 0.98) == [(i, 499, 0, i == 0) for i, _, _ in sorted(rows, key=lambda r: str((r[0], 499, 0, r[0] == 0)))]
    assert max(sizes) <= 500 * 2 * (500 // 64 + 1)
