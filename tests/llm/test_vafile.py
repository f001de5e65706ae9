"""Exact search against all inner products."""

import numpy as np
import pytest

from lookweave.llm import vafile


def brute(rows, queries, k):
    out = []
    for q, a in queries:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("wave,blocks", [(3, 8192), (1, 16)])
def test_all_scores(spark, monkeypatch, wave, blocks):
    monkeypatch.setattr(vafile, "WAVE", wave)
    monkeypatch.setattr(vafile, "ROW_BLOCK", blocks)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", blocks)
    rng = np.random.default_rng(blocks)
    made = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 6)).astype(np.float32))]
    made += [(200 + i, made[3][1]) for i in range(30)] + [(300, [0.0] * 6), (301, [1e3, 0.0, 0.0, 0.0, 0.0, -1e3]), (302, [1.0, 2.0]), (400, [0.5, 1.5])]
    bad = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in made + bad], "vec_id long, embedding array<float>, score int")
    rows = vafile.integer_vectors(frame)
    got = sorted(tuple(r) for r in vafile.top_k(rows, rows.where("vec_id % 100 = 0"), 10).collect())
    whole = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in made]
    assert got == brute(whole, [(i, v) for i, v in whole if i % 100 == 0], 10)


def test_repeated_rows_and_empty_tables(spark):
    rows = vafile.integer_vectors(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (5, [2.0]), (5, [2.0]), (7, [])], "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in vafile.top_k(rows, rows.where("vec_id = 0"), 3).collect())
    assert got == [(0, 1, 5, 2048 * 1024), (0, 2, 5, 2048 * 1024)]
    assert vafile.top_k(rows.limit(0), rows.limit(0), 3).count() == 0
    assert vafile.top_k(rows, rows.limit(0), 3).count() == 0


def test_large_components(spark):
    """Huge finite components take part: whole sums beyond 2^53, limits of a long, ties by id."""
    made = [(0, [1e9, -2e9]), (1, [1e9, 1e12]), (2, [3e12, 1e5]), (3, [1e300, 1e300]), (4, [-1e300, -1e300]), (5, [1e9 + 1.5, -2e9]), (6, [1e9 + 1.5, -2e9 - 0.25]), (7, [0.0, 0.0]), (8, [1e300, 1e299])]
    rows = vafile.integer_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    whole = [(i, [max(-(1 << 53), min(1 << 53, int(np.floor(min(max(1024 * x, -1e17), 1e17))))) for x in v]) for i, v in made]
    for asked in (0, 3, 4):
        want = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(whole[asked][1], v)))), i) for i, v in whole if i != asked)
        got = sorted(tuple(r) for r in vafile.top_k(rows, rows.where(f"vec_id = {asked}"), 5).collect())
        assert got == [(asked, r, i, -s) for r, (s, i) in enumerate(want[:5], 1)]
