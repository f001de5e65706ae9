"""Contraction against a plain search, and tables that shrink."""

import random

from lookweave.operators import graph


def brute(edges):
    near = {}
    for k, a, b in edges:
        near.setdefault((k, a), set()).add((k, b))
        near.setdefault((k, b), set()).add((k, a))
    label = {}
    for v in sorted(near):
        todo = [v] if v not in label else []
        while todo:
            w = todo.pop()
            if w not in label:
                label[w] = v[1]
                todo += near[w]
    return {(k, v, low) for (k, v), low in label.items() if v != low}


def test_components(spark, monkeypatch):
    """Chains in rising, shuffled and zigzag order, a star, loops and random edges, side by side; the tables shrink."""
    rng, sizes, real = random.Random(1), [], graph.materialize
    order = list(range(300))
    rng.shuffle(order)
    edges = [(0, i, i + 1) for i in range(300)] + [(1, order[i], order[i + 1]) for i in range(299)]
    edges += [(2, i, 1000 - i) for i in range(200)] + [(2, 1000 - i, i + 1) for i in range(200)]
    edges += [(3, 500, i) for i in range(200)] + [(4, 1, 1), (4, 2, 2)] + [(5 + rng.randrange(3), rng.randrange(150), rng.randrange(150)) for _ in range(200)]
    monkeypatch.setattr(graph, "materialize", lambda df: sizes.append((out := real(df)).count()) or out)
    got = graph.components(spark.createDataFrame(edges, "k long, a long, b long"), ["k"]).collect()
    assert {tuple(r) for r in got} == brute(edges) and len(got) == len(brute(edges))
    drawn = sizes[0:sizes.index(0) + 1:2]
    assert drawn[-1] == 0 and len(drawn) <= 9 and all(b < a for a, b in zip(drawn, drawn[1:])) and all(b <= 0.7 * a for a, b in zip(drawn[1:], drawn[2:]))


def test_no_edges_and_no_keys(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graph.components(none).count() == 0
    pair = spark.createDataFrame([(5, 2), (2, 9), (7, 7)], "a long, b long")
    assert {tuple(r) for r in graph.components(pair).collect()} == {(5, 2), (9, 2)}
