"""Near-duplicate groups against all pairs, and the component rounds."""

import random

import pytest

from lookweave.llm import graph, neardup


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 1, "m") for i, t in enumerate(texts)], "doc_id long, text string, n int, mark string")


def brute(texts, percent):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(sets):
        for j, q in enumerate(sets[:i]):
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus(rng):
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "É x", "é x"]
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(5, 150))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    # one large family around the threshold, so that regions have several groups
    base = rng.choices(words, k=200)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2)])
def test_groups_are_those_of_all_pairs(spark, percent, seed):
    texts = corpus(random.Random(seed))
    got = neardup.near_duplicates(rows(spark, texts), percent).toPandas().sort_values("doc_id")
    sizes, labels = brute(texts, percent)
    assert got["n_shingles"].tolist() == sizes
    assert got["component_id"].tolist() == labels
    assert got["kept"].tolist() == [i == k for i, k in enumerate(labels)]


def test_nulls_repeats_and_empty_table(spark):
    assert neardup.near_duplicates(rows(spark, [])).count() == 0
    data = [(None, "a b c d e f"), (3, "a b c d e f"), (5, "A b c d e f"), (5, "A b c d e f"), (None, "only here without an id"), (7, None)]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str)
    assert found == sorted([(None, 3, False), (3, 3, True), (5, 3, False), (5, 3, False), (None, None, True), (7, 7, True)], key=str)


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    names = rng.sample(range(1000), 60)
    edges = list(zip(names[:40], names[1:40])) + list(zip(names[40:], names[41:])) + [(5000, 5001), (5001, 5001)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(g) for g in (names[:40], names[40:], [5000, 5001]) for x in g if x != min(g)}
    assert got == want
