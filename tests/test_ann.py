"""The inverted file: recall against the exact search, crowded lists, odd rows, later additions."""

import tracemalloc

import numpy as np
import pandas as pd

from lookweave.operators import ann, vectors

SCHEMA = "id long, family string, vector array<double>"


def clustered(n, seed, dim=16, groups=12, spread=0.45):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, "siglip" if i % 4 else "local", [float(x) for x in centres[i % groups] + rng.normal(scale=spread, size=dim)]) for i in range(n)]


def share_found(found, exact):
    rows = ann.recall(found, exact).collect()
    return sum(r["hits"] for r in rows) / sum(r["expected"] for r in rows)


def test_recall_and_exactness(spark):
    rows = spark.createDataFrame(clustered(1500, 1), SCHEMA)
    queries = rows.where("id % 100 = 0").withColumnRenamed("id", "query")
    exact = vectors.top_similar(queries, rows, 10)
    index = ann.build(rows)
    assert index.lists.select("id").distinct().count() == 1500
    assert share_found(ann.search(index, queries, 10), exact) >= 0.9
    every = ann.search(index, queries, 10, share=1.0, block=37)  # all lists, cut into parts of both sides
    want = {(r["query"], r["id"], r["rank"]) for r in exact.collect()}
    assert {(r["query"], r["id"], r["rank"]) for r in every.collect()} == want


def test_added_rows_and_odd_rows_are_found(spark):
    base = clustered(300, 2)
    odd = [(9000, "siglip", [1.0, 2.0]), (9001, "siglip", [2.0, 1.0]), (9002, "rare", [1.0] * 16), (9003, "siglip", []), (9004, "siglip", [0.0] * 16), (9005, None, [1.0] * 16), (9006, "siglip", None)]
    index = ann.build(spark.createDataFrame(base, SCHEMA))
    more = ann.add(index, spark.createDataFrame(odd + [(9100, "siglip", base[1][2])], SCHEMA))
    queries = spark.createDataFrame([(1, "siglip", base[1][2]), (2, "siglip", [1.0, 2.0]), (3, "rare", [1.0] * 16), (4, "absent", [1.0])], "query long, family string, vector array<double>")
    got = {}
    for r in ann.search(more, queries, 3).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert got[1][:2] == [1, 9100] and got[2] == [9000, 9001] and got[3] == [9002] and 4 not in got


def test_one_crowded_list_and_empty_tables(spark):
    same = [(i, "siglip", [1.0, 0.5 + 1e-3 * (i % 7), 0.0]) for i in range(400)]
    rows = spark.createDataFrame(same, SCHEMA)
    queries = rows.where("id < 3").withColumnRenamed("id", "query")
    found = ann.search(ann.build(rows), queries, 5, share=1.0, block=50)
    assert {(r["query"], r["id"]) for r in found.collect()} == {(r["query"], r["id"]) for r in vectors.top_similar(queries, rows, 5).collect()}
    assert ann.search(ann.build(rows.limit(0)), queries, 5).count() == 0
    assert ann.search(ann.build(rows), queries.limit(0), 5).count() == 0


class _Frames:
    """Stands for a DataFrame whose partition function is run here."""

    def __init__(self, rows=None):
        self.rows = rows

    def orderBy(self, _):
        return self

    def collect(self):
        return self.rows

    def select(self, *_):
        return self

    def mapInPandas(self, place, _):
        return place


def _placed(rows, centroids, wanted):
    place = ann._nearest(_Frames(), "id", _Frames([{"list": i, "family": "a", "vector": v} for i, v in enumerate(centroids)]), lambda n: wanted)
    tracemalloc.start()
    out = pd.concat(list(place(iter([rows]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_placing_a_large_batch_holds_a_bounded_number_of_cosines():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"id": np.arange(10_000), "family": "a", "vector": list(rng.normal(size=(10_000, 8)))})
    out, peak = _placed(rows, rng.normal(size=(2048, 8)), 3)
    print(f"peak {peak / 1e6:.0f} MB")
    assert len(out) == 30_000 and out.groupby("id").size().eq(3).all()
    assert peak < 100e6


def test_rows_are_placed_alike_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"id": np.arange(500), "family": np.where(np.arange(500) % 7 == 0, "b", "a"), "vector": list(rng.integers(-3, 4, (500, 4)).astype(float))}, index=np.arange(500))
    listed = lambda: sorted(map(tuple, _placed(rows, centroids, 4)[0][["list", "id"]].itertuples(index=False)))
    centroids = rng.integers(-3, 4, (40, 4)).astype(float)
    whole = listed()
    monkeypatch.setattr(ann, "CELLS", 100)
    assert listed() == whole and (ann.REST, 0) in whole
