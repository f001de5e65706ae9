"""Exact search on any grid, cache rules, batches."""

import numpy as np

from lookweave.operators import vectors


def frame(spark, n, name, seed, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(i, "siglip" if i % 3 else "local", [float(v) for v in rng.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, family string, vector array<double>"), rows


def want(queries, rows, k):
    out = set()
    for q, fq, vq in queries:
        scored = []
        for i, fi, vi in rows:
            if fi == fq:
                c = float(np.dot(vq, vi) / (np.linalg.norm(vq) * np.linalg.norm(vi)))
                scored.append((-round(c, 9), i))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])}
    return out


def test_any_grid_is_exact(spark):
    (queries, q), (rows, v) = frame(spark, 20, "query", 1), frame(spark, 120, "id", 2)
    for block in (2048, 5):  # one cell, many cells
        got = {(r["query"], r["id"], r["rank"]) for r in vectors.top_similar(queries, rows, 4, block).collect()}
        assert got == want(q, v, 4)


def test_best_pieces_on_any_grid(spark):
    (items, v), (pieces, p) = frame(spark, 30, "id", 3), frame(spark, 9, "piece", 4)
    expected = want(v, p, 2)
    for block in (2048, 4):
        got = {(r["id"], r["piece"], r["rank"]) for r in vectors.best_pieces(items, pieces, 2, block).collect()}
        assert got == expected


def test_a_query_finds_itself_and_odd_lengths_never_compare(spark):
    rows = spark.createDataFrame([(1, "siglip", [1.0, 2.0]), (2, "siglip", [2.0, 1.0]), (3, "siglip", [1.0, 2.0, 3.0]), (4, "siglip", [])],
                                 "id long, family string, vector array<double>")
    got = vectors.top_similar(rows.where("id = 1").withColumnRenamed("id", "query"), rows, 5).orderBy("rank").collect()
    assert [(r["id"], r["cosine"] > 0.9999) for r in got] == [(1, True), (2, False)]


def test_close_pairs_lose_none(spark):
    """Pruned pairs against all pairs, with several families, odd lengths and vectors on a pivot; most pairs need no cosine."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 5))
    make = lambda n, scale: [(i, "siglip" if i % 5 else "local", [float(x) for x in centres[i % 12] * (1 + i % 3) + rng.normal(scale=scale, size=5)]) for i in range(n)]
    items, pieces = make(200, 0.3), make(36, 0.2)
    items += [(900, "siglip", []), (901, "siglip", [1.0, 2.0]), (902, "siglip", [0.0] * 5), (903, "siglip", pieces[1][2])]
    pieces += [(901, "siglip", [1.0, 2.1])]
    cos = lambda a, b: round(float(np.dot(a, b) / max(1e-12, np.linalg.norm(a) * np.linalg.norm(b))), 9) if len(a) == len(b) and len(a) else None
    want = {(i, p) for i, f, v in items for p, g, w in pieces if f == g and cos(v, w) is not None and cos(v, w) >= 0.9}
    close, computed = vectors.close_pairs(spark.createDataFrame(items, "id long, family string, vector array<double>"), spark.createDataFrame(pieces, "piece long, family string, vector array<double>"), 0.9)
    assert {(r["id"], r["piece"]) for r in close.collect()} == want and len(want) > 100
    assert computed.count() < 0.4 * sum(f == g for _, f, _ in items for _, g, _ in pieces)


def test_cache_rules_and_batches(spark):
    items = spark.createDataFrame([(1, "h1", None, ""), (2, "h2", None, ""), (3, "h3", [1.0], "siglip:m"), (4, "h4", [1.0], "siglip:old")],
                                  "id long, hash string, stored_vector array<double>, stored_engine string")
    cache = spark.createDataFrame([(1, "m", "h1", [2.0]), (2, "m", "stale", [2.0]), (3, "other", "h3", [9.0])], "id long, model string, hash string, vector array<double>")
    ready = {r["id"]: r["ready"] for r in vectors.cached_vectors(items, cache, "m").collect()}
    assert ready == {1: [2.0], 2: None, 3: [1.0], 4: None}
    plan = vectors.encode_plan(spark.range(70)).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in plan) == [6, 32, 32]
    encoded = vectors.encode(vectors.encode_plan(spark.range(5)), lambda it: (f.assign(vector=[[1.0]] * len(f)) for f in it), "id long, batch long, vector array<double>")
    assert encoded.count() == 5


def test_every_item_may_be_linked_again(spark, tmp_path):
    """Items of labels and ids that an earlier form of the query left out."""
    import duckdb

    import __spark_entry__ as entry
    from check import differences

    rng = np.random.default_rng(5)
    near = lambda label: [float(v) for v in 10 * np.eye(12)[label] + rng.normal(scale=0.3, size=12)]
    rows = [(i, i % 10, [float(v) for v in rng.normal(size=12)]) for i in range(10)] + [(i, i % 10, near(i % 10)) for i in range(10, 90)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = entry.queries()["relink_margin"](spark, str(tmp_path)).toPandas()
    assert differences(got, con.execute(entry.oracle_sql()["relink_margin"]).df()) == []
    assert (got["id"] % 4 == 1).any() and (got["id"] % 10 == 4).any()
