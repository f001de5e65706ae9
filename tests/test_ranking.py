"""Numbering with a hot key, neighbours and carried marks."""

from pyspark.sql import functions as F

from lookweave.operators import dedupe, evaluation, ranking


def hot(spark, n=3000):
    """One key holds two thirds of the rows."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("k"), ((F.col("id") * 7919) % n).alias("v"))


def test_number_rows_with_a_hot_key(spark):
    got = ranking.number_rows(hot(spark), [F.col("v")], "n", ["k"]).toPandas()
    want = got.sort_values(["k", "v"]).groupby("k").cumcount() + 1
    assert (got["n"] == want.reindex(got.index)).all()
    assert sorted(ranking.number_rows(hot(spark), [F.col("v")], "n").toPandas()["n"]) == list(range(1, 3001))


def test_previous_row_and_last_mark(spark):
    rows = ranking.with_previous(hot(spark, 600), ["k"], [F.col("v")], ["v"])
    got = rows.toPandas().sort_values("n")
    want = got.groupby("k")["v"].shift(1)
    assert got["prev_v"].fillna(-1).tolist() == want.fillna(-1).tolist()
    marked = ranking.last_marked(rows, "n", F.col("prev_v").isNull(), "start", chunk=50).toPandas().sort_values("n")
    assert marked["start"].tolist() == marked["n"].where(marked["prev_v"].isna()).ffill().tolist()


def test_exact_median(spark):
    got = evaluation.exact_median(hot(spark), "k", "v", "m").toPandas().set_index("k")["m"].sort_index()
    want = hot(spark).toPandas().groupby("k")["v"].median().sort_index()
    assert got.tolist() == want.tolist()


def test_two_key_dedupe_equals_a_scan(spark):
    rows = [(i, (i * 37) % 23, (i * 53) % 19) for i in range(200)]
    seen_a, seen_b, kept = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            kept.append(i)
    frame = spark.createDataFrame(rows, "i long, a long, b long")
    assert sorted(r["i"] for r in dedupe.first_by_two_keys(frame, "a", "b", "i").collect()) == kept


def test_pages(spark):
    """Every page by its keys, equal first keys across a boundary, and no page beyond the last."""
    rows = spark.createDataFrame([(i // 10, f"k{i:03d}") for i in range(53)], "a int, b string").repartition(4)
    bounds = ranking.page_bounds(rows, ["a", "b"], 8)
    assert sorted((r["page"], r["rows"], r["more"]) for r in bounds.collect()) == [(p, 8, True) for p in range(6)] + [(6, 5, False)]
    for number in range(8):
        got = ranking.page(rows, bounds, number).orderBy("place").collect()
        assert [r["b"] for r in got] == [f"k{i:03d}" for i in range(8 * number, min(53, 8 * number + 8))] and [r["place"] for r in got] == list(range(1, len(got) + 1))
    assert ranking.page(rows, ranking.page_bounds(rows.limit(0), ["a", "b"], 8), 0).count() == 0


def test_accepted_first(spark):
    rows = spark.createDataFrame([(1, True, 0.1, 5), (1, False, 0.9, 1), (1, True, 0.5, 2), (1, True, 0.5, 1), (2, False, 0.2, 1)], "photo int, ok boolean, area double, line int")
    got = {(r["photo"], r["line"]): r["place"] for r in ranking.accepted_first(rows, ["photo"], "ok", "area", ["line"]).collect() if (r["photo"], r["area"]) != (1, 0.9)}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 5): 3, (2, 1): 1}
