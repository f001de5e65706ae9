"""Literal counts of the fixed tables, and the target of the ranking sources."""

import __spark_entry__ as entry
from conftest import SF

from lookweave import dims
from lookweave.operators import catalog, partners


def test_trends_and_sources_are_complete():
    assert len(dims.TRENDS) == 12 and sum(map(len, dims.TRENDS.values())) == 48
    assert sum(t.startswith("women") for t in dims.TRENDS) == 6
    assert len(dims.RANKING_SOURCES) == 10 and sum(q for *_, q in dims.RANKING_SOURCES) == 100


def test_sources_take_turns_until_the_target(spark):
    rows = [(s, p, p) for s in (0, 1, 2) for p in range(10)]
    feed = spark.createDataFrame(rows, "source int, product long, rank long")
    got = sorted((r["source"], r["product"]) for r in catalog.quota_fill(feed, {0: 2, 1: 3, 2: 4}, 6).collect())
    assert got == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (2, 5)]


def test_unlisted_anchor_gets_the_usual_partners(spark):
    """For each wearer among what they see, in one plan."""
    rows = [(1, "모자", "블랙", "모자", 0, "all"), (2, "상의", "화이트", "셔츠", 1, "all"), (3, "하의", "블랙", "바지", 1, "men"), (4, "신발", "블랙", "구두", 1, "all"), (5, "하의", "블랙", "치마", 1, "women")]
    items = spark.createDataFrame([(*r, False, False) for r in rows], "id long, category string, color string, name string, worn int, gender string, user_added boolean, deleted boolean")
    got = partners.outfit_partners(items, ["women", "men"])
    assert sorted((r["wearer"], r["slot"], r["partner"], r["shown"]) for r in got.where("anchor = 1").collect()) == [
        ("men", 0, 2, 97), ("men", 1, 3, 97), ("men", 2, 4, 97), ("women", 0, 2, 97), ("women", 1, 5, 97), ("women", 2, 4, 97)]
    assert [partners.display_score(v) for v in range(5)] == [97, 93, 89, 85, 84]


def test_sources_take_the_corrected_fields(spark):
    sources = spark.createDataFrame([(1, 10, "a", "a", "", "n1", "b1"), (2, 11, "a", "a", "", "n2", "b2")], "source_id long, rank long, category string, subcategory string, color string, name string, brand string")
    fixed = spark.createDataFrame([(10, "상의", "셔츠", "블랙", "블랙 상의 010", True), (12, "하의", "x", "y", "z", True), (13, "하의", "x", "y", "z", False)],
                                  "rank long, category string, subcategory string, color string, name string, changed boolean")
    got = {r["source_id"]: r for r in catalog.correct_sources(sources, fixed).collect()}
    assert (got[1]["name"], got[1]["brand"], got[1]["updated"], got[1]["changed_categories"]) == ("블랙 상의 010", None, True, 2)
    assert (got[2]["name"], got[2]["brand"], got[2]["updated"], got[2]["changed_categories"]) == ("n2", "b2", False, 2)


def test_short_groups_are_reported(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "g string, k long")
    wanted = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "g string, least long")
    assert sorted(tuple(r) for r in catalog.short_groups(rows, "k", "g", wanted).collect()) == [("b", 1, 2), ("c", 0, 1)]


def test_texts_count_for_their_first_language(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from check import differences

    rows = [(1, "a", "en"), (2, "a", "de"), (3, "b", "de"), (4, "c", None), (5, "c", "fr"), (6, "d", None), (7, None, "es"), (8, None, "de")]
    rows += [(20 + i, f"text {i}", "en") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("short_groups", "quota_per_group"):
        got = entry.queries()[name](spark, str(tmp_path)).toPandas()
        assert differences(got, con.execute(entry.oracle_sql()[name]).df()) == []
        assert got["lang"].isna().any()


def test_pieces_and_their_draws_come_from_one_pass_over_the_rows(spark):
    plan = entry.queries()["swap_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition(l_orderkey") == 1


def test_a_swap_is_never_a_used_item(spark):
    """Repeated and unseen parts, looks that use all items of a category, a wanted category other than the part's."""
    items = [(i, "abc"[i % 3], "x", False, ["all", "men", "women"][i % 4 % 3], False) for i in range(12)]
    wardrobe = spark.createDataFrame(items, "id long, category string, name string, user_added boolean, gender string, deleted boolean")
    rows = [(1, "men", 1, "a", 0), (1, "men", 2, "a", 0), (1, "men", 3, "b", 4), (2, "women", 1, "c", 2), (2, "women", 2, "a", 8), (2, "women", 3, "z", 5), (3, "men", 1, "a", 99),
            *[(4, "men", i + 1, "b", i) for i in range(12)]]
    got = {(r["look"], r["pos"]): r["swap"] for r in partners.swap_candidates(spark.createDataFrame(rows, "look long, gender string, pos int, category string, part long"), wardrobe).collect()}
    want = {}
    for look, gender, pos, category, _ in rows:
        seen = [i for i, c, _, added, g, gone in items if c == category and not gone and (added or g in ("all", gender))]
        free = [i for i in seen if i not in [r[4] for r in rows if r[0] == look]]
        if free:
            want[look, pos] = free[(look * 31 + pos * 17) % len(free)]
    assert got == want
