"""Look gates, default selection, retention over item sets."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF

from lookweave.operators import feedback, matching, quality


def test_a_look_that_is_not_analysed_scores_nothing(spark):
    looks = spark.createDataFrame([(1, "선선함,맑음", True), (2, "선선함", False), (3, "선선함", True)], "id long, weather string, analysis_ready boolean")
    signed = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "look long, signature string")
    kept = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.9, 0.5)], "look long, similarity double, color_sim double")
    rows = {r["look"]: r for r in matching.match_summary(kept, signed, looks).collect()}
    assert (rows[1]["fulfilled"], rows[1]["total"], rows[1]["score"], rows[1]["analyzed"]) == (1, 2, 82, True)
    for look in (2, 3):  # not analysed; without pieces
        assert tuple(rows[look])[1:] == (0, 0, 0.0, 0.0, 0, 0, False)


def test_default_selection(spark):
    ranked = spark.createDataFrame([(p, 10 * p + r, r) for p in (1, 2) for r in range(1, 6)], "person long, look long, rank long")
    chosen = spark.createDataFrame([(1, 99), (1, 99), (3, 98)], "person long, look long")
    got = sorted(tuple(r) for r in matching.default_selection(ranked, chosen).collect())
    assert got == [(1, 99, False), (2, 21, True), (2, 22, True), (2, 23, True), (3, 98, False)]


def test_retention_needs_every_item(spark):
    rows = [(1, 1, True, [1, 2]), (1, 2, False, [3]), (2, 1, True, [1, 9]), (2, 2, False, [1]), (3, 1, True, [9]), (4, 1, False, [1]), (5, 1, True, []), (5, 2, False, [1]),
            (6, 1, True, [1, None]), (6, 2, False, [1]), (7, 1, True, [1]), (7, 2, True, [2]), (7, 3, False, [9])]
    attempts = spark.createDataFrame(rows, "person long, ts long, ok boolean, items array<long>")
    alive = spark.createDataFrame([(1,), (2,), (2,), (3,)], "item long")
    got = {r["person"]: (r["ts"], r["retained"]) for r in feedback.retain_last_good(attempts, "person", F.col("ok"), ["ts"], ["ts"], "items", alive).collect()}
    # 2 lost an item, 4 never had a usable attempt, 6 holds an unknown item; 3 is fresh, whatever became of its item
    assert got == {1: (1, True), 3: (1, False), 5: (1, True), 7: (2, True)}


def test_refine_selection_follows_the_request(spark):
    rows = [(p, i, cat, area, ok) for p in (1, 2, 3) for i, (cat, area, ok) in enumerate([("상의", 0.5, True), ("아우터", 0.9, False), ("하의", 0.7, True), ("신발", 0.2, True), ("가방", 0.1, True)])]
    detections = spark.createDataFrame(rows, "photo long, line int, category string, area double, accepted boolean")
    requests = spark.createDataFrame([(1, False, [], None), (2, True, ["상의", "아우터"], {"아우터": "상의"}), (4, True, None, None)], "photo long, include_rejected boolean, categories array<string>, overrides map<string,string>")
    got = sorted((r["photo"], r["rank"], r["category"], r["target"], r["skipped"]) for r in quality.refine_selection(detections, requests, ["line"], 3).collect())
    assert got == [(1, 1, "하의", "하의", 1), (1, 2, "상의", "상의", 1), (1, 3, "신발", "신발", 1), (2, 1, "상의", "상의", 0), (2, 2, "아우터", "상의", 0)]


def test_what_follows_the_assignment_does_not_return_to_the_order_lines(spark):
    """Signatures are known per kind of requirement; the rows of all looks are derived once, not again for each use."""
    for name in ("match_summary", "usable_looks", "rank_looks", "assemble_options", "collapse_duplicates"):
        assert not [f for f in entry.queries()[name](spark, SF).inputFiles() if "lineitem" in f], name


def test_totals_count_signatures_of_requirements_beyond_the_lists_and_without_candidates(spark):
    rows = [(1, p, 7, p % 3, 70, False, 5) for p in range(1, 13)] + [(1, 13, 8, 9, 80, False, None), (2, 1, 8, 9, 80, False, None)]
    rows = spark.createDataFrame(rows, "look long, pos int, kind long, sid long, lid long, own boolean, first long")
    looks = matching._looks(matching.Lists(rows, rows.sparkSession.createDataFrame([], "lid long, options array<struct<item:long>>")))
    assert {r["look"]: (r["total"], len(r["asked"]), r["clash"]) for r in looks.collect()} == {1: (4, 8, True), 2: (1, 0, False)}
