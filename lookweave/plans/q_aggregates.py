"""Quality, evaluation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import evaluation, quality
from ..session import shared_folder
from ..sources import tables
from .bindings import table, view
from .oracle import add_view, quote, sql_in, sql_list
from .registry import query

add_view("gate_v", """
SELECT d.*, t.min_area, t.min_fill, t.min_confidence, CASE WHEN d.area < t.min_area THEN 'area' WHEN d.fill < t.min_fill THEN 'fill' WHEN d.confidence < t.min_confidence THEN 'confidence' ELSE 'pass' END AS gate
FROM det_v d JOIN thr_v t ON t.model = d.model AND t.category = d.category""")


@query("gate_funnel", """
SELECT model, category, count(*) FILTER (WHERE gate = 'pass') AS passed, count(*) FILTER (WHERE gate = 'area') AS area, count(*) FILTER (WHERE gate = 'fill') AS fill,
  count(*) FILTER (WHERE gate = 'confidence') AS confidence, round(avg(confidence), 6) AS mean_confidence FROM gate_v GROUP BY 1, 2""")
def gate_funnel(spark, sf):
    rows = quality.funnel(view(spark, sf, "det_v").withColumn("confidence_value", F.col("confidence")))
    return rows.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("gate_funnel_fixed_fill", """
SELECT model, category, count(*) FILTER (WHERE area >= min_area AND fill >= 0.28 AND confidence >= min_confidence) AS passed,
  count(*) FILTER (WHERE area >= min_area AND fill < 0.28) AS fill FROM gate_v GROUP BY 1, 2""")
def gate_funnel_fixed_fill(spark, sf):
    rows = quality.funnel(view(spark, sf, "det_v").withColumn("confidence_value", F.col("confidence")), fixed_fill=0.28)
    return rows.select("model", "category", "passed", "fill")


@query("detection_gate", """
SELECT photo, line, part, gate = 'pass' AS accepted, CASE gate WHEN 'area' THEN concat('면적 ', printf('%.2f', round_even(area * 100, 2)), '% < 기준 ', printf('%.2f', round_even(min_area * 100, 2)), '%')
  WHEN 'fill' THEN concat('채움 ', printf('%d', CAST(round_even(fill * 100, 0) AS BIGINT)), '% < 기준 ', printf('%d', CAST(round_even(min_fill * 100, 0) AS BIGINT)), '%')
  WHEN 'confidence' THEN concat('확신도 ', printf('%.2f', round_even(confidence, 2)), ' < 기준 ', printf('%.2f', min_confidence)) ELSE '' END AS reason FROM gate_v""")
def detection_gate(spark, sf):
    rows = quality.with_thresholds(view(spark, sf, "det_v"))
    return rows.select("photo", "line", "part", (quality.gate() == "pass").alias("accepted"), quality.reject_reason().alias("reason"))


@query("detection_rates", f"""
SELECT model, category, CAST(list_position({sql_list(dims.CATEGORIES)}, category) AS BIGINT) AS place, passed, round(passed / (SELECT count(*) FROM orders), 9) AS rate, round(mean_confidence, 6) AS mean_confidence
FROM (SELECT model, category, count(*) FILTER (WHERE gate = 'pass') AS passed, avg(confidence) AS mean_confidence FROM gate_v GROUP BY 1, 2)""")
def detection_rates(spark, sf):
    rows = quality.detection_rates(view(spark, sf, "det_v"), table(spark, sf, "orders"))
    return rows.withColumns({"rate": F.round("rate", 9), "mean_confidence": F.round("mean_confidence", 6)})


@query("run_stats", """
SELECT event_type AS model, count(*) AS inputs, count(*) FILTER (WHERE value > 100) AS failures, round(avg(CASE WHEN value <= 100 THEN value END), 6) AS mean_seconds FROM events GROUP BY 1""")
def run_stats(spark, sf):
    """Runs over 100 seconds failed: counted apart and left out of the mean."""
    runs = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.when(F.col("value") <= 100, F.col("value")).alias("seconds"))
    return runs.groupBy("model").agg(F.count("*").alias("inputs"), F.count_if(F.col("seconds").isNull()).alias("failures"),
                                     F.round(F.avg("seconds"), 6).alias("mean_seconds"))


add_view("case_v", """
SELECT *, want_n = hit AND extra = 0 AND merged = 0 AS items_ok, CASE WHEN want_n = 0 THEN 1.0 ELSE round(hit / want_n, 3) END AS item_recall FROM (
SELECT v.*, len(list_distinct(want)) AS want_n, len(list_intersect(want, have)) AS hit, CASE WHEN artifacts = 3 THEN 1 ELSE 0 END AS extra, CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS merged FROM (
  SELECT v.*, CASE WHEN id % 8 = 0 THEN [] ELSE ['top', 'bag', CASE WHEN artifacts > 1 THEN 'shoes' ELSE 'top' END] END AS want, CASE WHEN layering_ok THEN ['top', 'bag', 'shoes'] ELSE ['bag', 'bag', 'hat'] END AS have FROM verdict_v v) v)""")


def judged(spark, sf):
    c, text = F.col, lambda *v: F.array(*[F.lit(x) for x in v])
    none = F.array().cast("array<string>")
    rows = view(spark, sf, "verdict_v").withColumns({
        "want": F.when(c("id") % 8 == 0, none).otherwise(F.array(F.lit("top"), F.lit("bag"), F.when(c("artifacts") > 1, "shoes").otherwise("top"))),
        "have": F.when(c("layering_ok"), text("top", "bag", "shoes")).otherwise(text("bag", "bag", "hat")),
        "extra": F.when(c("artifacts") == 3, text("scarf")), "merged": F.when(c("id") % 9 == 0, text("top+bag")).otherwise(none)})
    return evaluation.case_scores(rows, "want", "have", "extra", "merged")


@query("case_scores", "SELECT id, run, items_ok, round(item_recall, 3) AS item_recall FROM case_v")
def case_scores(spark, sf):
    return judged(spark, sf).select("id", "run", "items_ok", F.round("item_recall", 3).alias("item_recall"))


_SUMMARY = """SELECT run, count(*) AS cases, round(avg(CAST(layering_ok AS INT)), 3) AS layering_accuracy, round(avg(CAST(items_ok AS INT)), 3) AS item_accuracy, round(avg(item_recall), 3) AS item_recall,
  round(avg(CAST(accessories_ok AS INT)), 3) AS accessory_accuracy, round(avg(CAST(identity_ok AS INT)), 3) AS identity_preservation, round(avg(artifacts), 2) AS mean_artifacts, round(median(seconds), 1) AS median_seconds FROM case_v GROUP BY run"""
_METRICS = ["layering_accuracy", "item_accuracy", "item_recall", "accessory_accuracy", "identity_preservation", "mean_artifacts", "median_seconds"]


@query("eval_summary", f"SELECT run, cases, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM ({_SUMMARY})")
def eval_summary(spark, sf):
    return evaluation.summarize(judged(spark, sf), "run").select("run", "cases", *[F.round(m, 6).alias(m) for m in _METRICS])


@query("eval_compare", f"""
WITH s AS ({_SUMMARY}), m AS (SELECT run, 'cases' AS metric, CAST(cases AS DOUBLE) AS v FROM s {' '.join(f"UNION ALL SELECT run, '{m}', {m} FROM s" for m in _METRICS)})
SELECT b.metric, round(b.v, 6) AS "before", round(a.v, 6) AS "after", round(a.v - b.v, 6) AS delta FROM m b JOIN m a ON a.metric = b.metric AND a.run = 'after' WHERE b.run = 'before'""")
def eval_compare(spark, sf):
    rows = evaluation.compare_runs(evaluation.summarize(judged(spark, sf), "run"), "run", "before", "after")
    return rows.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


_SEARCHES = (("b2_clothes", "street fashion", "https://pins.example.com/search?q=street"), ("b3_clothes", "office look", "https://pins.example.com/search?q=office"),
             ("b3_fashion", "date night", "https://pins.example.com/search?q=date"))


@query("ingest_report", f"""
WITH s(model, query, address) AS (VALUES {', '.join(f"({quote(m)}, {quote(q)}, {quote(a)})" for m, q, a in _SEARCHES)}),
r AS (SELECT model, photo, count(*) FILTER (WHERE gate = 'pass') AS accepted, count(*) AS detected FROM gate_v GROUP BY 1, 2)
SELECT r.photo, r.accepted, r.detected, s.query, s.address, s.model, CAST(count(*) OVER (PARTITION BY r.model) AS DOUBLE) AS photos,
  CAST(sum(accepted) OVER (PARTITION BY r.model) AS DOUBLE) AS all_accepted, true AS timed FROM r JOIN s ON s.model = r.model""")
def ingest_report(spark, sf):
    """Accepted and detected garments per photo, written as one run per search, read back with the runs' provenance."""
    rows = quality.with_thresholds(view(spark, sf, "det_v")).withColumn("gate", quality.gate())
    counts = rows.groupBy("model", "photo").agg(F.count_if(F.col("gate") == "pass").alias("accepted"), F.count("*").alias("detected"))
    root = shared_folder(spark, "report")
    for number, (model, search, address) in enumerate(_SEARCHES):
        tables.write_observed(counts.where(F.col("model") == model).drop("model"), root, f"run-{number}", search, address, model,
                              {"photos": F.count("*"), "accepted": F.coalesce(F.sum("accepted"), F.lit(0))})
    runs = tables.read_runs(spark, root).select("run_id", "query", "address", "model", F.col("measures")["photos"].alias("photos"), F.col("measures")["accepted"].alias("all_accepted"),
                                                (F.col("finished") >= F.col("started")).alias("timed"))
    return tables.read_report(spark, root, "photo long, accepted long, detected long").join(runs, ["run_id", "query"]).drop("run_id")


@query("detection_order", """
SELECT photo, line, part, accepted, area, row_number() OVER (PARTITION BY photo ORDER BY accepted DESC, area DESC, line, part, supp) AS place
FROM (SELECT *, gate = 'pass' AS accepted FROM gate_v)""")
def detection_order(spark, sf):
    """The detections of a photo, accepted ones first, larger ones first among either."""
    from ..operators.ranking import accepted_first

    rows = quality.with_thresholds(view(spark, sf, "det_v")).withColumn("accepted", quality.gate() == "pass")
    return accepted_first(rows, ["photo"], "accepted", "area", ["line", "part", "supp"]).select("photo", "line", "part", "accepted", "area", "place")


_REFINED = ["상의", "하의", "아우터", "신발"]


@query("refine_selection", f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY gate = 'pass' DESC, area DESC, line, part, supp) AS n, count(*) OVER (PARTITION BY photo) AS wanted FROM gate_v
  WHERE (gate = 'pass' OR photo % 3 = 0) AND (photo % 4 = 0 OR category IN {sql_in(_REFINED)}))
SELECT photo, line, part, gate = 'pass' AS accepted, category AS source_category, CASE WHEN photo % 5 = 4 THEN category WHEN category = '아우터' THEN '상의' WHEN photo % 5 = 3 AND category = '신발' THEN '액세서리' ELSE category END AS category,
  greatest(0, wanted - {dims.REFINE_LIMIT}) AS skipped FROM w WHERE n <= {dims.REFINE_LIMIT}""")
def refine_selection(spark, sf):
    """What the request of every photo asks to refine: wanted categories, rejected ones for some, the first four, with the request's category overrides."""
    c = F.col
    rows = quality.with_thresholds(view(spark, sf, "det_v")).withColumn("accepted", quality.gate() == "pass")
    text = lambda *pairs: F.create_map(*[F.lit(x) for x in pairs])
    photo = c("photo")
    requests = rows.select("photo").distinct().select(
        "photo", (photo % 3 == 0).alias("include_rejected"), F.when(photo % 4 != 0, F.array(*[F.lit(x) for x in _REFINED])).alias("categories"),
        F.when(photo % 5 == 3, text("아우터", "상의", "신발", "액세서리")).when(photo % 5 != 4, text("아우터", "상의")).alias("overrides"))
    best = quality.refine_selection(rows, requests, ["line", "part", "supp"])
    return best.select("photo", "line", "part", "accepted", c("category").alias("source_category"), c("target").alias("category"), "skipped")


@query("repair_summary", """
SELECT photo, round(max(greatest(hole, occluded)), 6) AS worst, count(*) FILTER (WHERE occluded >= 0.02) AS occluded_items, count(*) FILTER (WHERE hole > 0.2) AS holed_items,
  count(*) FILTER (WHERE NOT failed) AS generated, count(*) FILTER (WHERE failed) AS failed, round(avg(growth), 6) AS mean_growth
FROM (SELECT photo, area * 10 AS hole, area * fill AS occluded, supp % 11 = 0 AS failed, CASE WHEN fill > 0 THEN (fill * 1.1 + area - fill) / fill ELSE 0.0 END AS growth FROM det_v) GROUP BY 1""")
def repair_summary(spark, sf):
    c = F.col
    rows = view(spark, sf, "det_v").select(
        "photo", (c("area") * 10).alias("hole"), (c("area") * c("fill")).alias("occluded"), (c("supp") % 11 == 0).alias("failed"),
        F.when(c("fill") > 0, (c("fill") * 1.1 + c("area") - c("fill")) / c("fill")).otherwise(0.0).alias("growth"))
    return rows.groupBy("photo").agg(
        F.round(F.max(F.greatest("hole", "occluded")), 6).alias("worst"), F.count_if(c("occluded") >= 0.02).alias("occluded_items"),
        F.count_if(c("hole") > 0.2).alias("holed_items"), F.count_if(~c("failed")).alias("generated"), F.count_if("failed").alias("failed"),
        F.round(F.avg("growth"), 6).alias("mean_growth"))
