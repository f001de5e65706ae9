"""Join-shaped queries: partners, sources, overlays, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.color import hex_color_name
from ..operators import catalog, partners
from ..operators.ranking import number_rows
from .bindings import table, view
from .oracle import add_view, quote, sql_in, sql_list, sql_values
from .registry import query

_SEEN = "NOT i.deleted AND (i.user_added OR i.gender IN ('all', {}))"
_PCAT = sql_values([[quote(a), str(i), quote(p)] for a, ps in {**dims.PARTNER_CATEGORIES, "-": dims.DEFAULT_PARTNER_CATEGORIES}.items() for i, p in enumerate(ps)], "a, slot, p").removesuffix(" AS t(a, slot, p)")
_CRANK = "CASE a.color " + " ".join(f"WHEN {quote(a)} THEN list_position({sql_list(ps)}, i.color)" for a, ps in dims.PARTNER_COLORS.items()) + \
    f" ELSE list_position({sql_list(dims.DEFAULT_PARTNER_COLORS)}, i.color) END"


@query("outfit_partners", f"""
WITH g AS (SELECT DISTINCT category, color FROM item_v),
s AS (SELECT w.wearer, a.category, a.color, d.slot, i.id, i.category AS pc, 50 + coalesce(24 - ({_CRANK} - 1) * 3, 0) + CASE WHEN a.color = '화이트' AND i.category = '하의' AND contains(i.name, '데님') THEN 22 ELSE 0 END
    + CASE WHEN a.color = '화이트' AND i.category = '신발' AND i.color = '화이트' THEN 20 ELSE 0 END + least(i.worn, 10) / 2.0 + (i.id * 4) % 9 AS score
  FROM g a JOIN {_PCAT} AS d(a, slot, p) ON d.a = CASE WHEN a.category IN {sql_in(list(dims.PARTNER_CATEGORIES))} THEN a.category ELSE '-' END JOIN item_v i ON i.category = d.p JOIN (VALUES ('women'), ('men')) AS w(wearer) ON {_SEEN.format('w.wearer')}),
r AS (SELECT *, row_number() OVER (PARTITION BY wearer, category, color, slot ORDER BY score DESC, id) AS n, count(*) OVER (PARTITION BY wearer, category, color, slot) AS pool FROM s)
SELECT r.wearer, i.id AS anchor, r.slot, r.pc AS partner_category, r.id AS partner, CAST(r.score AS DOUBLE) AS score, 93 AS shown
FROM item_v i JOIN r ON r.category = i.category AND r.color = i.color WHERE r.n = 1 % greatest(1, least(r.pool, 4)) + 1""")
def outfit_partners(spark, sf):
    """Partners of every item among what women and what men see."""
    return partners.outfit_partners(view(spark, sf, "item_v"), ["women", "men"], variation=1)


@query("partner_score", f"""
SELECT i.id, CAST(50 + coalesce(24 - (list_position({sql_list(dims.PARTNER_COLORS['화이트'])}, i.color) - 1) * 3, 0) + CASE WHEN i.category = '하의' AND contains(i.name, '데님') THEN 22 ELSE 0 END
  + CASE WHEN i.category = '신발' AND i.color = '화이트' THEN 20 ELSE 0 END + least(i.worn, 10) / 2.0 + (i.id * 3) % 9 AS DOUBLE) AS score FROM item_v i""")
def partner_score(spark, sf):
    """Partner score of every item next to a white top."""
    c = F.col
    _, colors = partners.partner_dims(spark)
    ranks = colors.where(c("ranked_for") == "화이트").select("color", "color_rank")
    items = view(spark, sf, "item_v").join(ranks, "color", "left")
    pair = partners.pair_bonus(F.lit("상의"), F.lit("화이트"), c("category"), c("color"), F.contains("name", F.lit(partners.DENIM)), c("color_rank"))
    return items.select("id", (pair + partners.item_bonus(0)).alias("score"))


def _trend_sql() -> str:
    rows = sql_values([[quote(t), str(i), quote(cat), sql_list(cols), quote(word) if word else "NULL"]
                       for t, reqs in dims.TRENDS.items() for i, (cat, cols, word) in enumerate(reqs)], "trend, req, category, colors, keyword")
    ctes = [f"s AS MATERIALIZED (SELECT t.trend, t.req, i.id, list_contains(t.colors, i.color) OR contains(i.name, coalesce(t.keyword, '∅')) AS fulfils, "
            "CASE WHEN list_contains(t.colors, i.color) THEN 40 - (list_position(t.colors, i.color) - 1) * 6 ELSE 0 END + CASE WHEN contains(i.name, coalesce(t.keyword, '∅')) THEN 35 ELSE 0 END "
            f"+ CASE WHEN i.user_added THEN 8 ELSE 0 END + least(i.worn, 12) / 3.0::DOUBLE + (i.id * (t.req + 3)) % 7 AS score FROM {rows} JOIN item_v i ON i.category = t.category WHERE {_SEEN.format("split_part(t.trend, '-', 1)")})"]
    used = "SELECT NULL AS trend, NULL AS id WHERE false"
    for req in range(4):
        ctes.append(f"p{req} AS MATERIALIZED (SELECT trend, req, id, score, fulfils FROM (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY score DESC, id) AS n, "
                    f"count(*) OVER (PARTITION BY trend) AS pool FROM s WHERE req = {req} AND (trend, id) NOT IN ({used})) WHERE n = 1 % greatest(1, least(pool, 3)) + 1)")
        used = " UNION ALL ".join(f"SELECT trend, id FROM p{k}" for k in range(req + 1))
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(4))
    return ("WITH " + ", ".join(ctes) + ", f AS (SELECT *, count(*) FILTER (WHERE fulfils) OVER (PARTITION BY trend) AS fulfilled FROM (" + every + ")) "
            "SELECT trend, req, id, round(score, 6) AS score, fulfils, fulfilled, 86 + least(10, fulfilled * 3) AS trend_score FROM f")


@query("trend_match", _trend_sql())
def trend_match(spark, sf):
    picks = partners.trend_match(view(spark, sf, "item_v"), dims.TRENDS, variation=1)
    return picks.withColumn("score", F.round("score", 6))


@query("swap_candidates", f"""
WITH n AS (SELECT w.wearer, i.id, i.category, row_number() OVER (PARTITION BY w.wearer, i.category ORDER BY i.id) - 1 AS n, count(*) OVER (PARTITION BY w.wearer, i.category) AS size
  FROM item_v i JOIN (VALUES ('women'), ('men')) AS w(wearer) ON {_SEEN.format('w.wearer')}),
u AS (SELECT q.look, n.category, list_sort(list(DISTINCT n.n)) AS used FROM req_v q JOIN n ON n.id = q.part AND n.wearer = q.gender GROUP BY 1, 2),
d AS (SELECT q.look, q.gender, q.pos, q.category, coalesce(u.used, []) AS used, (q.look * 31 + q.pos * 17) % nullif(s.size - len(coalesce(u.used, [])), 0) AS draw
  FROM req_v q JOIN (SELECT DISTINCT wearer, category, size FROM n) s ON s.category = q.category AND s.wearer = q.gender LEFT JOIN u ON u.look = q.look AND u.category = q.category)
SELECT d.look, d.pos, n.id AS swap FROM (SELECT look, gender, pos, category, list_reduce(list_prepend(draw, used), lambda acc, v: CASE WHEN v <= acc THEN acc + 1 ELSE acc END) AS n FROM d) d
JOIN n ON n.category = d.category AND n.wearer = d.gender AND n.n = d.n""")
def swap_candidates(spark, sf):
    return partners.swap_candidates(view(spark, sf, "req_v"), view(spark, sf, "item_v"))


@query("strict_source_join", """
SELECT l_orderkey AS look, l_linenumber AS line, l_partkey AS part, coalesce(s_name, '') AS source, CASE WHEN s_name IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) ON s_suppkey = l_suppkey""")
def strict_source_join(spark, sf):
    """Rows with their source, and the rows whose source is not in the group as errors."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("look"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "l_suppkey")
    sources = table(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("source"))
    joined = rows.join(sources, "l_suppkey", "left")
    return joined.select("look", "line", "part", F.coalesce("source", F.lit("")).alias("source"), F.when(F.col("source").isNull(), "missing").otherwise("ok").alias("status"))


add_view("shade_v", """
SELECT s_suppkey AS id, CASE WHEN s_acctbal > 8000 THEN '멀티컬러' WHEN s_nationkey < 8 THEN '블랙' WHEN s_nationkey < 16 THEN '레드' ELSE '블루' END AS color FROM supplier WHERE s_nationkey < 22""")


@query("enrich_color", """
SELECT l_orderkey AS look, l_linenumber AS line, l_partkey AS part, coalesce(color, '멀티컬러') AS color FROM lineitem LEFT JOIN shade_v ON id = l_suppkey""")
def enrich_color(spark, sf):
    n = F.col("s_nationkey")
    code = F.when(F.col("s_acctbal") > 8000, "?").when(n < 8, "#101010").when(n < 16, "cc1010").otherwise("#3050D0")
    shades = table(spark, sf, "supplier").where(n < 22).select(F.col("s_suppkey").alias("l_suppkey"), hex_color_name(code).alias("shade"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("look"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "l_suppkey")
    return rows.join(shades, "l_suppkey", "left").select("look", "line", "part", F.coalesce("shade", F.lit(dims.MULTICOLOR)).alias("color"))


_FIXED = "(SELECT l_partkey AS number, CASE max(l_linenumber) % 3 WHEN 0 THEN '상의' WHEN 1 THEN '아우터' ELSE '하의' END AS fixed FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 GROUP BY 1)"
add_view("fixed_v", f"""
SELECT id, source_rank, coalesce(fixed, category) AS category, coalesce(fixed, category) <> category AS changed, color,
  CASE WHEN coalesce(fixed, category) = category THEN noun WHEN fixed = '아우터' THEN '재킷·가디건' ELSE fixed END AS subcategory, concat(color, ' ', coalesce(fixed, category), ' ', CASE WHEN id > 99 THEN CAST(id AS VARCHAR) ELSE lpad(CAST(id AS VARCHAR), 3, '0') END) AS name
FROM item_v LEFT JOIN {_FIXED} o ON number = id""")


def _corrected(spark, sf):
    """Reviewed categories joined on the number in the image file name."""
    c = F.col
    items = view(spark, sf, "item_v").withColumn("image", F.format_string("assets/lookbook/look-%d.jpg", c("id")))
    fixes = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity = 50").groupBy(c("l_partkey").alias("number")).agg(F.max("l_linenumber").alias("line"))
    fixes = fixes.select("number", F.when(c("line") % 3 == 0, "상의").when(c("line") % 3 == 1, "아우터").otherwise("하의").alias("fixed"))
    return catalog.apply_overrides(items, fixes, "noun")


@query("apply_overrides", "SELECT id, category, changed, subcategory, name FROM fixed_v")
def apply_overrides(spark, sf):
    return _corrected(spark, sf).select("id", "category", "changed", "subcategory", "name")


@query("correct_sources", """
WITH f AS (SELECT id AS rank, category, subcategory, color, name FROM fixed_v)
SELECT p.p_partkey AS source_id, p.p_partkey * 2 AS rank, coalesce(f.category, p.p_type) AS category, coalesce(f.subcategory, p.p_type) AS subcategory, coalesce(f.color, '') AS color,
  coalesce(f.name, p.p_name) AS name, CASE WHEN f.rank IS NULL THEN p.p_brand END AS brand, f.rank IS NOT NULL AS updated, (SELECT count(*) FROM fixed_v WHERE changed) AS changed_categories
FROM part p LEFT JOIN f ON f.rank = p.p_partkey * 2""")
def correct_sources(spark, sf):
    """Source records that get the corrected fields of the catalogue item of their rank, beside the number of changed categories."""
    c = F.col
    sources = table(spark, sf, "part").select(c("p_partkey").alias("source_id"), (c("p_partkey") * 2).alias("rank"), c("p_type").alias("category"), c("p_type").alias("subcategory"),
                                              F.lit("").alias("color"), c("p_name").alias("name"), c("p_brand").alias("brand"))
    fixed = _corrected(spark, sf).withColumn("rank", c("id"))
    return catalog.correct_sources(sources, fixed)


@query("overlay_merge", """
WITH s AS (SELECT user_id + 0 AS id, arg_max(event_type, (ts, event_id)) AS color, arg_max(CASE WHEN event_type = 'view' THEN NULL ELSE '상의' END, (ts, event_id)) AS category FROM events GROUP BY 1),
d AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error' AND value > 200)
SELECT coalesce(s.id, i.id) AS id, coalesce(s.category, i.category) AS category, coalesce(s.color, i.color) AS color, coalesce(i.name, '직접 올린 옷') AS name
FROM item_v i FULL JOIN s ON s.id = i.id WHERE coalesce(s.id, i.id) NOT IN (SELECT id FROM d)""".replace(
    "arg_max(CASE WHEN event_type = 'view' THEN NULL ELSE '상의' END, (ts, event_id))", "nullif(arg_max(CASE WHEN event_type = 'view' THEN '' ELSE '상의' END, (ts, event_id)), '')"))
def overlay_merge(spark, sf):
    events = table(spark, sf, "events")
    latest = F.max_by("event_type", F.struct("ts", "event_id"))
    stored = events.groupBy(F.col("user_id").alias("id")).agg(latest.alias("color")).withColumn("category", F.when(F.col("color") != "view", "상의"))
    gone = events.where("event_type = 'error' AND value > 200").select(F.col("user_id").alias("id")).distinct()
    base = view(spark, sf, "item_v").select("id", "category", "color", "name")
    merged = catalog.overlay_merge(base, stored, gone, "id", ["category", "color"])
    return merged.withColumn("name", F.coalesce("name", F.lit("직접 올린 옷")))


@query("valid_refs", "SELECT id, look FROM fb_v WHERE look IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def valid_refs(spark, sf):
    alive = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("look"))
    return view(spark, sf, "fb_v").select("id", "look").join(alive, "look", "left_semi")


@query("backfill_reference", """
WITH r AS (SELECT look, category, arg_max(concat('crop/', part), pos) AS image FROM req_v WHERE confidence > 0.7 GROUP BY 1, 2)
SELECT q.look, q.pos, coalesce(r.image, '') AS reference_image, CASE WHEN r.image IS NULL THEN coalesce(q.vec, -1) ELSE -1 END AS vec FROM req_v q LEFT JOIN r ON r.look = q.look AND r.category = q.category""")
def backfill_reference(spark, sf):
    """Last refined crop per category becomes the pieces' reference and clears their vector."""
    pieces = view(spark, sf, "req_v")
    refined = pieces.where("confidence > 0.7").select("look", "category", "pos", F.concat(F.lit("crop/"), F.col("part").cast("string")).alias("image"))
    done = catalog.backfill(pieces.select("look", "pos", "category", "vec"), refined, ["look", "category"], "pos", "image", "vec")
    return done.select("look", "pos", F.coalesce("image", F.lit("")).alias("reference_image"), F.coalesce("vec", F.lit(-1)).alias("vec"))


_MOODS = sql_values([[quote(g), str(i), quote(m)] for g, ms in dims.LOOK_MOODS.items() for i, m in enumerate(ms)], "gender, n, mood")


@query("template_assign", f"""
SELECT l.id AS look, l.person, t.mood FROM (SELECT *, (row_number() OVER (PARTITION BY person, gender ORDER BY id) - 1) % 5 AS k FROM look_v) l
JOIN (SELECT * FROM {_MOODS}) t ON t.gender = l.gender AND t.n = l.k""")
def template_assign(spark, sf):
    """The k-th look of a creator gets template k of the gender, round robin."""
    rows = [(g, i, m) for g, ms in dims.LOOK_MOODS.items() for i, m in enumerate(ms)]
    moods = F.broadcast(spark.createDataFrame(rows, "gender string, k long, mood string"))  # ten constant rows
    looks = view(spark, sf, "look_v").select(F.col("id").alias("look"), "person", "gender")
    numbered = number_rows(looks, [F.col("look")], "n", ["person", "gender"]).withColumn("k", (F.col("n") - 1) % 5)
    return numbered.join(moods, ["gender", "k"]).select("look", "person", "mood")


@query("curated_people", """
SELECT id, gender FROM person_v WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)""")
def curated_people(spark, sf):
    approved = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return view(spark, sf, "person_v").select("id", "gender").join(approved, "id", "left_semi")


_THR = sql_values([[quote(c), *[f"{v}::DOUBLE" for v in t]] for c, t in dims.QUALITY.items()], "category, min_area, min_fill, min_confidence")
_OVR = sql_values([[quote(m), quote(c), *["NULL::DOUBLE" if v is None else f"{v}::DOUBLE" for v in t]] for (m, c), t in dims.QUALITY_OVERRIDES.items()], "model, category, min_area, min_fill, min_confidence")
add_view("thr_v", f"""
SELECT d.model, d.category, d.detections, coalesce(o.min_area, t.min_area) AS min_area, coalesce(o.min_fill, t.min_fill) AS min_fill, coalesce(o.min_confidence, t.min_confidence) AS min_confidence
FROM (SELECT model, category, count(*) AS detections FROM det_v GROUP BY 1, 2) d JOIN (SELECT * FROM {_THR}) t ON t.category = d.category
LEFT JOIN (SELECT * FROM {_OVR}) o ON o.model = d.model AND o.category = d.category""")


@query("resolve_thresholds", "SELECT * FROM thr_v")
def resolve_thresholds(spark, sf):
    from ..operators.quality import with_thresholds

    groups = view(spark, sf, "det_v").groupBy("model", "category").agg(F.count("*").alias("detections"))
    return with_thresholds(groups)
