"""Look matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import body
from ..functions.color import color_similarity
from ..functions.similarity import set_similarity
from ..functions.text import known_colors, tokens
from ..functions.rules import canonical_form, seed_attributes
from ..operators import matching
from ..operators.vectors import prototype_cosines, prototypes
from .bindings import table, view, words
from .oracle import add_view, quote, sql_color_similarity, sql_in, sql_palette, sql_rules, sql_set_similarity, sql_tokens
from .registry import query

S = dims.SIM

add_view("proto_v", """
SELECT label, list(m ORDER BY k) AS vector FROM (
  SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY label, k)
GROUP BY label""")
add_view("cos_v", """
SELECT a.label AS vec, b.label AS r_vec, round(list_dot_product(a.vector, b.vector) /
  greatest(1e-12, sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 9) AS cosine
FROM proto_v a, proto_v b""")
_form = lambda v: sql_rules(f"concat({v}, ' ', category)", dims.FORM_RULES, "'unknown'")
_own = lambda a, seed=None: f"CASE WHEN n.id IS NOT NULL THEN n.{a} ELSE {seed or 's.' + a} END"
_ITEM_PARTS = f"""SELECT *, {sql_palette("concat_ws(' ', color, name, primary_color, secondary_colors)")} AS palette,
  {sql_tokens("concat_ws(' ', material, texture, name)")} AS m_tok, {sql_tokens("concat_ws(' ', fit, silhouette, name)")} AS f_tok,
  {sql_tokens("concat_ws(' ', subcategory, pattern, finish, construction, name)")} AS d_tok,
  {_form('sleeve_length')} AS sleeve_form, {_form('length')} AS length_form, concat_ws(' ', subcategory, neckline, construction) AS kind_text"""
add_view("own_v", f"""
{_ITEM_PARTS} FROM (SELECT i.*, {', '.join(f"{_own(a)} AS {a}" for a in matching.ANALYSIS if a not in ('construction', 'primary_color', 'secondary_colors'))},
  {_own('construction', "array_to_string(s.construction, ' ')")} AS construction, {_own('primary_color', 'i.color')} AS primary_color, {_own('secondary_colors', "''")} AS secondary_colors
  FROM item_v i JOIN attr_v s ON s.category = i.category AND s.name = i.name AND s.color = i.color LEFT JOIN ana_v n ON n.id = i.id)""")
add_view("itx_v", """
SELECT row_number() OVER () AS tid, * FROM (SELECT DISTINCT category, palette, list_sort(list_distinct(m_tok)) AS m_tok, list_sort(list_distinct(f_tok)) AS f_tok,
  list_sort(list_distinct(d_tok)) AS d_tok, sleeve_form, length_form, kind_text FROM own_v)""")
add_view("rtx_v", f"""
SELECT row_number() OVER () AS rid, *, {sql_palette('colors')} AS palette, {sql_tokens('materials')} AS m_tok, {sql_tokens('fits')} AS f_tok, {sql_tokens('details')} AS d_tok,
  {_form('sleeve_length')} AS sleeve_form, {_form('length')} AS length_form, concat_ws(' ', subcategory, neckline, details) AS kind_text
FROM (SELECT DISTINCT category, colors, materials, fits, details, sleeve_length, length, subcategory, neckline FROM need_v)""")
_agree = "(i.{0} = 'unknown' OR r.{0} = 'unknown' OR i.{0} = r.{0})"
_lacks = "(regexp_matches(lower(r.kind_text), {0}) AND NOT regexp_matches(lower(i.kind_text), {0}))"
_TEXT_SCORE = f"""i.tid, r.rid, {sql_color_similarity('i.palette', 'r.palette')} AS color_sim,
  {sql_set_similarity('i.m_tok', 'r.m_tok', dims.MATERIAL_GROUPS)} AS material_sim,
  {sql_set_similarity('i.f_tok', 'r.f_tok', dims.FIT_GROUPS)} AS fit_sim, {sql_set_similarity('i.d_tok', 'r.d_tok')} AS detail_sim,
  NOT ({_agree.format('sleeve_form')} AND {_agree.format('length_form')}) OR {_lacks.format(quote(dims.POLO_PATTERN))}
    OR {_lacks.format(quote(dims.TEE_PATTERN))} AS conflict"""
add_view("score_v", f"SELECT {_TEXT_SCORE}, i.category = r.category AS same FROM itx_v i JOIN rtx_v r ON i.category = r.category")
_SAME_NEED = " AND ".join(f"r.{x} = q.{x}" for x in ["category", *matching.NEEDS])
add_view("rg_v", f"""
SELECT q.look, q.pos, q.vec, q.gender, q.category, r.rid FROM need_v q JOIN rtx_v r ON {_SAME_NEED}""")
add_view("ig_v", """
SELECT i.id, i.vec, i.gender, i.user_added, coalesce(i.source_rank, 999) AS source_rank, t.tid, i.deleted FROM own_v i
JOIN itx_v t ON t.category = i.category AND t.palette = i.palette AND t.m_tok = list_sort(list_distinct(i.m_tok)) AND t.f_tok = list_sort(list_distinct(i.f_tok))
  AND t.d_tok = list_sort(list_distinct(i.d_tok)) AND t.sleeve_form = i.sleeve_form AND t.length_form = i.length_form AND t.kind_text = i.kind_text""")
add_view("xscore_v", f"""
SELECT {_TEXT_SCORE}, false AS same FROM (SELECT DISTINCT u.tid, g.rid FROM ig_v u JOIN cos_v c ON NOT u.deleted AND c.vec = u.vec AND (c.cosine + 1) / 2 >= 0.95
  JOIN (SELECT DISTINCT vec, rid FROM rg_v) g ON g.vec = c.r_vec WHERE u.user_added) k
JOIN itx_v i ON i.tid = k.tid JOIN rtx_v r ON r.rid = k.rid WHERE i.category <> r.category""")
add_view("pair_v", """
SELECT *, 0.03 + color_sim * 0.49 + material_sim * 0.11 + fit_sim * 0.10 + detail_sim * 0.07 + visual * 0.20 AS raw FROM (
SELECT g.rid, g.vec AS r_vec, g.gender AS r_gender, i.id AS item, i.user_added, i.source_rank, s.same, s.conflict, s.color_sim, s.material_sim,
  s.fit_sim, s.detail_sim, c.cosine, CASE WHEN c.cosine IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0, least(1.0, (c.cosine + 1) / 2)) END AS visual
FROM (SELECT DISTINCT rid, vec, gender FROM rg_v) g
JOIN (SELECT * FROM score_v UNION ALL SELECT * FROM xscore_v) s ON s.rid = g.rid
JOIN ig_v i ON i.tid = s.tid AND NOT i.deleted AND (i.user_added OR i.gender = 'all' OR i.gender = g.gender)
LEFT JOIN cos_v c ON c.vec = i.vec AND c.r_vec = g.vec
WHERE s.same OR (i.user_added AND (c.cosine + 1) / 2 >= 0.95))""")
add_view("cand_v", """
SELECT look, pos, category, item, similarity, color_sim, visual, direct, user_added, rank FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY look, pos ORDER BY similarity DESC, color_sim DESC, user_added DESC, source_rank, item) AS INT) AS rank FROM (
SELECT g.look, g.pos, g.category, p.item, p.user_added, p.source_rank, p.color_sim, p.visual, f.look IS NOT NULL AS direct,
  round(least(1.0, CASE WHEN f.look IS NOT NULL AND p.same THEN greatest(p.raw, 0.985) WHEN p.cosine IS NOT NULL AND p.visual >= 0.92 AND p.same
    THEN greatest(p.raw, 0.92) ELSE p.raw END), 9) AS similarity, p.conflict, p.cosine
FROM rg_v g JOIN pair_v p ON p.rid = g.rid AND p.r_gender = g.gender AND p.r_vec IS NOT DISTINCT FROM g.vec
LEFT JOIN ref_v f ON f.look = g.look AND f.item = p.item)
WHERE (NOT conflict OR direct OR (cosine IS NOT NULL AND visual >= 0.92))
  AND (direct OR similarity >= 0.44 OR visual >= 0.62 OR (user_added AND similarity >= 0.40)))
WHERE rank <= 8""")


def cosines(spark, sf):
    return prototype_cosines(prototypes(table(spark, sf, "embeddings"), "label"), "label")


def _items(spark, sf):
    return matching.with_analysis(view(spark, sf, "item_v"), view(spark, sf, "ana_v"))


def _sides(spark, sf):
    return _items(spark, sf), view(spark, sf, "need_v"), cosines(spark, sf), view(spark, sf, "ref_v")


@query("candidate_topk", "SELECT look, pos, category, item, similarity, round(color_sim, 9) AS color_sim, round(visual, 9) AS visual, "
       "direct, user_added, rank FROM cand_v")
def candidate_topk(spark, sf):
    return matching.candidates(*_sides(spark, sf))


# ---- assignment and everything built on it -----------------------------------------------
def _staged_assignment(rounds: int = 20) -> None:
    """SQL twin of the assignment: one staged expression per position, best state per used set."""
    add_view("cont_v", """
SELECT c.look, c.pos, c.item, CAST(round(c.similarity * 1e9) AS BIGINT) AS weight, c.rank FROM cand_v c
JOIN (SELECT look, pos FROM (SELECT look, pos, count(*) OVER (PARTITION BY look, item) AS n FROM cand_v) GROUP BY look, pos HAVING max(n) > 1) k
  ON k.look = c.look AND k.pos = c.pos""")
    add_view("slot_v", """
SELECT look, pos, CAST(row_number() OVER (PARTITION BY look ORDER BY size, pos) AS INT) AS place, size FROM (
  SELECT look, pos, count(*) AS size FROM cont_v GROUP BY look, pos)""")
    add_view("move_v", """
SELECT c.look, s.place, s.pos, CAST(c.rank - 1 AS INT) AS i, c.item, c.weight,
  c.item * 100 + max(s.place) OVER (PARTITION BY c.look, c.item) AS token
FROM cont_v c JOIN slot_v s ON s.look = c.look AND s.pos = c.pos
UNION ALL SELECT look, place, pos, CAST(size AS INT), NULL, NULL, NULL FROM slot_v""")
    add_view("step0_v", "SELECT DISTINCT look, CAST([] AS BIGINT[]) AS used, 0 AS n, CAST(0 AS BIGINT) AS total, "
                        "CAST([] AS INT[]) AS path, CAST([] AS BIGINT[]) AS picks FROM slot_v")
    for at in range(1, rounds + 1):
        add_view(f"step{at}_v", f"""
SELECT look, used, n, total, path, picks FROM (
SELECT *, row_number() OVER (PARTITION BY look, used ORDER BY n DESC, total DESC, path) AS best FROM (
SELECT s.look, list_sort(list_filter(CASE WHEN m.item IS NULL THEN s.used ELSE list_append(s.used, m.token) END, lambda t: t % 100 > {at})) AS used,
  s.n + CASE WHEN m.item IS NULL THEN 0 ELSE 1 END AS n, s.total + coalesce(m.weight, 0) AS total, list_append(s.path, m.i) AS path,
  CASE WHEN m.item IS NULL THEN s.picks ELSE list_append(s.picks, m.pos * 1000000000000 + m.item) END AS picks
FROM step{at - 1}_v s JOIN move_v m ON m.look = s.look AND m.place = {at}
WHERE m.item IS NULL OR NOT list_contains(s.used, m.token))) WHERE best = 1""")
    last = " UNION ALL ".join(
        f"SELECT s.look, s.picks FROM step{at}_v s JOIN (SELECT look, max(place) AS p FROM slot_v GROUP BY look) z ON z.look = s.look AND z.p = {at}"
        for at in range(1, rounds + 1))
    add_view("assign_v", f"""
SELECT c.* FROM cand_v c JOIN (
  SELECT look, CAST(p // 1000000000000 AS INT) AS pos, p % 1000000000000 AS item FROM (SELECT look, unnest(picks) AS p FROM ({last}))
  UNION ALL SELECT look, pos, item FROM cand_v WHERE rank = 1 AND (look, pos) NOT IN (SELECT look, pos FROM cont_v)) k
  ON k.look = c.look AND k.pos = c.pos AND k.item = c.item""")


_staged_assignment()
_list = lambda x: f"array_to_string(list_sort(list_filter(list_transform(string_split({x}, ','), lambda v: lower(trim(v))), lambda v: v <> '')), ',')"
add_view("sig_v", f"""
SELECT look, pos, category, concat_ws('|', category, {', '.join(_list(x) for x in ('colors', 'details', 'subcategory', 'sleeve_length', 'length'))}) AS signature FROM need_v""")
add_view("kept_v", """
SELECT look, signature, pos, item, category, similarity, color_sim, visual FROM (
SELECT a.*, s.signature, row_number() OVER (PARTITION BY a.look, s.signature ORDER BY a.similarity DESC, a.pos) AS best
FROM assign_v a JOIN sig_v s ON s.look = a.look AND s.pos = a.pos JOIN look_v l ON l.id = a.look AND l.analysis_ready) WHERE best = 1""")
add_view("summary_v", f"""
SELECT look, CASE WHEN analyzed THEN fulfilled ELSE 0 END AS fulfilled, CASE WHEN analyzed THEN total ELSE 0 END AS total, CASE WHEN analyzed THEN similarity ELSE 0 END AS similarity,
  CASE WHEN analyzed THEN color_similarity ELSE 0 END AS color_similarity, CASE WHEN analyzed THEN hits ELSE 0 END AS weather_hits, analyzed FROM (
  SELECT l.id AS look, l.analysis_ready AND t.total IS NOT NULL AS analyzed, coalesce(k.fulfilled, 0) AS fulfilled, t.total, coalesce(k.similarity, 0) AS similarity,
    coalesce(k.color_similarity, 0) AS color_similarity, len(list_filter(string_split(l.weather, ','), lambda w: w IN {sql_in(dims.TODAY_WEATHER)})) AS hits
  FROM look_v l LEFT JOIN (SELECT look, count(DISTINCT signature) AS total FROM sig_v GROUP BY look) t ON t.look = l.id
  LEFT JOIN (SELECT look, count(*) AS fulfilled, avg(similarity) AS similarity, avg(color_sim) AS color_similarity FROM kept_v GROUP BY look) k ON k.look = l.id)""")
add_view("usable_v", f"""
SELECT look, bool_or(category IN {sql_in(dims.APPAREL)} AND (similarity >= 0.44 OR visual >= 0.62)) AS usable FROM kept_v GROUP BY look""")
_h, _w = "coalesce(nullif(p.height, 0), 170)", "coalesce(nullif(p.weight, 0), 65)"
_bmi = f"({_w} / (({_h} / 100) * ({_h} / 100)))"
_dist = lambda x, lo, hi: f"greatest({lo} - {x}, {x} - {hi}, 0)"
add_view("body_v", f"""
SELECT l.id AS look, l.person, CAST(CASE WHEN p.photo THEN CASE WHEN hit THEN 96 ELSE 72 END ELSE greatest(20, floor(90
  - (least(45, {_dist(_h, 'l.height_lo', 'l.height_hi')} * 2.2) + least(35, {_dist(_bmi, 'l.bmi_lo', 'l.bmi_hi')} * 7))
  + CASE WHEN hit THEN 10 ELSE 0 END + 0.5)) END AS BIGINT) AS body_score
FROM (SELECT l.*, list_contains(string_split(l.shapes, ','), p.shape) AS hit FROM look_v l JOIN person_v p ON p.id = l.person) l
JOIN person_v p ON p.id = l.person""")

def assigned(spark, sf):
    return matching.assign_lists(matching.candidate_lists(*_sides(spark, sf)))


def _analysed(spark, sf):
    return view(spark, sf, "look_v").where("analysis_ready").select(F.col("id").alias("look"))


def _sums(spark, sf):
    """Sums of the matches of the looks that are analysed, and the number of signatures of all looks."""
    kept, totals = matching.kept_matches(matching.candidate_lists(*_sides(spark, sf)))
    return matching.look_sums(kept).join(_analysed(spark, sf), "look", "left_semi"), totals


@query("outfit_assignment", "SELECT look, pos, category, item, similarity, rank FROM assign_v")
def outfit_assignment(spark, sf):
    return assigned(spark, sf).select("look", "pos", "category", "item", "similarity", "rank")


@query("collapse_duplicates", "SELECT look, signature, pos, item, similarity FROM kept_v")
def collapse_duplicates(spark, sf):
    kept, _ = matching.kept_matches(matching.candidate_lists(*_sides(spark, sf)))
    return kept.join(_analysed(spark, sf), "look", "left_semi").select("look", "signature", "pos", "item", "similarity")


@query("match_summary", """SELECT look, fulfilled, total, round(similarity, 6) AS similarity, round(color_similarity, 6) AS color_similarity, weather_hits,
  CAST(floor(least(98.0, round(similarity * 88 + weather_hits * 3, 6)) + 0.5) AS BIGINT) AS score, analyzed FROM summary_v""")
def match_summary(spark, sf):
    return matching.summarized(*_sums(spark, sf), view(spark, sf, "look_v"))


@query("usable_looks", "SELECT look, usable FROM usable_v")
def usable_looks(spark, sf):
    return _sums(spark, sf)[0].select("look", "usable")


def _body(spark, sf):
    looks, people = view(spark, sf, "look_v").withColumnRenamed("id", "look"), view(spark, sf, "person_v").withColumnRenamed("id", "person")
    c = F.col
    return looks.drop("gender").join(people, "person").select("look", "person", body.body_score(
        c("height"), c("weight"), c("shape"), words("shapes"), c("height_lo"), c("height_hi"), c("bmi_lo"), c("bmi_hi"), c("photo")).alias("body_score"))


@query("body_score", "SELECT look, person, body_score FROM body_v")
def body_score(spark, sf):
    return _body(spark, sf)


add_view("ranked_v", """
SELECT b.person, b.look, b.body_score, s.score, b.body_score + s.score AS total,
  CAST(row_number() OVER (PARTITION BY b.person ORDER BY b.body_score + s.score DESC, b.look) AS BIGINT) AS rank
FROM body_v b JOIN (SELECT look, CAST(floor(least(98.0, round(similarity * 88 + weather_hits * 3, 6)) + 0.5) AS BIGINT) AS score FROM summary_v) s ON s.look = b.look
JOIN usable_v u ON u.look = b.look AND u.usable JOIN look_v l ON l.id = b.look JOIN person_v p ON p.id = b.person AND p.gender = l.gender""")


def _rank_looks(spark, sf):
    from ..operators.ranking import number_rows

    sums, totals = _sums(spark, sf)
    sums = matching.materialize(sums)  # read twice
    looks, people = view(spark, sf, "look_v"), view(spark, sf, "person_v")
    summary = matching.summarized(sums, totals, looks).where("analyzed")
    good = sums.where("usable").select("look")
    own = looks.select(F.col("id").alias("look"), "person", "gender").join(people.select(F.col("id").alias("person"), "gender"), ["person", "gender"]).select("look")
    rows = _body(spark, sf).join(summary.select("look", "score"), "look").join(good, "look").join(own, "look", "left_semi")
    rows = rows.withColumn("total", F.col("body_score") + F.col("score"))
    return number_rows(rows, [F.desc("total"), F.col("look")], "rank", ["person"])


@query("rank_looks", "SELECT * FROM ranked_v")
def rank_looks(spark, sf):
    """Every person's usable looks of their gender by body plus match score."""
    return _rank_looks(spark, sf)


@query("selected_looks", """
WITH chosen AS (SELECT DISTINCT o_custkey AS person, o_orderkey AS look FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 4 <> 1)
SELECT person, look, false AS "default" FROM chosen
UNION ALL SELECT person, look, true FROM ranked_v WHERE rank <= 3 AND person NOT IN (SELECT person FROM chosen)""")
def selected_looks(spark, sf):
    """Chosen looks of every person, or the first three ranked ones of those who chose none."""
    chosen = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_custkey % 4 <> 1").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("look"))
    return matching.default_selection(_rank_looks(spark, sf), chosen)


@query("assemble_options", f"""
WITH ready AS (SELECT b.person, b.look, b.body_score + s.score AS total, b.body_score, u.look IS NOT NULL AS usable, l.price >= 450000 AS upload
  FROM body_v b JOIN look_v l ON l.id = b.look
  LEFT JOIN (SELECT look, CAST(floor(least(98.0, round(similarity * 88 + weather_hits * 3, 6)) + 0.5) AS BIGINT) AS score FROM summary_v) s ON s.look = b.look
  LEFT JOIN (SELECT look FROM usable_v WHERE usable) u ON u.look = b.look)
SELECT person, look, kind, slot FROM (SELECT person, look, kind, CAST(row_number() OVER (PARTITION BY person ORDER BY tier, value DESC, look) AS INT) AS slot FROM (
  SELECT person, look, 'upload' AS kind, 0 AS tier, 0 AS value FROM ready WHERE upload
  UNION ALL SELECT person, look, 'ready', 1, total FROM ready WHERE NOT upload AND usable
  UNION ALL SELECT person, look, 'pending', 2, body_score FROM ready WHERE NOT upload AND NOT usable)) WHERE slot <= {dims.OPTION_LIMIT}""")
def assemble_options(spark, sf):
    """Uploads, then ready looks, then pending looks, at most 18 slots per person."""
    from ..operators.ranking import top_k

    sums, totals = _sums(spark, sf)
    sums = matching.materialize(sums)  # read twice
    summary = matching.summarized(sums, totals, view(spark, sf, "look_v")).select("look", "score")
    good = sums.where("usable").select("look", F.lit(True).alias("usable"))
    looks = view(spark, sf, "look_v").select(F.col("id").alias("look"), (F.col("price") >= 450000).alias("upload"))
    rows = _body(spark, sf).join(looks, "look").join(summary, "look", "left").join(good, "look", "left")
    usable = F.coalesce("usable", F.lit(False))
    tiers = rows.withColumns({
        "tier": F.when(F.col("upload"), 0).when(usable, 1).otherwise(2),
        "value": F.when(F.col("upload"), 0).when(usable, F.col("body_score") + F.col("score")).otherwise(F.col("body_score"))})
    best = top_k(tiers, ["person"], [F.col("tier"), F.desc("value"), F.col("look")], dims.OPTION_LIMIT, "slot")
    kind = F.element_at(F.array(F.lit("upload"), F.lit("ready"), F.lit("pending")), F.col("tier") + 1)
    return best.select("person", "look", kind.alias("kind"), "slot")


# ---- pair scores and their parts ------------------------------------------------------------
@query("match_candidates", """
SELECT q.look, q.pos, coalesce(s.n, 0) AS same_category, coalesce(u.n, 0) AS other_uploads FROM req_v q
LEFT JOIN (SELECT g.gender AS g, i.category, count(*) AS n FROM item_v i, (VALUES ('men'), ('women')) g(gender)
  WHERE NOT i.deleted AND (i.user_added OR i.gender = 'all' OR i.gender = g.gender) GROUP BY 1, 2) s ON s.g = q.gender AND s.category = q.category
LEFT JOIN (SELECT c.category, count(*) AS n FROM item_v i JOIN (SELECT DISTINCT category FROM item_v) c ON c.category <> i.category
  WHERE NOT i.deleted AND i.user_added GROUP BY 1) u ON u.category = q.category""")
def match_candidates(spark, sf):
    """Eligible wardrobe items per requirement, counted per group instead of listing the pairs."""
    items = view(spark, sf, "item_v").where("NOT deleted")
    by = items.groupBy("category").agg(
        *[F.count_if(F.col("user_added") | F.col("gender").isin("all", g)).alias(g) for g in ("men", "women")],
        F.count_if("user_added").alias("uploads"))
    uploads = items.agg(F.count_if("user_added")).scalar()
    req = view(spark, sf, "req_v").select("look", "pos", "category", "gender")
    joined = req.join(by, "category", "left")
    return joined.select(
        "look", "pos", F.coalesce(F.when(F.col("gender") == "men", F.col("men")).otherwise(F.col("women")), F.lit(0)).alias("same_category"),
        (uploads - F.coalesce("uploads", F.lit(0))).alias("other_uploads"))


_VISUAL = "(CASE WHEN c.cosine IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0, least(1.0, (c.cosine + 1) / 2)) END)"
_FITS = f"""((i.category = r.category OR (c.cosine IS NOT NULL AND {_VISUAL} >= 0.95)) AND (NOT s.conflict OR f.look IS NOT NULL OR (c.cosine IS NOT NULL AND {_VISUAL} >= 0.92)))"""


@query("garment_similarity", f"""
SELECT look, pos, item, CASE WHEN fits THEN round(color_sim, 9) ELSE 0 END AS color_sim, CASE WHEN fits THEN material_sim ELSE 0 END AS material_sim,
  CASE WHEN fits THEN fit_sim ELSE 0 END AS fit_sim, CASE WHEN fits THEN detail_sim ELSE 0 END AS detail_sim, round(visual, 9) AS visual, fits AS compatible, direct,
  CASE WHEN fits THEN round(least(1.0, CASE WHEN direct AND same THEN greatest(raw, 0.985) WHEN cosine IS NOT NULL AND visual >= 0.92 AND same
    THEN greatest(raw, 0.92) ELSE raw END), 9) ELSE 0 END AS similarity
FROM (SELECT *, 0.03 + color_sim * 0.49 + material_sim * 0.11 + fit_sim * 0.10 + detail_sim * 0.07 + visual * 0.20 AS raw FROM (
  SELECT q.look, q.pos, i.id AS item, s.color_sim, s.material_sim, s.fit_sim, s.detail_sim, {_VISUAL} AS visual, {_FITS} AS fits, f.look IS NOT NULL AS direct, c.cosine, i.category = r.category AS same
  FROM need_v q JOIN rtx_v r ON {_SAME_NEED} JOIN own_v i ON i.id = q.part JOIN ig_v g ON g.id = i.id AND NOT g.deleted JOIN score_v s ON s.tid = g.tid AND s.rid = r.rid
  LEFT JOIN cos_v c ON c.vec = i.vec AND c.r_vec = q.vec LEFT JOIN ref_v f ON f.look = q.look AND f.item = i.id))""")
def garment_similarity(spark, sf):
    """The parts of the score of every look piece and the wardrobe item it was ordered as."""
    needs = view(spark, sf, "need_v").withColumnRenamed("part", "item")
    return matching.pair_similarity(None, _items(spark, sf), needs, cosines(spark, sf), view(spark, sf, "ref_v"))


@query("color_similarity", f"""
WITH p AS (SELECT id, color FROM item_v)
SELECT id, color, round(CASE WHEN color = '블랙' THEN 1.0 ELSE exp(-({{sq}}) / {2 * dims.COLOR_SIGMA ** 2}::DOUBLE) END, 9) AS to_black
FROM (SELECT p.id, p.color, c.r, c.g, c.b FROM p JOIN (VALUES {', '.join(f"({quote(n)}, {r}.0, {g}.0, {b}.0)" for n, (r, g, b) in dims.COLOR_RGB.items())}) c(n, r, g, b)
  ON c.n = p.color)""".replace("{sq}", "pow(r - 22, 2) + pow(g - 22, 2) + pow(b - 24, 2)"))
def color_similarity_q(spark, sf):
    return view(spark, sf, "item_v").select("id", "color", F.round(color_similarity(F.col("color"), F.lit("블랙")), 9).alias("to_black"))


@query("set_similarity", f"""
SELECT id, {sql_set_similarity('d_tok', sql_tokens("'데님 와이드 재킷'"))} AS denim_score FROM own_v""")
def set_similarity_q(spark, sf):
    parts = matching.item_parts(_items(spark, sf))
    return parts.select("id", set_similarity(tokens(F.col("detail_words")), tokens(F.lit("데님 와이드 재킷"))).alias("denim_score"))


@query("canonical_form", f"SELECT category, name, color, {_form('sleeve_length')} AS sleeve_form, {_form('length')} AS length_form FROM attr_v")
def canonical_form_q(spark, sf):
    t = seed_attributes(view(spark, sf, "item_v").select("category", "name", "color").distinct())
    return t.select("category", "name", "color", canonical_form(F.col("sleeve_length"), F.col("category")).alias("sleeve_form"),
                    canonical_form(F.col("length"), F.col("category")).alias("length_form"))


@query("known_colors", f"SELECT id, array_to_string(list_transform({sql_palette('name')}, lambda c: c.name), ',') AS found FROM item_v")
def known_colors_q(spark, sf):
    return view(spark, sf, "item_v").select("id", F.array_join(known_colors(F.col("name")), ",").alias("found"))
