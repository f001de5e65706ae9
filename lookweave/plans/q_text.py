"""Text, naming and colour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import color as colors
from ..functions import text as texts
from ..functions.rules import seed_attributes as add_attributes
from ..sources.documents import parse_model_json as extract_object
from .bindings import table, view
from .oracle import quote, sql_hue, sql_in, sql_lookup, sql_strip_colors, sql_tokens
from .registry import query


@query("tokens", f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, ' ')) AS fingerprint FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", texts.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("fingerprint"))


@query("strip_colors", f"SELECT id, {sql_strip_colors('concat(name, brand)')} AS bare FROM (SELECT id, name, concat(' 라이트 그레이 Red  ', brand) AS brand FROM item_v)")
def strip_colors(spark, sf):
    full = F.concat("name", F.lit(" 라이트 그레이 Red  "), "brand")
    return view(spark, sf, "item_v").select("id", texts.strip_colors(full).alias("bare"))


_hue = sql_hue("r", "g", "b")
_top, _low = "greatest(r, g, b)", "least(r, g, b)"


@query("hex_color_name", f"""
SELECT id, CASE WHEN bad THEN '멀티컬러' WHEN {_top} - {_low} < 22 THEN CASE WHEN light < 0.18 THEN '블랙' WHEN light > 0.82 THEN '화이트' WHEN light > 0.58 THEN '라이트 그레이' ELSE '그레이' END
  WHEN light < 0.24 THEN CASE WHEN hue >= 190 AND hue < 260 THEN '네이비' ELSE '블랙' END WHEN hue < 15 OR hue >= 345 THEN '레드'
  WHEN hue < 45 THEN CASE WHEN light < 0.45 THEN '브라운' ELSE '베이지' END WHEN hue < 75 THEN '베이지' WHEN hue < 165 THEN '그린' WHEN hue < 195 THEN '민트'
  WHEN hue < 255 THEN CASE WHEN light < 0.42 THEN '네이비' ELSE '블루' END WHEN hue < 300 THEN '퍼플' ELSE '핑크' END AS color
FROM (SELECT id, bad, r, g, b, ({_top} + {_low}) / 510.0 AS light, {_hue} AS hue FROM (
  SELECT id, size % 17 = 0 AS bad, CAST((id * 37) % 256 AS DOUBLE) AS r, CAST((id * 91 + 13) % 256 AS DOUBLE) AS g, CAST((id * 53 + 7) % 256 AS DOUBLE) AS b FROM item_v))""")
def hex_color_name(spark, sf):
    c = F.col
    part = lambda v: F.lpad(F.hex(v), 2, "0")
    code = F.concat(F.lit("#"), part(c("id") * 37 % 256), part((c("id") * 91 + 13) % 256), F.lower(part((c("id") * 53 + 7) % 256)))
    return view(spark, sf, "item_v").select("id", colors.hex_color_name(F.when(c("size") % 17 == 0, "#12g").otherwise(code)).alias("color"))


@query("seed_attributes", """
SELECT id, a.category, subcategory, sleeve_length, length, neckline, material, fit, texture, wrinkle, finish, array_to_string(construction, ',') AS construction,
  array_to_string(season, ',') AS season, silhouette, pattern, array_to_string(weather, ',') AS weather,
  concat(a.color, ' ', subcategory, '. ', fit, ' 핏, ', texture, ', ', finish, ', ', wrinkle, '.') AS summary
FROM item_v i JOIN attr_v a ON a.category = i.category AND a.name = i.name AND a.color = i.color""")
def seed_attributes(spark, sf):
    joined = lambda n: F.array_join(n, ",").alias(n)
    return add_attributes(view(spark, sf, "item_v")).select(
        "id", "category", "subcategory", "sleeve_length", "length", "neckline", "material", "fit", "texture", "wrinkle", "finish",
        joined("construction"), joined("season"), "silhouette", "pattern", joined("weather"), "summary")


_noise = sql_in(dims.NAME_NOISE + [""])
_clash = "(contains(e, x[1]) OR contains(x[1], e))"
_push = (f"CASE WHEN x[1] IN {_noise} THEN acc WHEN len(list_filter(acc, lambda e: {_clash})) = 0 THEN list_concat(acc, x) "
         f"ELSE list_transform(acc, lambda e, i: CASE WHEN i = list_position(list_transform(acc, lambda e: {_clash}), true) AND length(x[1]) > length(e) THEN x[1] ELSE e END) END")


@query("feature_name", f"""
SELECT id, CASE WHEN auto AND feature <> '' THEN feature ELSE name END AS name, CASE WHEN auto AND feature <> '' THEN 'feature' WHEN auto THEN 'auto' ELSE 'manual' END AS name_source FROM (
SELECT id, name, auto, CASE WHEN len(kept) < 2 THEN '' ELSE substr(array_to_string(list_reduce([[named]], lambda acc, x: {_push}, kept), ' '), 1, 40) END AS feature FROM (
SELECT i.id, i.name, i.size % 3 <> 0 AS auto, CASE WHEN a.subcategory IN {_noise} THEN i.category ELSE a.subcategory END AS named,
  list_reduce([[CASE WHEN i.size % 5 = 0 THEN '색상 미분류' ELSE i.color END], [a.pattern], [CASE WHEN i.category = '하의' THEN a.length ELSE a.sleeve_length END], [a.fit], [a.material]],
    lambda acc, x: {_push}, CAST([] AS VARCHAR[])) AS kept
FROM item_v i JOIN attr_v a ON a.category = i.category AND a.name = i.name AND a.color = i.color))""")
def feature_name(spark, sf):
    c = F.col
    items = add_attributes(view(spark, sf, "item_v")).withColumn("primary_color", F.when(c("size") % 5 == 0, dims.UNSORTED_COLOR).otherwise(c("color")))
    made = items.select("id", "name", (c("size") % 3 != 0).alias("auto"), texts.feature_name(
        c("category"), c("primary_color"), c("pattern"), c("length"), c("sleeve_length"), c("fit"), c("material"), c("subcategory")).alias("feature"))
    renamed = c("auto") & (c("feature") != "")
    return made.select("id", F.when(renamed, c("feature")).otherwise(c("name")).alias("name"),
                       F.when(renamed, "feature").when(c("auto"), "auto").otherwise("manual").alias("name_source"))


@query("template_name", """
SELECT id, concat_ws(' ', color, CASE category WHEN '상의' THEN CASE WHEN color = '화이트' THEN '셔츠' ELSE '티셔츠' END WHEN '하의' THEN '팬츠' WHEN '신발' THEN '슈즈' ELSE category END,
  CASE WHEN length(CAST(id AS VARCHAR)) >= 3 THEN CAST(id AS VARCHAR) ELSE lpad(CAST(id AS VARCHAR), 3, '0') END) AS name FROM item_v""")
def template_name(spark, sf):
    return view(spark, sf, "item_v").select("id", texts.template_name(F.col("color"), F.col("category"), F.col("id")).alias("name"))


@query("descriptor", f"""
SELECT i.id, substr(array_to_string(list_aggregate_distinct, ' | '), 1, 96) AS descriptor FROM (SELECT id, list_transform(list_filter(
  list_transform(p, lambda v, k: CASE WHEN v <> '' AND list_position(p, v) = k THEN v ELSE '' END), lambda v: v <> ''), lambda v: v) AS list_aggregate_distinct FROM (
  SELECT i.id, [{', '.join(sql_strip_colors(f"replace({f}, '|', ' ')") for f in
    ("i.name", "a.subcategory", "a.pattern", "a.sleeve_length", "a.length", "a.fit", "a.silhouette", "a.neckline"))}] AS p
  FROM item_v i JOIN attr_v a ON a.category = i.category AND a.name = i.name AND a.color = i.color)) i""")
def descriptor(spark, sf):
    items = add_attributes(view(spark, sf, "item_v"))
    return items.select("id", texts.descriptor(*[F.col(n) for n in (
        "name", "subcategory", "pattern", "sleeve_length", "length", "fit", "silhouette", "neckline")]).alias("descriptor"))


_WIDE, _HIGH = 768, 1024


@query("bbox_pixels", f"""
SELECT look, pos, greatest(0, CAST(floor({_WIDE} * x0 / 1000) AS BIGINT)) AS x, greatest(0, CAST(floor({_HIGH} * y0 / 1000) AS BIGINT)) AS y,
  greatest(1, CAST(floor({_WIDE} * (x1 - x0) / 1000) AS BIGINT)) AS width, greatest(1, CAST(floor({_HIGH} * (y1 - y0) / 1000) AS BIGINT)) AS height,
  greatest(0, CAST(trunc((x0 / 1000 - 0.01) * {_WIDE}) AS BIGINT)) AS pad_x0, least({_WIDE}, CAST(trunc((x1 / 1000 + 0.01) * {_WIDE}) AS BIGINT)) AS pad_x1
FROM (SELECT look, pos, CAST(part % 400 AS DOUBLE) AS x0, CAST(part % 300 AS DOUBLE) AS y0, CAST(part % 400 + 1 + pos * 60 AS DOUBLE) AS x1, CAST(part % 300 + pos * 50 AS DOUBLE) AS y1 FROM req_v)""")
def bbox_pixels(spark, sf):
    c = F.col
    boxes = view(spark, sf, "req_v").select("look", "pos", (c("part") % 400).cast("double").alias("x0"), (c("part") % 300).cast("double").alias("y0"),
                                            (c("part") % 400 + 1 + c("pos") * 60).cast("double").alias("x1"), (c("part") % 300 + c("pos") * 50).cast("double").alias("y1"))
    px = lambda v, size: F.floor(F.lit(size) * v / 1000)
    low = lambda v, least: F.greatest(F.lit(least).cast("long"), v)
    return boxes.select("look", "pos", low(px(c("x0"), _WIDE), 0).alias("x"), low(px(c("y0"), _HIGH), 0).alias("y"),
                        low(px(c("x1") - c("x0"), _WIDE), 1).alias("width"), low(px(c("y1") - c("y0"), _HIGH), 1).alias("height"),
                        low(((c("x0") / 1000 - 0.01) * _WIDE).cast("long"), 0).alias("pad_x0"),
                        F.least(F.lit(_WIDE).cast("long"), ((c("x1") / 1000 + 0.01) * _WIDE).cast("long")).alias("pad_x1"))


@query("bbox_center", """
SELECT look, pos, greatest(0.0, least(100.0, (x0 + x1) / 20.0)) AS left_pct FROM (SELECT look, pos, CAST(part % 900 AS DOUBLE) AS x0, CAST(part % 900 + pos * 160 AS DOUBLE) AS x1 FROM req_v)""")
def bbox_center(spark, sf):
    x0 = F.col("part") % 900
    center = (x0 + x0 + F.col("pos") * 160) / 20
    return view(spark, sf, "req_v").select("look", "pos", F.greatest(F.lit(0.0), F.least(F.lit(100.0), center)).alias("left_pct"))


@query("content_key", "SELECT doc_id, concat(length(text), '-', sha256(text)) AS key FROM documents")
def content_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("-", F.length("text").cast("string"), F.sha2("text", 256)).alias("key"))


@query("parse_model_json", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k,
  CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN 'parsed' ELSE 'quarantine' END AS status FROM events""")
def parse_model_json(spark, sf):
    """Model answers in code fences; cut-off answers and lists go to quarantine."""
    c = F.col
    broken = F.when(c("event_id") % 7 == 0, F.substring("props", 1, 5)).when(c("event_id") % 5 == 0, F.lit("[1, 2]")).otherwise(c("props"))
    answers = table(spark, sf, "events").select("event_id", F.concat(F.lit("Sure:\n```JSON\n"), broken, F.lit("\n```\n")).alias("raw"))
    parsed = answers.select("event_id", extract_object(c("raw")).alias("object"))
    return parsed.select("event_id", F.coalesce(F.get_json_object("object", "$.k").cast("long"), F.lit(-1)).alias("k"),
                         F.when(c("object").isNull(), "quarantine").otherwise("parsed").alias("status"))


@query("overlay_analysis", f"""
SELECT i.id, CASE WHEN size % 3 = 0 THEN '울' ELSE a.material END AS material, CASE WHEN size % 4 = 0 THEN '슬림' ELSE a.fit END AS fit,
  CASE WHEN size % 2 = 0 THEN '겨울' ELSE array_to_string(a.season, ',') END AS season, CASE WHEN size % 5 = 0 THEN '' ELSE array_to_string(a.construction, ',') END AS construction
FROM item_v i JOIN attr_v a ON a.category = i.category AND a.name = i.name AND a.color = i.color""")
def overlay_analysis(spark, sf):
    """Model fields win over rule fields; scalars become one-element lists."""
    c, size = F.col, F.col("size")
    found = add_attributes(view(spark, sf, "item_v")).select(
        "*", F.when(size % 3 == 0, "울").alias("m_material"), F.when(size % 4 == 0, "슬림").alias("m_fit"),
        F.when(size % 2 == 0, F.array(F.lit("겨울"))).alias("m_season"), F.when(size % 5 == 0, F.array().cast("array<string>")).alias("m_construction"))
    over = lambda n: F.coalesce(c(f"m_{n}"), c(n))
    return found.select("id", over("material").alias("material"), over("fit").alias("fit"), F.array_join(over("season"), ",").alias("season"),
                        F.array_join(over("construction"), ",").alias("construction"))


@query("garment_noun", f"""
SELECT id, concat(CASE gender WHEN 'men' THEN 'men''s ' WHEN 'women' THEN 'women''s ' ELSE '' END, CASE WHEN len(nouns) = 1 THEN nouns[1] ELSE {sql_lookup('category', dims.CATEGORY_NOUNS, "'garment'")} END) AS noun
FROM (SELECT id, gender, category, list_distinct(list_filter(list_transform(string_split(label, '+'), lambda p: {sql_lookup('p', dims.LABEL_NOUNS, 'NULL')}), lambda v: v IS NOT NULL)) AS nouns
  FROM (SELECT id, gender, category, CASE size % 6 WHEN 0 THEN 'Skirt+Pants' WHEN 1 THEN 'Left-shoe+Right-shoe' WHEN 2 THEN 'Pants' WHEN 3 THEN 'Hat' WHEN 4 THEN 'Upper-clothes+Hat' ELSE '' END AS label FROM item_v))""")
def garment_noun(spark, sf):
    c, size = F.col, F.col("size")
    label = F.when(size % 6 == 0, "Skirt+Pants").when(size % 6 == 1, "Left-shoe+Right-shoe").when(size % 6 == 2, "Pants").when(size % 6 == 3, "Hat").when(
        size % 6 == 4, "Upper-clothes+Hat").otherwise("")
    nouns = F.array_distinct(F.array_compact(F.transform(F.split(label, r"\+"), lambda p: texts.lookup(p, dims.LABEL_NOUNS, None))))
    noun = F.when(F.size(nouns) == 1, F.try_element_at(nouns, F.lit(1))).otherwise(texts.lookup(c("category"), dims.CATEGORY_NOUNS, "garment"))
    owner = F.when(c("gender") == "men", "men's ").when(c("gender") == "women", "women's ").otherwise("")
    return view(spark, sf, "item_v").select("id", F.concat(owner, noun).alias("noun"))


@query("defect_hint", f"""
SELECT photo, line, part, CASE WHEN area * 3 < {dims.HINT_MIN_RATIO} THEN '' ELSE printf({quote(dims.HINT_TEXT)}, CAST(round_even(area * 300, 0) AS BIGINT),
  CASE line % 3 WHEN 0 THEN ' on its upper left side' WHEN 1 THEN ' on its lower center side' ELSE '' END,
  CASE WHEN supp % 2 = 0 THEN ' by the model''s left arm and bag' ELSE '' END) END AS hint FROM det_v""")
def defect_hint(spark, sf):
    c = F.col
    ratio = c("area") * 3
    where = F.when(c("line") % 3 == 0, "upper-left").when(c("line") % 3 == 1, "lower-center").otherwise("center")
    by = F.when(c("supp") % 2 == 0, F.array(F.lit("Left-arm"), F.lit("Bag"))).otherwise(F.array().cast("array<string>"))
    spoken = F.lower(F.replace(F.array_join(F.slice(by, 1, 2), " and "), F.lit("-"), F.lit(" ")))
    side = F.when(where != "center", F.concat(F.lit(" on its "), F.replace(where, F.lit("-"), F.lit(" ")), F.lit(" side"))).otherwise("")
    hidden = F.when(F.size(by) > 0, F.concat(F.lit(" by the model's "), spoken)).otherwise("")
    text = F.format_string(dims.HINT_TEXT, F.bround(c("area") * 300, 0).cast("long"), side, hidden)
    return view(spark, sf, "det_v").select("photo", "line", "part", F.when(ratio < dims.HINT_MIN_RATIO, "").otherwise(text).alias("hint"))
