"""Layering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.text import lookup
from ..operators import layering
from .bindings import view
from .oracle import add_view, quote, sql_in, sql_keyword_rules, sql_lookup
from .registry import query

_clean = "lower(name)"
for _w in dims.UNDERWEAR_LOOKALIKES:
    _clean = f"replace({_clean}, {quote(_w)}, ' ')"
_words = " OR ".join(f"contains(clean, {quote(w)})" for ws, _ in dims.UNDERWEAR_RULES for w in ws)
_rank = " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.LAYER_RANK.items())
add_view("layer_v", f"""
SELECT look, pos, name, slot, confidence, part, under, CASE WHEN under THEN 5 WHEN slot = 'bag' THEN 60 WHEN slot = 'accessory' THEN {sql_keyword_rules('lower(name)', dims.ACCESSORY_RULES, 0, '70')}
    ELSE CASE slot {_rank} ELSE 99 END END AS layer_rank,
  CASE WHEN under THEN coalesce({sql_keyword_rules('clean', dims.UNDERWEAR_RULES, 1, 'NULL')}, concat('underwear-', body)) ELSE body END AS body_slot,
  slot = 'accessory' AND NOT under AND {sql_keyword_rules('lower(name)', dims.ACCESSORY_RULES, 2, 'false')} AS small,
  CASE WHEN under THEN {sql_keyword_rules('clean', dims.UNDERWEAR_RULES, 3, 'NULL')} ELSE {sql_lookup('slot', dims.SLOT_LABELS, 'slot')} END AS label
FROM (SELECT *, slot IN {sql_in(dims.UNDERWEAR_SLOTS)} AND ({_words}) AS under, {sql_lookup('slot', dims.BODY_SLOT, 'slot')} AS body FROM (
  SELECT look, pos, part, name, confidence, {_clean} AS clean, {sql_lookup('category', dims.CATEGORY_SLOT, "'unknown'")} AS slot FROM req_v))""")
add_view("worn_v", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY look ORDER BY layer_rank, pos) AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY look, body_slot ORDER BY layer_rank, pos) AS n, bool_or(body_slot = 'torso+legs') OVER (PARTITION BY look) AS covered FROM layer_v)
  WHERE (body_slot = 'accessory' OR n = 1) AND NOT (covered AND body_slot IN ('torso', 'legs'))) WHERE place <= {dims.OUTFIT_LIMIT}""")


def outfit_items(spark, sf):
    return view(spark, sf, "req_v").withColumn("slot", lookup(F.col("category"), dims.CATEGORY_SLOT, "unknown"))


def ordered(spark, sf):
    return layering.order_outfits(outfit_items(spark, sf), "look", "pos", ["name"])


@query("layer_rank", "SELECT look, pos, layer_rank, body_slot, small, label FROM layer_v")
def layer_rank(spark, sf):
    return layering.add_layers(outfit_items(spark, sf)).select("look", "pos", "layer_rank", "body_slot", "small", "label")


@query("layer_order", "SELECT look, pos, name, place, layer_rank, body_slot FROM worn_v")
def layer_order(spark, sf):
    return ordered(spark, sf).select("look", "pos", "name", "place", "layer_rank", "body_slot")


@query("dropped_items", "SELECT look, pos, name FROM layer_v l WHERE NOT EXISTS (SELECT 1 FROM worn_v w WHERE w.look = l.look AND w.pos = l.pos)")
def dropped_items(spark, sf):
    return layering.dropped_items(outfit_items(spark, sf), "look", "pos", ["name"])


@query("keyword_spec", f"SELECT id, {sql_keyword_rules('lower(name)', dims.ACCESSORY_RULES, 0, '70')} AS rank, {sql_keyword_rules('lower(name)', dims.ACCESSORY_RULES, 2, 'false')} AS small FROM item_v WHERE category = '액세서리'")
def keyword_spec(spark, sf):
    text = F.lower("name")
    return view(spark, sf, "item_v").where(F.col("category") == "액세서리").select(
        "id", layering.keyword_rule(text, dims.ACCESSORY_RULES, 0, dims.DEFAULT_ACCESSORY_RANK).alias("rank"),
        layering.keyword_rule(text, dims.ACCESSORY_RULES, 2, False).alias("small"))


_quoted = "list_transform(list_filter(items, lambda i: {0}), lambda i: concat('''', i.name, ''''))"


@query("outfit_caption", f"""
SELECT look, concat_ws(' ', array_to_string(list_transform(items, lambda i: concat('Reference image ', i.place + 1, ' is the ', i.label, ' ''', i.name, '''.')), ' '),
  CASE WHEN len(torso) >= 2 THEN concat('Torso layers from the skin outward: ', array_to_string(torso, ' then '), '.') END,
  CASE WHEN len(under) > 0 THEN concat(array_to_string(under, ', '), ' stays hidden as underwear.') END,
  CASE WHEN len(socks) > 0 AND len(shoes) > 0 THEN concat(socks[-1], ' goes on before ', shoes[-1], '.') END,
  concat('Items worn: ', len(items), '.'), CASE WHEN len(missing) > 0 THEN concat('Unchanged: ', array_to_string(missing, ', '), '.') END,
  CASE WHEN len(small) > 0 THEN concat(array_to_string(small, ', '), ' must stay visible.') END) AS caption
FROM (SELECT *, {_quoted.format('i.under')} AS under, {_quoted.format('i.small')} AS small, {_quoted.format('i.layer_rank = 45')} AS socks, {_quoted.format("i.slot = 'shoes'")} AS shoes,
  list_transform(list_filter(items, lambda i: i.slot IN ('overall', 'upper', 'outer')), lambda i: {sql_lookup('i.slot', dims.STACK_NAMES, 'i.slot')}) AS torso,
  list_filter([CASE WHEN NOT tops THEN 'top' END, CASE WHEN NOT legs THEN 'bottoms' END, CASE WHEN NOT feet THEN 'shoes' END], lambda v: v IS NOT NULL) AS missing
  FROM (SELECT look, list({{'place': place, 'slot': slot, 'name': name, 'label': label, 'small': small, 'under': under, 'layer_rank': layer_rank}} ORDER BY place) AS items,
    bool_or(slot IN ('upper', 'overall')) AS tops, bool_or(slot IN ('lower', 'overall')) AS legs, bool_or(slot = 'shoes') AS feet FROM worn_v GROUP BY look))""")
def outfit_caption(spark, sf):
    return layering.captions(ordered(spark, sf), "look")


@query("pair_selection", """
WITH p AS (SELECT *, 30 + part % 90 AS width, 25 + part % 110 AS height FROM layer_v WHERE confidence >= 0.6),
f AS (SELECT look, count(*) AS pieces, (bool_or(slot = 'upper') AND bool_or(slot = 'outer')) OR (bool_or(slot IN ('bag', 'accessory')) AND count(*) >= 2) AS useful FROM p GROUP BY look),
s AS (SELECT look, bool_and(least(width, height) >= CASE WHEN small THEN 12 ELSE 40 END) AS large FROM (
  SELECT *, row_number() OVER (PARTITION BY look ORDER BY layer_rank, pos) AS n FROM p) WHERE n <= 2 GROUP BY look)
SELECT f.look, pieces, useful, useful AND large AS kept FROM f JOIN s ON s.look = f.look""")
def pair_selection(spark, sf):
    pieces = outfit_items(spark, sf).withColumns({"width": 30 + F.col("part") % 90, "height": 25 + F.col("part") % 110})
    return layering.useful_pairs(pieces, "look")
