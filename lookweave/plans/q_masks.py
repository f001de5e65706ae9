"""Mask queries on grids derived from the embedding table: one 8 x 8 grid per vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.text import lookup
from ..operators import masks
from .bindings import table
from .oracle import add_view, sql_hue, sql_in, sql_list, sql_lookup, sql_rgb_name
from .registry import query

SIDE = 8
_CAT = "list_extract(" + sql_list(dims.CATEGORIES) + ", {0} % 7 + 1)"
_ATR = ["Background", "Upper-clothes", "Skirt", "Pants", "Dress", "Belt", "Left-shoe", "Right-shoe", "Bag", "Scarf"]
_FASHION = ["unlabelled", "shirt, blouse", "jacket", "pants", "sleeve", "collar", "shoe", "bag, wallet", "hat", "pocket"]

add_view("grid_v", f"""
SELECT image, label, k, CAST((k - 1) // {SIDE} AS INT) AS y, CAST((k - 1) % {SIDE} AS INT) AS x, v, v > 0 AS "on", v < -0.05 AS occluder,
  CAST(floor((v + 1) * 100) AS INT) AS r, CAST(floor((1 - v) * 120) AS INT) AS g, CAST(floor(abs(v) * 250) AS INT) AS b, abs(v) * 2 AS confidence,
  CAST(floor(abs(v) * 60) AS INT) % 10 AS cell
FROM (SELECT vec_id AS image, label, k, CAST(embedding[k] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))""")

add_view("grid2_v", "SELECT image, y, x, CASE WHEN v > 0 THEN 240 + x ELSE r END AS r, CASE WHEN v > 0 THEN 240 + x ELSE g END AS g, CASE WHEN v > 0 THEN 240 + x ELSE b END AS b FROM grid_v")


def grid(spark, sf):
    v, k = F.col("v"), F.col("k")
    flat = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), "label", F.posexplode("embedding").alias("k", "f")).withColumn("v", F.col("f").cast("double"))
    return flat.select(
        "image", "label", F.floor(k / SIDE).cast("int").alias("y"), (k % SIDE).alias("x"), "v", (v > 0).alias("on"), (v < -0.05).alias("occluder"),
        F.floor((v + 1) * 100).cast("int").alias("r"), F.floor((1 - v) * 120).cast("int").alias("g"), F.floor(F.abs(v) * 250).cast("int").alias("b"),
        (F.abs(v) * 2).alias("confidence"), (F.floor(F.abs(v) * 60) % 10).cast("int").alias("cell"))


def labelled(spark, sf):
    """Components of masks and backgrounds of all images."""
    return masks.components(masks.runs(grid(spark, sf), ["image"]), ["image"])


def found(parts):
    return masks.regions(parts, ["image"], SIDE, SIDE)


@query("mask_runs", """
SELECT image, "on", y, CAST(min(x) AS INT) AS x0, CAST(max(x) + 1 AS INT) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY image, "on", y ORDER BY x) AS island FROM grid_v) GROUP BY image, "on", y, island""")
def mask_runs(spark, sf):
    return masks.runs(grid(spark, sf), ["image"])


def _component_views(tag: str, cells: str) -> None:
    """comp{tag}_v: the smallest cell that a cell reaches, by doubling rounds over neighbour and label of label."""
    add_view(f"cell{tag}_v", cells)
    add_view(f"near{tag}_v", f"""
SELECT a.image, a."on", a.node, b.node AS other FROM cell{tag}_v a JOIN cell{tag}_v b ON b.image = a.image AND b."on" = a."on" AND abs(a.y - b.y) + abs(a.x - b.x) = 1""")
    add_view(f"lab{tag}0_v", f'SELECT image, "on", node, node AS label FROM cell{tag}_v')
    for n in range(1, 25):
        add_view(f"nx{tag}{n}_v", f"""
SELECT l.image, l."on", l.node, least(l.label, coalesce(min(o.label), l.label)) AS label FROM lab{tag}{n - 1}_v l
LEFT JOIN near{tag}_v e ON e.image = l.image AND e."on" = l."on" AND e.node = l.node LEFT JOIN lab{tag}{n - 1}_v o ON o.image = e.image AND o."on" = e."on" AND o.node = e.other GROUP BY l.image, l."on", l.node, l.label""")
        add_view(f"lab{tag}{n}_v", f"""SELECT l.image, l."on", l.node, least(l.label, j.label) AS label FROM nx{tag}{n}_v l JOIN nx{tag}{n}_v j ON j.image = l.image AND j."on" = l."on" AND j.node = l.label""")
    add_view(f"comp{tag}_v", f'SELECT c.image, c."on", c.y, c.x, l.label FROM cell{tag}_v c JOIN lab{tag}24_v l ON l.image = c.image AND l."on" = c."on" AND l.node = c.node')


_NODE = "CAST(y AS BIGINT) * 16777216 + x AS node"
_component_views("", f'SELECT image, "on", y, x, {_NODE} FROM grid_v')
add_view("region_v", f"""
SELECT image, "on", label, count(*) AS size, bool_or(y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1})) AS border FROM comp_v GROUP BY 1, 2, 3""")


@query("components", 'SELECT image, "on", label, size, border FROM region_v')
def components(spark, sf):
    return found(labelled(spark, sf))


@query("holes", 'SELECT c.image, c.y, c.x FROM comp_v c JOIN region_v r ON r.image = c.image AND r."on" = c."on" AND r.label = c.label WHERE NOT r."on" AND NOT r.border')
def holes(spark, sf):
    parts = labelled(spark, sf)
    return masks.hole_cells(parts, found(parts), ["image"])


@query("mask_diagnosis", f"""
SELECT image, pixels, component_count, stray_count, round(largest / pixels, 4) AS largest_ratio, round(stray_pixels / pixels, 4) AS stray_ratio, hole_count,
  round(hole_pixels / (pixels + hole_pixels), 4) AS hole_ratio, round(pixels / {SIDE * SIDE}, 4) AS fill_ratio FROM (
SELECT image, CAST(sum(size) FILTER (WHERE "on") AS BIGINT) AS pixels, max(size) FILTER (WHERE "on") AS largest, count(*) FILTER (WHERE "on") AS component_count,
  count(*) FILTER (WHERE "on" AND size < top * 0.08) AS stray_count, coalesce(sum(size) FILTER (WHERE "on" AND size < top * 0.08), 0) AS stray_pixels,
  count(*) FILTER (WHERE NOT "on" AND NOT border) AS hole_count, coalesce(sum(size) FILTER (WHERE NOT "on" AND NOT border), 0) AS hole_pixels
FROM (SELECT *, max(CASE WHEN "on" THEN size END) OVER (PARTITION BY image) AS top FROM region_v) GROUP BY 1)""")
def mask_diagnosis(spark, sf):
    return masks.diagnosis(found(labelled(spark, sf)), ["image"], SIDE * SIDE)


@query("drop_strays", """
SELECT c.image, count(*) AS kept_pixels FROM comp_v c JOIN (SELECT * FROM (SELECT *, max(size) OVER (PARTITION BY image) AS top FROM region_v WHERE "on") WHERE size >= top * 0.3) r
  ON r.image = c.image AND r."on" = c."on" AND r.label = c.label GROUP BY 1""")
def drop_strays(spark, sf):
    parts = labelled(spark, sf)
    kept = masks.without_strays(parts, found(parts), ["image"], 0.3)
    return kept.groupBy("image").agg(F.sum(F.col("x1") - F.col("x0")).alias("kept_pixels"))


@query("bracketed", """
SELECT g.image, g.y, g.x FROM grid_v g LEFT JOIN (SELECT image, y, min(x) AS a, max(x) AS b FROM grid_v WHERE "on" GROUP BY 1, 2) r ON r.image = g.image AND r.y = g.y
LEFT JOIN (SELECT image, x, min(y) AS a, max(y) AS b FROM grid_v WHERE "on" GROUP BY 1, 2) c ON c.image = g.image AND c.x = g.x
WHERE coalesce(g.x BETWEEN r.a AND r.b, false) OR coalesce(g.y BETWEEN c.a AND c.b, false)""")
def bracketed(spark, sf):
    return masks.bracketed(grid(spark, sf), ["image"])


@query("crop_window", f"""
SELECT image, greatest(0, min(x) - 1) AS x0, greatest(0, min(y) - 1) AS y0, least({SIDE}, max(x) + 2) AS x1, least({SIDE}, max(y) + 2) AS y1 FROM grid_v WHERE v > 0.15 GROUP BY 1
UNION ALL SELECT image, 0, 0, {SIDE}, {SIDE} FROM grid_v GROUP BY 1 HAVING max(v) <= 0.15""")
def crop_window(spark, sf):
    return masks.crop_windows(grid(spark, sf).withColumn("on", F.col("v") > 0.15), ["image"], SIDE, SIDE, 1)


@query("enclosure", """
WITH s AS (SELECT c.image, c.label, c.y + d.dy AS y, c.x + d.dx AS x FROM comp_v c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx) WHERE NOT c."on"),
o AS (SELECT s.*, g.image IS NOT NULL AS hit FROM s LEFT JOIN (SELECT image, y, x FROM grid_v WHERE "on") g ON g.image = s.image AND g.y = s.y AND g.x = s.x
  WHERE NOT EXISTS (SELECT 1 FROM comp_v p WHERE p.image = s.image AND p.label = s.label AND NOT p."on" AND p.y = s.y AND p.x = s.x))
SELECT image, label, count(*) FILTER (WHERE hit) AS garment, count(*) FILTER (WHERE NOT hit) AS other, round(count(*) FILTER (WHERE hit) / greatest(1, count(*)), 6) AS enclosure FROM o GROUP BY 1, 2""")
def enclosure(spark, sf):
    parts = labelled(spark, sf).where("NOT on").select("image", "label", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    return masks.enclosure(parts, grid(spark, sf).where("on"), ["image"])


_band = lambda v, lo, hi, a, b, c: (f"CASE WHEN ({v} - {lo}) / greatest(1, {hi} - {lo}) < 0.38 THEN '{a}' WHEN ({v} - {lo}) / greatest(1, {hi} - {lo}) > 0.62 THEN '{c}' ELSE '{b}' END")


@query("where_code", f"""
SELECT image, CASE WHEN v = 'middle' AND h = 'center' THEN 'center' ELSE concat(v, '-', h) END AS code FROM (
SELECT m.image, {_band('r.cy', 'm.y0', 'm.y1', 'upper', 'middle', 'lower')} AS v, {_band('r.cx', 'm.x0', 'm.x1', 'left', 'center', 'right')} AS h
FROM (SELECT image, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid_v WHERE "on" GROUP BY 1) m
JOIN (SELECT image, avg(x) AS cx, avg(y) AS cy FROM grid_v WHERE occluder GROUP BY 1) r ON r.image = m.image)""")
def where_code(spark, sf):
    cells = grid(spark, sf)
    return masks.where_code(cells.where("on"), cells.where("occluder"), ["image"])


# The hull of a row lies between the outermost chords of two rows with cells around it.
add_view("ends_v", 'SELECT image, y, min(x) AS a, max(x) AS b FROM grid_v WHERE "on" GROUP BY 1, 2')
add_view("hull_v", """
SELECT g.image, g.y, min((p.a * (q.y - g.y) + q.a * (g.y - p.y)) // (q.y - p.y)) AS low, max((p.b * (q.y - g.y) + q.b * (g.y - p.y) + q.y - p.y - 1) // (q.y - p.y)) AS high
FROM (SELECT DISTINCT image, y FROM grid_v) g JOIN ends_v p ON p.image = g.image AND p.y <= g.y JOIN ends_v q ON q.image = g.image AND q.y >= g.y AND q.y > p.y GROUP BY 1, 2
UNION ALL SELECT image, y, a, b FROM ends_v WHERE image IN (SELECT image FROM ends_v GROUP BY 1 HAVING count(*) = 1)""")
add_view("inside_v", 'SELECT g.* FROM grid_v g JOIN hull_v h ON h.image = g.image AND h.y = g.y AND g.x BETWEEN h.low AND h.high')
_component_views("o", f"""
SELECT image, true AS "on", y, x, {_NODE} FROM inside_v i WHERE occluder AND NOT "on" AND NOT EXISTS (
  SELECT 1 FROM comp_v c JOIN region_v r ON r.image = c.image AND r."on" = c."on" AND r.label = c.label
  WHERE NOT r."on" AND NOT r.border AND c.image = i.image AND c.y = i.y AND c.x = i.x)""")
add_view("judged_v", f"""
WITH sides AS (SELECT c.image, c.label, c.y + d.dy AS y, c.x + d.dx AS x FROM compo_v c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dy, dx)),
touched AS (SELECT s.image, s.label, count(g.image) AS garment, count(*) AS every FROM sides s LEFT JOIN compo_v o ON o.image = s.image AND o.label = s.label AND o.y = s.y AND o.x = s.x
  LEFT JOIN grid_v g ON g.image = s.image AND g.y = s.y AND g.x = s.x AND g."on" WHERE o.image IS NULL GROUP BY 1, 2),
sizes AS (SELECT image, label, count(*) AS size FROM compo_v GROUP BY 1, 2), pixels AS (SELECT image, count(*) AS pixels FROM grid_v WHERE "on" GROUP BY 1)
SELECT s.image, s.label, s.size, round(t.garment / greatest(1, t.every), 6) >= {dims.ENCLOSURE_MIN} AS enclosed, s.size > p.pixels * {dims.OCCLUSION_MAX_RATIO} AS oversized
FROM sizes s JOIN touched t ON t.image = s.image AND t.label = s.label JOIN pixels p ON p.image = s.image""")
add_view("occluded_v", """
SELECT c.image, c.label, c.y, c.x FROM compo_v c JOIN judged_v j ON j.image = c.image AND j.label = c.label AND j.enclosed AND NOT j.oversized
LEFT JOIN ends_v r ON r.image = c.image AND r.y = c.y LEFT JOIN (SELECT image, x, min(y) AS top, max(y) AS bottom FROM grid_v WHERE "on" GROUP BY 1, 2) k ON k.image = c.image AND k.x = c.x
WHERE coalesce(c.x BETWEEN r.a AND r.b, false) OR coalesce(c.y BETWEEN k.top AND k.bottom, false)""")


@query("occlusion_report", f"""
WITH base AS (SELECT image, count(*) AS hull, count(*) FILTER (WHERE "on") AS pixels FROM inside_v GROUP BY 1),
sums AS (SELECT image, CAST(sum(size) AS BIGINT) AS candidate_pixels, count(*) FILTER (WHERE NOT enclosed) AS open_count, count(*) FILTER (WHERE enclosed AND oversized) AS oversized_count,
  CAST(coalesce(sum(size) FILTER (WHERE enclosed AND NOT oversized), 0) AS BIGINT) AS accepted FROM judged_v GROUP BY 1),
done AS (SELECT image, count(*) AS occluded, count(DISTINCT label) AS accepted_count FROM occluded_v GROUP BY 1),
part AS (SELECT image, cell, n, row_number() OVER (PARTITION BY image ORDER BY n DESC, cell DESC) AS rank FROM (
  SELECT o.image, g.cell, count(*) AS n FROM occluded_v o JOIN grid_v g ON g.image = o.image AND g.y = o.y AND g.x = o.x GROUP BY 1, 2)),
shares AS (SELECT p.image, string_agg(printf('%d:%.3f', p.cell, round(p.n / d.occluded, 3)), ',' ORDER BY p.rank) AS by_ FROM part p JOIN done d ON d.image = p.image WHERE p.rank <= 3 GROUP BY 1),
code AS (SELECT image, CASE WHEN v = 'middle' AND h = 'center' THEN 'center' ELSE concat(v, '-', h) END AS code FROM (
  SELECT m.image, {_band('r.cy', 'm.y0', 'm.y1', 'upper', 'middle', 'lower')} AS v, {_band('r.cx', 'm.x0', 'm.x1', 'left', 'center', 'right')} AS h
  FROM (SELECT image, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid_v WHERE "on" GROUP BY 1) m
  JOIN (SELECT image, avg(x) AS cx, avg(y) AS cy FROM occluded_v GROUP BY 1) r ON r.image = m.image))
SELECT b.image, round(pixels / hull, 4) AS solidity, round((hull - pixels) / hull, 4) AS deficit_ratio, coalesce(candidate_pixels, 0) AS candidate_pixels, coalesce(occluded, 0) AS occluded_pixels,
  round(coalesce(occluded, 0) / (pixels + coalesce(occluded, 0)), 4) AS occluded_ratio, coalesce(accepted_count, 0) AS accepted_count, coalesce(open_count, 0) AS open_count,
  coalesce(oversized_count, 0) AS oversized_count, coalesce(accepted, 0) - coalesce(occluded, 0) AS trimmed_pixels, coalesce(code, '') AS "where", coalesce(by_, '') AS "by"
FROM base b LEFT JOIN sums s ON s.image = b.image LEFT JOIN done d ON d.image = b.image LEFT JOIN code c ON c.image = b.image LEFT JOIN shares h ON h.image = b.image""")
def occlusion_report(spark, sf):
    parts = labelled(spark, sf)
    inner = masks.hole_cells(parts, found(parts), ["image"])
    return masks.occlusion(grid(spark, sf).withColumn("part", F.col("cell")), "image", inner)


# ---- label maps -------------------------------------------------------------------------------
_name = f"CASE WHEN label < 5 THEN list_extract({sql_list(_ATR)}, cell + 1) ELSE list_extract({sql_list(_FASHION)}, cell + 1) END"
add_view("pix_v", f"""
SELECT *, CASE WHEN taxonomy = 'atr' THEN {sql_lookup('name', dims.ATR_LABELS, 'NULL')} ELSE {sql_lookup('name', dims.FASHION_LABELS, 'NULL')} END AS category,
  taxonomy <> 'atr' AND name IN {sql_in(dims.FASHION_PARTS)} AS is_part
FROM (SELECT *, CASE WHEN label < 5 THEN 'atr' ELSE 'fashion' END AS taxonomy, {_name} AS name FROM grid_v)""")


def label_pixels(spark, sf):
    from ..functions.text import array_of

    atr = F.col("label") < 5
    named = F.when(atr, F.element_at(array_of(_ATR), F.col("cell") + 1)).otherwise(F.element_at(array_of(_FASHION), F.col("cell") + 1))
    rows = grid(spark, sf).withColumns({"taxonomy": F.when(atr, "atr").otherwise("fashion"), "name": named})
    return rows.withColumns({
        "category": F.when(F.col("taxonomy") == "atr", lookup(F.col("name"), dims.ATR_LABELS, None)).otherwise(lookup(F.col("name"), dims.FASHION_LABELS, None)),
        "is_part": (F.col("taxonomy") != "atr") & F.col("name").isin(dims.FASHION_PARTS)})


@query("map_labels", "SELECT image, category, string_agg(DISTINCT name, '+' ORDER BY name) AS labels, count(*) AS pixels FROM pix_v WHERE category IS NOT NULL GROUP BY 1, 2".replace(
    "string_agg(DISTINCT name, '+' ORDER BY name)", "array_to_string(list_transform(list_sort(list_distinct(list(cell * 1000 + 0))), lambda c: list_extract(CASE WHEN any_value(label) < 5 THEN "
    + sql_list(_ATR) + " ELSE " + sql_list(_FASHION) + " END, c // 1000 + 1)), '+')"))
def map_labels(spark, sf):
    """Pixels per image and category, with the merged labels in label order."""
    rows = label_pixels(spark, sf).where("category IS NOT NULL")
    merged = F.array_sort(F.collect_set(F.struct("cell", "name")))  # at most one entry per label of the taxonomy
    return rows.groupBy("image", "category").agg(F.array_join(merged.getField("name"), "+").alias("labels"), F.count("*").alias("pixels"))


_SHARE = f"""
SELECT image, name, coalesce(any_value(category), '') AS category, any_value(is_part) AS is_part, round(count(*) / {SIDE * SIDE}, 4) AS ratio FROM pix_v WHERE name NOT IN {sql_in(dims.BACKGROUND_LABELS)}
GROUP BY 1, 2 HAVING count(*) / {SIDE * SIDE} >= {dims.RAW_LABEL_MIN_RATIO}"""


def shares(spark, sf):
    counted = label_pixels(spark, sf).where(~F.col("name").isin(dims.BACKGROUND_LABELS)).groupBy("image", "name").agg(
        F.coalesce(F.any_value("category"), F.lit("")).alias("category"), F.any_value("is_part").alias("is_part"), (F.count("*") / (SIDE * SIDE)).alias("ratio"))
    return counted.where(F.col("ratio") >= dims.RAW_LABEL_MIN_RATIO).withColumn("ratio", F.round("ratio", 4))


@query("label_share", _SHARE)
def label_share(spark, sf):
    return shares(spark, sf)


@query("part_share", f"SELECT image, count(*) FILTER (WHERE is_part) AS parts, round(coalesce(sum(ratio) FILTER (WHERE is_part), 0), 4) AS part_ratio FROM ({_SHARE}) GROUP BY 1")
def part_share(spark, sf):
    return shares(spark, sf).groupBy("image").agg(
        F.count_if("is_part").alias("parts"), F.round(F.sum(F.when(F.col("is_part"), F.col("ratio")).otherwise(0.0)), 4).alias("part_ratio"))


@query("mask_measure", f"""
SELECT image, category, pixels, x0, y0, x1, y1, round(pixels / {SIDE * SIDE}, 6) AS area, round(CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN pixels / ((x1 - x0) * (y1 - y0)) ELSE 0.0 END, 5) AS fill, round(confidence, 5) AS confidence
FROM (SELECT image, category, count(*) AS pixels, greatest(0, min(x) - 1) AS x0, greatest(0, min(y) - 1) AS y0, least({SIDE}, max(x) + 1) AS x1, least({SIDE}, max(y) + 1) AS y1, avg(confidence) AS confidence
  FROM pix_v WHERE category IS NOT NULL GROUP BY 1, 2)""")
def mask_measure(spark, sf):
    rows = masks.measure(label_pixels(spark, sf).where("category IS NOT NULL"), ["image", "category"], SIDE, SIDE, pad=1)
    return rows.withColumns({"area": F.round("area", 6), "fill": F.round("fill", 5), "confidence": F.round("confidence", 5)})


def _color_sql(source: str) -> str:
    top, low = "greatest(r, g, b)", "least(r, g, b)"
    return f"""
WITH p AS (SELECT image, r, g, b, (r // 24) * 121 + (g // 24) * 11 + b // 24 AS bin FROM {source}),
m AS (SELECT image, arg_min(bin, (-n, bin)) AS bin FROM (SELECT image, bin, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT image, r, g, b, {sql_rgb_name('hue', 'sat', 'value')} AS color FROM (SELECT image, r, g, b, {sql_hue('r', 'g', 'b')} AS hue, CASE WHEN {top} = 0 THEN 0 ELSE ({top} - {low}) / {top} END AS sat, {top} / 255.0 AS value
FROM (SELECT p.image, median(r) AS r, median(g) AS g, median(b) AS b FROM p JOIN m ON m.image = p.image AND m.bin = p.bin GROUP BY 1))"""


@query("dominant_color", _color_sql('(SELECT * FROM grid_v WHERE "on")'))
def dominant_color(spark, sf):
    return masks.dominant_color(grid(spark, sf).where("on").select("image", "y", "x", "r", "g", "b"), ["image"])


_pale = "(greatest(r, g, b) / 255.0 > 0.88 AND (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) < 0.10)"


@query("foreground_color", _color_sql(f"(SELECT * FROM (SELECT *, count(*) FILTER (WHERE NOT {_pale}) OVER (PARTITION BY image) AS front FROM grid2_v) WHERE NOT {_pale} OR front < 20)"))
def foreground_color(spark, sf):
    bright = [F.when(F.col("v") > 0, F.lit(240) + F.col("x")).otherwise(F.col(c)).alias(c) for c in ("r", "g", "b")]
    return masks.foreground_color(grid(spark, sf).select("image", "y", "x", *bright), ["image"])


@query("local_fingerprint", """
WITH p AS (SELECT image, y, x, unnest([0, 1, 2]) AS c, unnest([(r - m) / 255, (g - m) / 255, (b - m) / 255]) AS value FROM (SELECT *, (r + g + b) / 3.0::DOUBLE AS m FROM grid_v))
SELECT image, y, x, c, round(value / norm, 9) AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY image)) AS norm FROM p)""")
def local_fingerprint(spark, sf):
    return masks.fingerprint(grid(spark, sf), ["image"]).withColumn("value", F.round("value", 9))


# ---- model agreement ---------------------------------------------------------------------------
add_view("seen_v", f"""
SELECT image, 'b2_clothes' AS model, {_CAT.format('label')} AS category, y, x FROM grid_v WHERE v > 0
UNION ALL SELECT image, 'b3_clothes', {_CAT.format('label')}, y, x FROM grid_v WHERE v > 0.02
UNION ALL SELECT image, 'b3_fashion', {_CAT.format('(label + label // 5)')}, y, x FROM grid_v WHERE v > 0.1 AND label < 8""")


def seen(spark, sf):
    from ..functions.text import array_of

    cells = grid(spark, sf)
    name = lambda n: F.element_at(array_of(dims.CATEGORIES), n % 7 + 1)
    rows = [cells.where(rule).select("image", F.lit(m).alias("model"), name(n).alias("category"), "y", "x") for m, rule, n in (
        ("b2_clothes", "v > 0", F.col("label")), ("b3_clothes", "v > 0.02", F.col("label")),
        ("b3_fashion", "v > 0.1 AND label < 8", F.col("label") + F.floor(F.col("label") / 5).cast("int")))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("model_agreement", f"""
WITH o AS (SELECT *, list_position({sql_list(dims.MODELS)}, model) AS ord FROM seen_v),
c AS (SELECT DISTINCT a.image, a.model AS "left", b.model AS "right", a.ord AS lo, b.ord AS ro FROM (SELECT DISTINCT image, model, ord FROM o) a JOIN (SELECT DISTINCT image, model, ord FROM o) b ON b.image = a.image AND b.ord > a.ord),
p AS (SELECT c.image, c."left", c."right", o.category, o.y, o.x, bool_or(o.ord = c.lo) AS l, bool_or(o.ord = c.ro) AS r FROM c JOIN o ON o.image = c.image AND o.ord IN (c.lo, c.ro) GROUP BY ALL)
SELECT image, category, "left", "right", CASE WHEN bool_or(l) AND bool_or(r) THEN round(count(*) FILTER (WHERE l AND r) / count(*), 3) ELSE 0.0 END AS iou,
  CASE WHEN NOT bool_or(r) THEN "left" WHEN NOT bool_or(l) THEN "right" ELSE '' END AS only_in FROM p GROUP BY image, category, "left", "right\"""")
def model_agreement(spark, sf):
    return masks.agreement(seen(spark, sf), "image", dims.MODELS)
