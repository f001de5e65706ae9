"""Filter and clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.rules import seed_attributes
from ..functions.text import matches
from ..operators import filters
from .bindings import table, view
from .oracle import add_view, quote, sql_in, sql_match, sql_rules
from .registry import query


@query("visible_items", """
SELECT id, NOT deleted AND (user_added OR gender IN ('all', 'men')) AS for_men, NOT deleted AND (user_added OR gender IN ('all', 'women')) AS for_women,
  NOT deleted AS for_anyone FROM item_v""")
def visible_items(spark, sf):
    return view(spark, sf, "item_v").select("id", filters.visible("men").alias("for_men"), filters.visible("women").alias("for_women"),
                                            filters.visible(None).alias("for_anyone"))


@query("wardrobe_search", """
SELECT i.id FROM item_v i JOIN attr_v a ON a.category = i.category AND a.name = i.name AND a.color = i.color
WHERE i.category = '하의' AND contains(lower(concat_ws(' ', i.name, i.color, i.category, a.material, a.fit, a.finish)), '데님')""")
def wardrobe_search(spark, sf):
    items = seed_attributes(view(spark, sf, "item_v"))
    return items.where(filters.search("하의", " 데님 ", ["name", "color", "category", "material", "fit", "finish"])).select("id")


@query("scope_filter", "SELECT id, category FROM item_v WHERE user_added AND category IN ('상의', '하의', '신발') ORDER BY id LIMIT 60")
def scope_filter(spark, sf):
    return filters.scope(view(spark, sf, "item_v"), True, ["상의", "하의", "신발"], 60, "id").select("id", "category")


add_view("product_v", """
SELECT id, concat(name, CASE brand WHEN 'Brand#3' THEN ' 여행용 세트' WHEN 'Brand#4' THEN ' 수분 크림' WHEN 'Brand#5' THEN ' 2 COLOR' WHEN 'Brand#6' THEN ' Bag S'
  WHEN 'Brand#8' THEN ' Denim boots' ELSE '' END) AS name, CASE WHEN size % 4 = 0 THEN '전체' ELSE category END AS label, brand, category, color FROM item_v""")


def products(spark, sf):
    suffix = F.when(F.col("brand") == "Brand#3", " 여행용 세트").when(F.col("brand") == "Brand#4", " 수분 크림").when(
        F.col("brand") == "Brand#5", " 2 COLOR").when(F.col("brand") == "Brand#6", " Bag S").when(F.col("brand") == "Brand#8", " Denim boots").otherwise("")
    return view(spark, sf, "item_v").select(
        "id", F.concat("name", suffix).alias("name"), F.when(F.col("size") % 4 == 0, dims.ALL_LABEL).otherwise(F.col("category")).alias("label"), "brand",
        "category", "color")


@query("exclude_products", f"SELECT id, name FROM product_v WHERE NOT {sql_match('name', dims.EXCLUDED_PRODUCTS)}")
def exclude_products(spark, sf):
    return products(spark, sf).where(~matches(F.col("name"), dims.EXCLUDED_PRODUCTS)).select("id", "name")


def _gate(stage):
    w, h, r = dims.ASPECT_RULES[stage]
    return f"NOT (coalesce(w, 0) > 0 AND coalesce(h, 0) > 0 AND (w < {w} OR h < {h} OR h / w < {r})) AS {stage}"


@query("aspect_gate", f"""
SELECT id, {', '.join(_gate(s) for s in dims.ASPECT_RULES)} FROM (
  SELECT id, CASE WHEN size % 9 <> 0 THEN 180.0 + size * 8 END AS w, CASE WHEN size % 8 <> 0 THEN 250.0 + (id * 7) % 397 END AS h FROM item_v)""")
def aspect_gate(spark, sf):
    c = F.col
    photos = view(spark, sf, "item_v").select("id", F.when(c("size") % 9 != 0, 180.0 + c("size") * 8).alias("w"),
                                              F.when(c("size") % 8 != 0, 250.0 + (c("id") * 7) % 397).alias("h"))
    return photos.select("id", *[filters.aspect_ok(s, c("w"), c("h")).alias(s) for s in dims.ASPECT_RULES])


_TRUST = " OR ".join(f"regexp_matches(host, {quote(p)})" for p in dims.TRUSTED_DOMAINS)
add_view("purl_v", """
SELECT page_id, replace(replace(replace(url, '.example.com', '.naver.com'), '.example.net', '.co.kr'), 'spam-farm.example.org', 'youtube.com') AS url FROM pages""")


def page_urls(spark, sf):
    url = F.col("url")
    for old, new in ((".example.com", ".naver.com"), (".example.net", ".co.kr"), ("spam-farm.example.org", "youtube.com")):
        url = F.replace(url, F.lit(old), F.lit(new))
    return table(spark, sf, "pages").select("page_id", url.alias("url"))


@query("trusted_source", f"""
SELECT page_id, host, ({_TRUST}) AS trusted, regexp_matches(url, {quote(dims.BLOCKED_HOSTS)}) AS blocked, CASE WHEN page_id % 17 = 5 THEN '' ELSE url END AS safe_url FROM (
  SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM purl_v)""")
def trusted_source(spark, sf):
    """Hosts, trust and the address to link to; some addresses have a protocol that nothing may link to."""
    url = F.col("url")
    shown = F.when(F.col("page_id") % 17 == 5, F.regexp_replace(url, "^[a-z]+://", "javascript://")).otherwise(url)
    return page_urls(spark, sf).select("page_id", filters.host(url).alias("host"), filters.trusted(url).alias("trusted"),
                                       matches(url, dims.BLOCKED_HOSTS).alias("blocked"), filters.safe_url(shown).alias("safe_url"))


_NAMES = {"en": ("of the", "With"), "fr": ("de la", "Leaux"), "de": ("für sch", "Aulich"), "es": ("es un", "Cionos")}


@query("mention_filter", f"""
SELECT doc_id FROM (SELECT doc_id, lower(replace(text, ' ', '')) AS t,
  CASE lang {' '.join(f"WHEN '{k}' THEN '{n.replace(' ', '').lower()}'" for k, (n, _) in _NAMES.items())} ELSE 'noname' END AS n,
  CASE lang {' '.join(f"WHEN '{k}' THEN '{h.lower()}'" for k, (_, h) in _NAMES.items())} ELSE 'nohandle' END AS h FROM documents)
WHERE contains(t, n) OR contains(t, h)""")
def mention_filter(spark, sf):
    pick = lambda at, default: F.coalesce(*[F.when(F.col("lang") == k, F.lit(v[at])) for k, v in _NAMES.items()], F.lit(default))
    return table(spark, sf, "documents").where(filters.mentions(F.col("text"), pick(0, "noname"), pick(1, "nohandle"))).select("doc_id")


_TEXTS = ["piece_id", "label", "layer", "category", "colors", "materials", "fits", "details", "sleeve_length", "length", "subcategory", "pattern", "neckline", "engine"]
_or_unknown = lambda when, value: f"CASE WHEN {when} THEN '{value}' ELSE '{dims.UNKNOWN}' END"


@query("normalize_pieces", f"""
WITH n AS (SELECT look, pos, CASE WHEN part % 5 = 0 THEN concat('piece-', pos) ELSE concat('p', part) END AS piece_id,
  CASE WHEN part % 3 = 0 THEN CASE WHEN part % 13 <> 0 THEN concat(' ', category) ELSE concat('의류 ', pos) END ELSE name END AS label, CASE WHEN part % 10 = 0 THEN '이너' ELSE '단독' END AS layer,
  CASE WHEN part % 13 = 0 THEN '' ELSE category END AS category, CASE WHEN part % 4 = 0 THEN '' WHEN part % 4 = 1 THEN color ELSE concat(color, ',베이지') END AS colors,
  CASE part % 6 WHEN 0 THEN '울' WHEN 1 THEN '코튼,면' ELSE '' END AS materials, CASE WHEN part % 7 = 0 THEN '' ELSE '슬림' END AS fits, CASE WHEN part % 5 = 1 THEN '포켓,지퍼' ELSE '' END AS details,
  {_or_unknown('part % 3 = 1', '반팔')} AS sleeve_length, {_or_unknown('part % 4 = 1', '롱')} AS length,
  CASE WHEN part % 6 = 2 THEN '셔츠' WHEN part % 3 <> 0 THEN name ELSE '{dims.UNKNOWN}' END AS subcategory, {_or_unknown('part % 8 = 0', '체크')} AS pattern, {_or_unknown('part % 9 = 0', '카라')} AS neckline,
  CASE WHEN part % 3 = 0 THEN 'siglip:m1' ELSE '' END AS engine, CASE WHEN part % 3 = 0 THEN 2 ELSE 0 END AS dims,
  least(1000.0, greatest(0.0, (part % 7) * 200.0 - 100)) AS x0, least(1000.0, greatest(0.0, (part % 9) * 150.0)) AS x1,
  CASE WHEN part % 11 = 0 THEN 0.8 ELSE least(1.0, greatest(0.0, confidence * 1.3 - 0.4)) END AS confidence FROM req_v)
SELECT look, pos, {', '.join(_TEXTS)}, dims, x0, x1, round(confidence, 6) AS confidence, 'piece' AS status FROM n
WHERE category <> '' AND colors <> '' AND confidence >= 0.5
UNION ALL SELECT look, 0, {', '.join("''" for _ in _TEXTS)}, 0, 0.0, 0.0, 0.0, 'empty' FROM n GROUP BY look HAVING NOT bool_or(category <> '' AND colors <> '' AND confidence >= 0.5)""")
def normalize_pieces(spark, sf):
    c = F.col
    part = c("part")
    only = lambda when, value: F.when(when, F.lit(value))
    raw = view(spark, sf, "req_v").select(
        "look", "pos", F.when(part % 5 != 0, F.concat(F.lit("p"), part.cast("string"))).alias("piece_id"),
        F.when(part % 3 != 0, c("name")).alias("label"), F.when(part % 13 != 0, F.concat(F.lit(" "), c("category"))).alias("category"),
        F.when(part % 4 == 0, F.array(F.lit(" "), F.lit(None))).when(part % 4 == 2, F.array(c("color"), F.lit(""), F.lit("베이지"))).when(
            part % 4 == 3, F.array(F.concat(c("color"), F.lit(" ")), F.lit("베이지"))).alias("colors"), F.concat(c("color"), F.lit(" ")).alias("color"),
        F.when(part % 6 == 1, F.array(F.lit("코튼 "), F.lit(""), F.lit(None), F.lit("면"))).when(part % 6 != 0, F.array().cast("array<string>")).alias("materials"), F.lit(" 울").alias("material"),
        F.when(part % 7 != 0, F.array(F.lit("슬림"))).alias("fits"), F.when(part % 5 == 1, F.array(F.lit("포켓"), F.lit(" 지퍼 "))).alias("details"),
        only(part % 3 == 1, "반팔").alias("sleeve_length"), F.when(part % 4 == 1, "롱").otherwise("").alias("length"), only(part % 6 == 2, "셔츠").alias("subcategory"),
        only(part % 8 == 0, "체크").alias("pattern"), only(part % 9 == 0, "카라").alias("neckline"), only(part % 10 == 0, "이너").alias("layer"),
        F.when(part % 3 == 0, F.array(F.lit(1.0), (part % 5).cast("double"))).alias("visual_embedding"), only(part % 3 == 0, "siglip:m1").alias("visual_embedding_engine"),
        F.array((part % 7) * 200.0 - 100, F.lit(0.0), (part % 9) * 150.0, F.lit(1e6)).alias("bbox"),
        F.when(part % 11 != 0, c("confidence") * 1.3 - 0.4).alias("confidence"))
    good, empty = filters.normalize_pieces(raw)
    good = good.withColumns({n: F.array_join(n, ",") for n in ("colors", "materials", "fits", "details")}).withColumnRenamed("visual_embedding_engine", "engine")
    rows = good.select("look", "pos", *_TEXTS, F.coalesce(F.size("visual_embedding"), F.lit(0)).alias("dims"), c("bbox")[0].alias("x0"), c("bbox")[2].alias("x1"),
                       F.round("confidence", 6).alias("confidence"), F.lit("piece").alias("status"))
    rows = rows.withColumn("dims", F.greatest("dims", F.lit(0)))
    blank = F.lit("")
    return rows.unionByName(empty.select("look", F.lit(0).alias("pos"), *[blank.alias(n) for n in _TEXTS], F.lit(0).alias("dims"),
                                         *[F.lit(0.0).alias(n) for n in ("x0", "x1", "confidence")], F.lit("empty").alias("status")))


@query("validate_measurements", "SELECT id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN NOT ({m} BETWEEN {lo} AND {hi}) THEN '{m}' END" for m, (lo, hi) in dims.MEASURE_RANGES.items()) + """], lambda v: v IS NOT NULL), ',') AS violated
FROM person_v""")
def validate_measurements(spark, sf):
    return view(spark, sf, "person_v").select("id", F.array_join(filters.violations(), ",").alias("violated"))


@query("apply_analysis", f"""
SELECT id, CASE WHEN found IN {sql_in(dims.CATEGORIES)} THEN found ELSE category END AS category,
  CASE WHEN fcolor <> '' AND NOT contains(fcolor, '확인 어려움') THEN fcolor ELSE color END AS color FROM (
  SELECT id, category, color, CASE size % 4 WHEN 0 THEN '상의' WHEN 1 THEN 'jacket' WHEN 2 THEN '아우터' ELSE '' END AS found,
    CASE size % 5 WHEN 0 THEN '카키' WHEN 1 THEN '색 확인 어려움' WHEN 2 THEN '' ELSE '베이지' END AS fcolor FROM item_v)""")
def apply_analysis(spark, sf):
    size = F.col("size")
    found = F.when(size % 4 == 0, " 상의").when(size % 4 == 1, "jacket").when(size % 4 == 2, "아우터 ").otherwise(F.lit(None))
    color = F.when(size % 5 == 0, "카키").when(size % 5 == 1, "색 확인 어려움").when(size % 5 == 2, "").otherwise(" 베이지")
    new_category, new_color = filters.apply_analysis(F.col("category"), F.col("color"), found, color)
    return view(spark, sf, "item_v").select("id", new_category.alias("category"), new_color.alias("color"))


_REL = " + ".join(f"CASE WHEN contains(lower(t), {quote(w)}) THEN {p} ELSE 0 END" for w, p in dims.RELEVANCE_WEIGHTS)


@query("relevance_rank", f"""
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS place FROM (
SELECT id, (CASE WHEN contains(u, 'instagram.com') THEN 120 WHEN contains(u, 'blog.naver.com') THEN 55 ELSE 0 END + {_REL}) AS score FROM (
  SELECT id, concat(name, CASE size % 6 WHEN 0 THEN ' 데일리룩 코디' WHEN 1 THEN ' 인터뷰 사복' WHEN 2 THEN ' Fashion OUTFIT' WHEN 3 THEN ' 시사회 포토월' ELSE '' END) AS t,
    CASE size % 5 WHEN 0 THEN 'https://www.instagram.com/p/1' WHEN 1 THEN 'https://blog.naver.com/x' ELSE 'https://a.kr/' END AS u FROM item_v))""")
def relevance_rank(spark, sf):
    from ..operators.ranking import number_rows

    size = F.col("size")
    title = F.concat("name", F.when(size % 6 == 0, " 데일리룩 코디").when(size % 6 == 1, " 인터뷰 사복").when(size % 6 == 2, " Fashion OUTFIT").when(
        size % 6 == 3, " 시사회 포토월").otherwise(""))
    url = F.when(size % 5 == 0, "https://www.instagram.com/p/1").when(size % 5 == 1, "https://blog.naver.com/x").otherwise("https://a.kr/")
    scored = view(spark, sf, "item_v").select("id", filters.relevance(title, url).alias("score"))
    return number_rows(scored, [F.desc("score"), F.col("id")], "place")


@query("classify_filename", f"SELECT id, {sql_rules(chr(34) + 'file' + chr(34), dims.FILENAME_RULES, quote('상의'))} AS category FROM (SELECT id, concat(name, '_', size, '.JPG') AS \"file\" FROM item_v)")
def classify_filename(spark, sf):
    from ..functions.text import classify_filename as rule

    name = F.concat("name", F.lit("_"), F.col("size").cast("string"), F.lit(".JPG"))
    return view(spark, sf, "item_v").select("id", rule(name).alias("category"))


@query("infer_category", f"""
SELECT id, category FROM (SELECT id, CASE WHEN label <> '전체' THEN label ELSE {sql_rules('name', dims.CATEGORY_RULES, 'NULL')} END AS category FROM product_v)
WHERE category IS NOT NULL""")
def infer_category(spark, sf):
    from ..functions.text import infer_category as rule

    return products(spark, sf).select("id", rule(F.col("name"), F.col("label")).alias("category")).where("category IS NOT NULL")


@query("infer_color", f"""
SELECT id, CASE WHEN len(hits) > 0 THEN array_to_string(hits[1:3], '·') WHEN {sql_match('name', dims.MANY_COLORS_PATTERN)} THEN '색상 다양' ELSE '색상 미분류' END AS color
FROM (SELECT id, name, list_filter([{', '.join(f"CASE WHEN {sql_match('name', p)} THEN {quote(v)} END" for p, v in dims.NAME_COLOR_RULES)}], lambda v: v IS NOT NULL) AS hits
  FROM (SELECT id, CASE WHEN brand = 'Brand#5' THEN concat(category, ' 2 COLOR') WHEN brand = 'Brand#7' THEN category ELSE concat(name, ' ', brand, ' Sand Metal') END AS name FROM product_v))""")
def infer_color(spark, sf):
    from ..functions.text import infer_color as rule

    name = F.when(F.col("brand") == "Brand#5", F.concat("category", F.lit(" 2 COLOR"))).when(F.col("brand") == "Brand#7", F.col("category")).otherwise(
        F.concat("name", F.lit(" "), F.col("brand"), F.lit(" Sand Metal")))
    return products(spark, sf).select("id", rule(name).alias("color"))
