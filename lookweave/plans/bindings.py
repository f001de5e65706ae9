"""Bindings: the garment-shaped views the registered queries run on.

The given tables hold no garments, so each view derives garment columns from whole
tables with plain expressions.  ``SHARED`` is written once in SQL that both engines
accept; the views that need arrays are DataFrame expressions below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLORS = {"red": "레드", "blue": "블루", "cold": "네이비", "hot": "코랄", "large": "블랙", "small": "아이보리",
          "new": "화이트", "old": "브라운"}
KINDS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
NOUNS = {
    "상의": ["옥스포드 셔츠", "니트", "후드 집업", "반팔 티셔츠", "폴로 셔츠", "긴팔 티셔츠", "슬리브리스 톱", "캐미솔"],
    "아우터": ["윈드브레이커", "데님 자켓", "패딩", "가디건", "레더 재킷", "트랙탑", "코트", "크롭 재킷"],
    "하의": ["데님 팬츠", "슬랙스", "치노 팬츠", "쇼츠", "카고 팬츠", "린넨 반바지", "드로즈", "롱 스커트"],
    "신발": ["스니커즈", "더비 슈즈", "로퍼", "부츠", "러닝화", "샌들", "메쉬 운동화", "뮬"],
    "액세서리": ["볼캡", "가죽 벨트", "크루 양말", "안경", "머플러", "실버 반지", "손목 시계", "목걸이"],
    "가방": ["백팩", "크로스백", "토트백", "숄더백", "웨이스트백", "메신저백", "클러치", "보스턴백"],
    "원피스": ["셔츠 원피스", "니트 원피스", "데님 점프수트", "롱 드레스", "체크 원피스", "린넨 드레스", "미니 원피스", "민소매 드레스"],
}
TYPES = {"ECONOMY": "상의", "LARGE": "아우터", "MEDIUM": "하의", "PROMO": "신발", "SMALL": "액세서리"}


def _case(key: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


_COLOR_ROWS = _values(list(COLORS.items()))
_NOUN_ROWS = _values([(c, k, i, n) for c, nouns in NOUNS.items() for i, (k, n) in enumerate(zip(KINDS, nouns))])

# Stored analyses: subcategory, material, texture, fit, silhouette, sleeve length, length, neckline, pattern, finish, construction,
# primary colour, secondary colours.  Of 17 items in a row the last five have none and are read off their names.
ANALYSES = [
    ("셔츠", "코튼", "평직", "레귤러", "스트레이트", "긴팔", "기본", "카라", "스트라이프", "무광", "단추 포켓", "", "화이트"),
    ("티셔츠", "면", "저지", "오버핏", "여유", "반팔", "기본", "라운드넥", "무지", "무광", "봉제", "블랙", ""),
    ("니트", "울", "골지", "세미오버", "여유", "긴팔", "기본", "브이넥", "무지", "보송한 질감", "밑단 시보리", "", "베이지,그레이"),
    ("데님 팬츠", "데님", "능직", "와이드", "커브드", "확인 어려움", "긴바지", "확인 어려움", "무지", "워싱", "포켓 리벳", "네이비", ""),
    ("윈드브레이커", "나일론", "립스탑", "크롭", "여유", "긴팔", "크롭", "하이넥", "무지", "유광", "지퍼 후드", "", ""),
    ("레더 재킷", "레더", "가죽결", "슬림", "스트레이트", "긴팔", "기본", "카라", "무지", "유광", "지퍼", "블랙", "브라운"),
    ("슬랙스", "폴리에스터", "평직", "스트레이트", "스트레이트", "확인 어려움", "긴바지", "확인 어려움", "무지", "무광", "핀턱", "", ""),
    ("폴로 셔츠", "코튼", "피케", "레귤러", "기본", "반팔", "기본", "카라", "무지", "무광", "단추", "", "네이비"),
    ("슬리브리스", "합성 섬유", "메쉬", "기본", "스트레이트", "민소매", "기본", "라운드넥", "무지", "무광", "봉제", "화이트", ""),
    ("쇼츠", "린넨", "평직", "와이드", "여유", "확인 어려움", "반바지", "확인 어려움", "체크", "무광", "밴딩", "", "카키"),
    ("토트백", "가죽", "가죽결", "", "", "", "", "", "무지", "유광", "스트랩 지퍼", "브라운", ""),
    ("스웨트셔츠", "면 혼방", "기모", "세미와이드", "여유", "긴팔", "기본", "라운드넥", "레터링", "무광", "시보리", "그레이", ""),
]
# What a look piece asks for: materials, fits, details, sleeve length, length, subcategory, neckline.
WISHES = [
    ("코튼", "레귤러", "셔츠,카라", "긴팔", "기본", "셔츠", "카라"), ("면,린넨", "오버핏", "티셔츠", "반팔", "기본", "티셔츠", "라운드넥"),
    ("모직", "세미오버", "니트,골지", "긴팔", "기본", "니트", "브이넥"), ("", "", "", "확인 어려움", "확인 어려움", "확인 어려움", "확인 어려움"),
    ("진", "와이드", "데님 팬츠,워싱", "확인 어려움", "긴바지", "데님 팬츠", "확인 어려움"), ("나일론", "크롭", "지퍼,후드", "긴팔", "크롭", "윈드브레이커", "하이넥"),
    ("레더", "슬림", "재킷,지퍼", "확인 어려움", "기본", "재킷", "카라"), ("폴리에스터", "스트레이트", "핀턱,슬랙스", "확인 어려움", "확인 어려움", "슬랙스", "확인 어려움"),
    ("코튼", "여유", "폴로,단추", "반팔", "기본", "폴로 셔츠", "카라"), ("합성", "기본", "메쉬", "확인 어려움", "기본", "러닝", "확인 어려움"),
    ("", "와이드", "밴딩,포켓", "확인 어려움", "확인 어려움", "팬츠", "확인 어려움"), ("가죽", "", "스트랩", "확인 어려움", "롱", "가방", "확인 어려움"),
    ("울,코튼", "슬림,크롭", "", "확인 어려움", "확인 어려움", "확인 어려움", "확인 어려움"),
]

SHARED: dict[str, str] = {
    # Wardrobe items from the whole part table.
    "item_v": f"""
SELECT p.id, p.category, c.color, p.kind, n.noun, concat_ws(' ', c.color, p.fit_word, n.noun) AS name,
  CASE p.kind WHEN 'ring' THEN 'women' WHEN 'bolt' THEN 'men' ELSE 'all' END AS gender, p.worn, p.user_added, p.source_rank,
  n.kind_no % 5 AS kind_vec, CASE WHEN p.user_added THEN n.kind_no % 5 END AS vec, p.brand, p.price, p.size, p.deleted
FROM (
  SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS shade, split_part(p_name, ' ', 2) AS kind,
    {_case("p_type", TYPES, "CASE WHEN p_size % 2 = 0 THEN '가방' ELSE '원피스' END")} AS category,
    CASE p_size % 3 WHEN 0 THEN '와이드' WHEN 1 THEN '오버핏' END AS fit_word,
    p_size % 13 AS worn, p_brand IN ('Brand#1', 'Brand#2') AS user_added, p_brand = 'Brand#25' AS deleted,
    CASE WHEN p_size < 50 THEN p_size END AS source_rank, p_brand AS brand, p_retailprice AS price, p_size AS size
  FROM part) p
JOIN {_COLOR_ROWS} AS c(shade, color) ON c.shade = p.shade
JOIN {_NOUN_ROWS} AS n(category, kind, kind_no, noun) ON n.category = p.category AND n.kind = p.kind""",
    # Look requirements from every order line.
    "req_v": """
SELECT l.l_orderkey AS look, CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
    l.l_extendedprice, l.l_quantity, l.l_discount, l.l_tax, l.l_shipdate, l.l_returnflag) AS INT) AS pos,
  i.id AS part, i.category, i.name, i.color, CASE WHEN l.l_returnflag = 'R' THEN concat(i.color, ' 베이지') ELSE i.color END AS colors,
  CASE WHEN l.l_returnflag = 'A' THEN i.kind_vec END AS vec,
  CASE WHEN l.l_orderkey % 2 = 0 THEN 'women' ELSE 'men' END AS gender, 1 - l.l_tax * 6 AS confidence
FROM lineitem l JOIN item_v i ON i.id = l.l_partkey""",
    # Analyses stored for most items; the attributes differ from what the names say.
    "ana_v": f"""
SELECT i.id, a.* FROM item_v i JOIN {_values([(k, *a) for k, a in enumerate(ANALYSES)])} AS a(profile, subcategory, material, texture, fit, silhouette,
  sleeve_length, length, neckline, pattern, finish, construction, primary_color, secondary_colors) ON a.profile = i.id % 17""",
    # Requirements with what they ask for.
    "need_v": f"""
SELECT q.look, q.pos, q.part, q.category, q.vec, q.gender, replace(q.colors, ' 베이지', ',베이지') AS colors, w.materials, w.fits, w.details,
  w.sleeve_length, w.length, w.subcategory, w.neckline
FROM req_v q JOIN {_values([(k, *w) for k, w in enumerate(WISHES)])} AS w(wish, materials, fits, details, sleeve_length, length, subcategory, neckline)
  ON w.wish = (q.part + 5 * q.pos) % 13""",
    # Looks (one per order) with their body ranges.
    "look_v": """
SELECT o_orderkey AS id, o_custkey AS person, CASE WHEN o_orderkey % 2 = 0 THEN 'women' ELSE 'men' END AS gender,
  CAST(18 + o_orderkey % 5 AS DOUBLE) AS bmi_lo, CAST(23 + o_orderkey % 7 AS DOUBLE) AS bmi_hi,
  CAST(150 + o_orderkey % 15 AS DOUBLE) AS height_lo, CAST(170 + o_orderkey % 25 AS DOUBLE) AS height_hi,
  CASE o_orderpriority WHEN '1-URGENT' THEN '선선함,맑음' WHEN '2-HIGH' THEN '약한 비,간절기' WHEN '3-MEDIUM' THEN '맑음'
    WHEN '4-NOT SPECIFIED' THEN '선선함,습함,간절기' ELSE '더움' END AS weather,
  CASE o_orderstatus WHEN 'F' THEN '보통,마른 체형' WHEN 'O' THEN '보통' ELSE '상체가 발달한 체형' END AS shapes,
  CASE o_orderstatus WHEN 'F' THEN '미니멀,캐주얼' WHEN 'O' THEN '스트릿,캐주얼' ELSE '클래식,미니멀,클래식' END AS styles,
  o_totalprice AS price, o_orderkey % 11 <> 3 AS analysis_ready
FROM orders""",
    # Items a look was cut from: uploaded items bought in bulk.
    "ref_v": """
SELECT DISTINCT l.l_partkey AS item, l.l_orderkey AS look
FROM lineitem l JOIN item_v i ON i.id = l.l_partkey WHERE i.user_added AND l.l_quantity >= 45""",
    # One detection per order line: photo, model, category and quality measures.
    "det_v": """
SELECT l.l_orderkey AS photo, l.l_linenumber AS line, l.l_partkey AS part, l.l_suppkey AS supp,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'b2_clothes' WHEN 1 THEN 'b3_clothes' ELSE 'b3_fashion' END AS model,
  i.category, i.noun AS label, i.color, l.l_discount / 4 AS area, l.l_quantity / 50 AS fill, 1 - l.l_tax * 7 AS confidence
FROM lineitem l JOIN item_v i ON i.id = l.l_partkey""",
    "person_v": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'women' ELSE 'men' END AS gender,
  CAST(125 + (c_custkey * 7) % 90 AS DOUBLE) AS height, 30 + (c_acctbal + 1000) / 11000 * 155 AS weight,
  CASE c_custkey % 3 WHEN 0 THEN '보통' WHEN 1 THEN '마른 체형' ELSE '상체가 발달한 체형' END AS shape,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 0.0 ELSE CAST(50 + c_custkey % 120 AS DOUBLE) END AS waist,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(58 + c_custkey % 130 AS DOUBLE) END AS hip,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(55 + c_custkey % 110 AS DOUBLE) END AS chest,
  CASE WHEN c_custkey % 7 = 0 THEN CAST(28 + c_custkey % 45 AS DOUBLE) END AS shoulder,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(45 + c_custkey % 70 AS DOUBLE) END AS inseam,
  c_mktsegment = 'MACHINERY' AS photo
FROM customer""",
    # Judge verdicts: one evaluated case per document.
    "verdict_v": """
SELECT d.doc_id AS id, CASE WHEN d.doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS run, l.quality = 1 AS layering_ok,
  l.toxic = 0 AS identity_ok, d.n_chars % 3 = 0 AS accessories_ok, d.n_chars % 4 AS artifacts, CAST(d.n_chars AS DOUBLE) / 1000 AS seconds
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    # Feedback, saves, deletes and requests from every event.
    "fb_v": """
SELECT event_id AS id, user_id AS person, ts, event_type AS kind, event_id % 50 AS look, value,
  CASE event_type WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' END AS vote
FROM events""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_TABLES = ["part", "lineitem", "orders", "customer", "documents", "labels", "events"]


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared view as a DataFrame over the parquet tables."""
    import re

    sql, frames = SHARED[name], {}
    for other in [*SHARED, *_TABLES]:
        pattern = rf"(?<=FROM )\b{other}\b|(?<=JOIN )\b{other}\b"
        if other != name and re.search(pattern, sql):
            frames[other] = view(spark, sf, other) if other in SHARED else table(spark, sf, other)
            sql = re.sub(pattern, "{" + other + "}", sql)
    return spark.sql(sql, **frames)


def epoch_us(ts) -> "F.Column":
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def words(text: str):
    """Comma list -> array."""
    return F.split(F.col(text), ",")
