"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.vectors import cosine as cosine_of
from ..functions.vectors import engine_family, norm
from ..operators import ann, vectors
from .bindings import table
from .oracle import add_view
from .registry import query

K = 20
S = dims.SIM
_COS = "list_dot_product({0}, {1}) / greatest(1e-12, sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
add_view("vec_v", "SELECT vec_id AS id, label, CASE WHEN label = 9 THEN 'local' ELSE 'siglip' END AS family, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings")
add_view("piece_v", """
SELECT label AS piece, CASE WHEN label = 9 THEN 'local' ELSE 'siglip' END AS family, vector FROM proto_v
UNION ALL SELECT 100 + label, CASE WHEN label = 9 THEN 'local' ELSE 'siglip' END, arg_min(vector, id) FROM vec_v GROUP BY label""")


def rows(spark, sf):
    """Vectors of two engines, comparable within an engine's family only."""
    family = engine_family(F.when(F.col("label") == 9, "local-fingerprint-v1").otherwise("siglip:m1"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", family.alias("family"), F.col("embedding").alias("vector"))


def protos(spark, sf):
    family = engine_family(F.when(F.col("label") == 9, "local-fingerprint-v1").otherwise("siglip:m1"))
    return vectors.prototypes(table(spark, sf, "embeddings"), "label").select(F.col("label").cast("long").alias("query"), family.alias("family"), "vector")


def pieces(spark, sf):
    """Look pieces: the mean and the first vector of every class."""
    first = rows(spark, sf).groupBy("label", "family").agg(F.min_by("vector", "id").alias("vector"))
    first = first.select((F.col("label") + 100).cast("long").alias("piece"), "family", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
    return protos(spark, sf).withColumnRenamed("query", "piece").unionByName(first)


@query("cosine", f"SELECT v.id, round({_COS.format('v.vector', 'p.vector')}, 9) AS cosine FROM vec_v v JOIN proto_v p ON p.label = v.label")
def cosine(spark, sf):
    """Similarity of every vector to the mean of its class."""
    means = protos(spark, sf).select(F.col("query").cast("int").alias("label"), F.col("vector").alias("mean"))
    doubles = F.transform("vector", lambda v: v.cast("double"))
    return rows(spark, sf).join(means, "label").select("id", F.round(cosine_of(doubles, F.col("mean")), 9).alias("cosine"))


@query("normalize_vectors", "SELECT id, round(vector[1] / greatest(1e-12, n), 9) AS first, round(vector[-1] / greatest(1e-12, n), 9) AS last, round(n, 6) AS norm FROM (SELECT *, sqrt(list_dot_product(vector, vector)) AS n FROM vec_v)")
def normalize_vectors(spark, sf):
    unit = vectors.normalized(rows(spark, sf), "vector")
    return unit.select("id", F.round(F.element_at("unit", 1), 9).alias("first"), F.round(F.element_at("unit", -1), 9).alias("last"), F.round(norm(F.col("vector")), 6).alias("norm"))


@query("knn_topn", f"""
SELECT query, id, cosine, rank, visual >= 0.95 AS same_item, visual >= 0.62 AS related FROM (
SELECT *, greatest(0, least(1, (cosine + 1) / 2)) AS visual, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS INT) AS rank FROM (
  SELECT p.piece AS query, v.id, round({_COS.format('p.vector', 'v.vector')}, 9) AS cosine FROM piece_v p JOIN vec_v v ON v.family = p.family)) WHERE rank <= {K}""")
def knn_topn(spark, sf):
    """The twenty most similar items of every look piece."""
    queries = pieces(spark, sf).withColumnRenamed("piece", "query")
    items = rows(spark, sf).withColumn("vector", F.transform("vector", lambda v: v.cast("double")))
    best = vectors.top_similar(queries, items, K)
    visual = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2))
    return best.select("query", "id", "cosine", "rank", (visual >= 0.95).alias("same_item"), (visual >= 0.62).alias("related"))


add_view("centre_v", f"""
SELECT * FROM (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS list, family, vector FROM vec_v)
WHERE list < (SELECT least({ann.MOST}, ceil({ann.DENSITY} * sqrt(count(*)))) FROM vec_v)""")
add_view("stored_v", f"""
SELECT id, list FROM (SELECT id, list, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, list) AS place FROM (
  SELECT v.id, c.list, round({_COS.format('v.vector', 'c.vector')}, 9) AS cosine FROM vec_v v JOIN centre_v c ON c.family = v.family)) WHERE place <= {ann.COPIES}""")
add_view("read_v", f"""
SELECT piece, list FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY cosine DESC, list) AS place, count(*) OVER (PARTITION BY piece) AS n FROM (
  SELECT p.piece, c.list, round({_COS.format('p.vector', 'c.vector')}, 9) AS cosine FROM piece_v p JOIN centre_v c ON c.family = p.family)) WHERE place <= ceil({ann.SHARE} * n)""")
add_view("near_v", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS INT) AS rank FROM (
  SELECT k.piece AS query, v.id, round({_COS.format('p.vector', 'v.vector')}, 9) AS cosine
  FROM (SELECT DISTINCT r.piece, s.id FROM read_v r JOIN stored_v s ON s.list = r.list) k JOIN piece_v p ON p.piece = k.piece JOIN vec_v v ON v.id = k.id)""")


def _doubles(spark, sf):
    return rows(spark, sf).withColumn("vector", F.transform("vector", lambda v: v.cast("double")))


def _approximate(spark, sf):
    return ann.search(ann.build(_doubles(spark, sf)), pieces(spark, sf).withColumnRenamed("piece", "query"), K)


@query("knn_approx", f"SELECT query, id, cosine, rank FROM near_v WHERE rank <= {K}")
def knn_approx(spark, sf):
    """The twenty most similar items of every look piece among the lists nearest to it."""
    return _approximate(spark, sf).select("query", "id", "cosine", "rank")


@query("knn_recall", f"""
SELECT e.query, count(*) AS expected, count(n.id) AS hits FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM (
    SELECT p.piece AS query, v.id, round({_COS.format('p.vector', 'v.vector')}, 9) AS cosine FROM piece_v p JOIN vec_v v ON v.family = p.family)) e
LEFT JOIN (SELECT query, id FROM near_v WHERE rank <= {K}) n ON n.query = e.query AND n.id = e.id WHERE e.rank <= {K} GROUP BY e.query""")
def knn_recall(spark, sf):
    """How many of the exact twenty neighbours the index finds, per look piece."""
    exact = vectors.top_similar(pieces(spark, sf).withColumnRenamed("piece", "query"), _doubles(spark, sf), K)
    return ann.recall(_approximate(spark, sf), exact)


_BEST2 = f"""SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, piece) AS rank FROM (
  SELECT v.id, v.label, p.piece, round({_COS.format('p.vector', 'v.vector')}, 9) AS cosine FROM vec_v v JOIN piece_v p ON p.family = v.family)"""


def best_two(spark, sf):
    items = rows(spark, sf).withColumn("vector", F.transform("vector", lambda v: v.cast("double")))
    return vectors.best_pieces(items, pieces(spark, sf), 2)


@query("vector_join", f"SELECT id, piece, cosine, CAST(rank AS INT) AS rank FROM ({_BEST2}) WHERE rank <= 2")
def vector_join(spark, sf):
    """The two look pieces closest to every item, within one vector family."""
    return best_two(spark, sf).select("id", "piece", "cosine", "rank")


_MINE = "label IN (0, 1, 2, 8, 9) AND id % 4 <> 1"
_LEAST = f"{round(2 * S['relink_best'] - 1, 9)}"


def _uploads(spark, sf):
    """Items of which half are uploads, a quarter of those cut from a known look."""
    return _doubles(spark, sf).withColumns({"user_added": F.col("label").isin(0, 1, 2, 8, 9), "reference_look": F.when(F.col("id") % 4 == 1, F.col("id"))})


@query("relink_margin", f"""
SELECT id, piece, best, gap, best >= 0.97 AS takes_category FROM (SELECT id, max(piece) FILTER (WHERE rank = 1) AS piece, round((max(cosine) FILTER (WHERE rank = 1) + 1) / 2, 9) AS best,
  round(coalesce((max(cosine) FILTER (WHERE rank = 1) - max(cosine) FILTER (WHERE rank = 2)) / 2, 1.0), 9) AS gap FROM ({_BEST2}) WHERE rank <= 2 GROUP BY id) WHERE best >= 0.94 AND gap >= 0.03""")
def relink_margin(spark, sf):
    """Items whose best look piece is close and clearly ahead; all of them are uploads without a reference look here."""
    uploads = _doubles(spark, sf).withColumns({"user_added": F.lit(True), "reference_look": F.lit(None).cast("long")})
    return vectors.relink_uploads(uploads, pieces(spark, sf))


@query("relink_work", f"""
WITH piv AS (SELECT family, vector, n FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(piece AS VARCHAR)), piece) AS n FROM piece_v) WHERE n <= {vectors.PIVOTS}),
mine AS (SELECT * FROM vec_v WHERE {_MINE}),
ang AS (SELECT 'v' AS side, v.id, n, acos(greatest(-1.0, least(1.0, {_COS.format('v.vector', 'x.vector')}))) AS angle FROM mine v, piv x
  UNION ALL SELECT 'p', p.piece, n, acos(greatest(-1.0, least(1.0, {_COS.format('p.vector', 'x.vector')}))) FROM piece_v p, piv x),
pairs AS (SELECT v.id, p.piece, round({_COS.format('v.vector', 'p.vector')}, 9) >= {_LEAST} AS close FROM mine v JOIN piece_v p ON p.family = v.family),
met AS (SELECT a.id, b.id AS piece FROM ang a JOIN ang b ON a.side = 'v' AND b.side = 'p' AND a.n = b.n GROUP BY 1, 2 HAVING max(abs(a.angle - b.angle)) <= acos({_LEAST}) + 1e-6)
SELECT count(*) AS pairs, count(met.id) AS computed, count(*) FILTER (WHERE close) AS close FROM pairs LEFT JOIN met ON met.id = pairs.id AND met.piece = pairs.piece""")
def relink_work(spark, sf):
    """How many of all pairs of an upload and a look piece needed a cosine."""
    mine, parts = _uploads(spark, sf).where("user_added AND reference_look IS NULL"), pieces(spark, sf)
    close, computed = vectors.close_pairs(mine, parts, float(_LEAST))
    per_family = mine.groupBy("family").count().join(parts.groupBy("family").agg(F.count("*").alias("n")), "family").agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0)).alias("pairs"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return per_family.join(count(computed, "computed"), F.lit(True)).join(count(close, "close"), F.lit(True)).select("pairs", "computed", "close")


def _cache(spark, sf):
    """Items with pictures, and a vector cache of which some entries are stale, of another model or missing."""
    items = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.md5(F.concat_ws("-", F.col("vec_id").cast("string"), F.lit("img"))).alias("hash"), F.col("label").isin(0, 1, 2, 8, 9).alias("user_added"),
        F.when(F.col("label") == 8, F.array(F.lit(1.0))).alias("stored_vector"), F.when(F.col("vec_id") % 2 == 0, "siglip:m1").otherwise("local-fingerprint-v1").alias("stored_engine"))
    cache = table(spark, sf, "embeddings").where("label < 6").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") == 5, "m0").otherwise("m1").alias("model"),
        F.when(F.col("label") == 3, F.lit("old")).otherwise(F.md5(F.concat_ws("-", F.col("vec_id").cast("string"), F.lit("img")))).alias("hash"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    return vectors.cached_vectors(items, cache, "m1")


_READY = "label IN (0, 1, 2, 4) OR (label = 8 AND vec_id % 2 = 0)"


@query("cache_coverage", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE label IN (0, 1, 2, 8, 9)) AS mine, count(*) FILTER (WHERE {_READY}) AS ready, count(*) FILTER (WHERE NOT ({_READY})) AS missing FROM embeddings""")
def cache_coverage(spark, sf):
    ready = F.col("ready").isNotNull()
    return _cache(spark, sf).agg(F.count("*").alias("total"), F.count_if("user_added").alias("mine"), F.count_if(ready).alias("ready"), F.count_if(~ready).alias("missing"))


@query("encode_plan", f"SELECT vec_id AS id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 32 AS BIGINT) AS batch FROM embeddings WHERE NOT ({_READY})")
def encode_plan(spark, sf):
    missing = _cache(spark, sf).where("ready IS NULL").select("id")
    return vectors.encode_plan(missing)


@query("stale_vectors", """
SELECT vec_id AS id, CASE WHEN label = 3 THEN 'replaced image' WHEN label = 5 THEN 'old version' ELSE 'valid' END AS state FROM embeddings""")
def stale_vectors(spark, sf):
    """Vectors of replaced images or of an older analysis version are no longer valid."""
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.when(F.col("label") == 5, 3).otherwise(4).alias("version"))
    replaced = table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return vectors.stale(stored, replaced, 4).select("id", "state")
