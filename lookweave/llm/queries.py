"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, filteraudit, language, linededup, neardup, packing, prefixtrie, quality, secretscan, toxicity, vafile, vectordup
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_minhash_forest")
def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def rating() -> Column:
    """Grade of a label row: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


@query("op9_quality_ordinal")
def op9_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), rating(), 2)
    scored = quality.score(documents, model)
    return scored.select("doc_id", "expected", F.col("tails")[0].alias("tail_1"), F.col("tails")[1].alias("tail_2"), (F.col("tails")[0] >= 0.5).alias("selected"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    lexicon = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(documents, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


@query("op10_vector_approximation")
def op10_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vafile.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vafile.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLES["op10_vector_approximation"] = """
WITH vectors AS (
  SELECT vec_id, [floor(CAST(x AS DOUBLE) * 1024) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = language.fit(documents, ~held_out)
    return language.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


# parameters of the tools that assistant turns stand for
TOOLS = (("answer", "query", "string", True), ("answer", "words", "integer", True), ("answer", "lines", "integer", False),
         ("quote", "query", "string", True), ("quote", "words", "integer", True),
         ("note", "query", "string", True), ("note", "words", "integer", True), ("note", "lines", "integer", True))
_NAME = "CASE length(coalesce(text, '')) % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'quote' WHEN 2 THEN 'note' ELSE 'other' END"
_WORDS = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', ''))"
_LINES = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))"


@query("op6_chat_linking")
def op6_chat_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as tool calls, the turns that answer them as results.

    A call's id is made of its conversation and turn; it uses the result of the call two turns before, and the turn after
    it is its result.  Turns without conversation or number have no id, a first turn that is no call answers none.  A call's arguments hold the text, a word count (as text if the text has as many lines as five) and, for
    texts of more lines than one, a line count.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    words, lines = F.expr(_WORDS), F.expr(_LINES)
    given = [F.to_json(F.struct(lines.alias("lines"), F.coalesce("text", F.lit("")).alias("query"), count.alias("words"))) for count in (words.cast("string"), words)]
    plain = F.to_json(F.struct(words.alias("words"), F.coalesce("text", F.lit("")).alias("query")))
    arguments = F.when(lines >= 5, given[0]).when(lines >= 1, given[1]).otherwise(plain)
    calls = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("after"), "turn", F.expr(_NAME).alias("name"), arguments.alias("arguments"))
    results = turns.where("role <> 'assistant' OR role IS NULL").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    linked = chat.link(calls, results, schemas)
    return linked.select("conv_id", "call_id", "position", F.coalesce("depth", F.lit(-1)).alias("depth"), "status", F.concat_ws(", ", "problems").alias("problems"), "json")


_J = "to_json(coalesce(text, ''))"
ORACLES["op6_chat_linking"] = f"""
WITH RECURSIVE turns AS (SELECT * FROM conversations),
shaped AS (SELECT DISTINCT conv_id, turn, {_NAME} AS name, {_LINES} AS lines, {_WORDS} AS words, text FROM turns WHERE role = 'assistant'),
calls AS (
  SELECT conv_id, turn, name, lines, 'call-' || conv_id || '-' || turn AS call_id, 'call-' || conv_id || '-' || (turn - 2) AS after,
    CASE WHEN lines >= 5 THEN '{{"lines":' || lines || ',"query":' || {_J} || ',"words":"' || words || '"}}'
         WHEN lines >= 1 THEN '{{"lines":' || lines || ',"query":' || {_J} || ',"words":' || words || '}}'
         ELSE '{{"query":' || {_J} || ',"words":' || words || '}}' END AS arguments
  FROM shaped),
nth AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY turn, name, arguments) AS nth FROM calls),
proper AS (SELECT * FROM nth WHERE nth = 1 AND call_id IS NOT NULL),
chain AS (
  SELECT call_id, CAST(0 AS BIGINT) AS depth FROM proper WHERE after NOT IN (SELECT call_id FROM proper)
  UNION ALL SELECT p.call_id, c.depth + 1 FROM chain c JOIN proper p ON p.after = c.call_id),
answers AS (
  SELECT conv_id, call_id, list({{'turn': turn, 'text': text}} ORDER BY turn NULLS FIRST, text NULLS FIRST)[1] AS f FROM (
    SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, turn, text FROM turns WHERE role <> 'assistant' OR role IS NULL) GROUP BY conv_id, call_id),
first AS (SELECT call_id, conv_id, f.turn AS turn, f.text AS result FROM answers),
checked AS (
  SELECT p.*, c.depth, f.result, f.call_id IS NOT NULL AS answered, CASE WHEN name = 'other' THEN 'unknown tool' ELSE concat_ws(', ',
    CASE WHEN name = 'note' AND lines = 0 THEN 'missing lines' END, CASE WHEN lines >= 5 THEN 'type words' END,
    CASE WHEN name = 'quote' AND lines >= 1 THEN 'unexpected lines' END) END AS problems
  FROM proper p JOIN chain c USING (call_id) LEFT JOIN first f USING (call_id)),
rows AS (
  SELECT conv_id, call_id, turn, depth, after, arguments, name, result, problems,
    CASE WHEN NOT answered THEN 'open' WHEN problems <> '' THEN 'invalid' ELSE 'ok' END AS status FROM checked
  UNION ALL SELECT conv_id, call_id, turn, NULL, after, arguments, name, NULL, '', CASE WHEN call_id IS NULL THEN 'unidentified' ELSE 'duplicate' END FROM nth WHERE nth > 1 OR call_id IS NULL
  UNION ALL SELECT conv_id, call_id, turn, NULL, NULL, NULL, NULL, result, '', CASE WHEN call_id IS NULL THEN 'unidentified' ELSE 'orphan' END FROM first
    WHERE call_id IS NULL OR call_id NOT IN (SELECT call_id FROM proper)),
written AS (
  SELECT *, '{{' || concat_ws(',', '"after":"' || after || '"', '"arguments":' || arguments, '"id":"' || call_id || '"',
    '"name":"' || name || '"', '"result":' || to_json(result), '"status":"' || status || '"') || '}}' AS json FROM rows)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, turn NULLS FIRST, call_id NULLS FIRST, status, json) AS position,
  CAST(coalesce(depth, -1) AS BIGINT) AS depth, status, problems, json FROM written"""


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    removed = linededup.removed_lines(documents, linededup.first_lines(documents, percent=80))
    return removed.select(F.col("doc").alias("doc_id"), "line")


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_embedding_dedup")
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


ORACLES["op11_embedding_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""


@query("op13_filter_audit")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM texts),
said AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
  FROM split LEFT JOIN said USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
hits AS (
  SELECT part, filter_order, step, n, good, toxic, contains(fails, own) AS hit, fails = own AS alone,
    length(fails) > 0 AND length(replace(translate(fails, before, ''), ' ', '')) < length(fails) AS earlier
  FROM steps, counts),
rows AS (
  SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE hit AND earlier), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT earlier), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE hit AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM hits GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM rows"""


@query("op12_prefix_trie")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list(t ORDER BY pos) AS ts, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(c AS VARCHAR), '')],
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
  FROM turns GROUP BY c),
rebuilt AS (SELECT o.c, coalesce(b.ts[1:o.h], []) || o.ts[o.h + 1:] AS s FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5),
prefixes AS (SELECT c, s[1:depth] AS p, depth, depth = len(s) AS last FROM rebuilt, range(0, len(s) + 1) r(depth)),
nodes AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '') AS ends
  FROM prefixes GROUP BY p, depth),
linked AS (
  SELECT n.*, q.conv_id AS parent_conv_id, (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE strlen(n.p[n.depth].text) END AS saved
  FROM nodes n LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]),
children AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c USING (p, depth)),
totals AS (
  SELECT f.p[1:top] AS p, top AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM full_nodes f, range(0, f.depth + 1) r(top) GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_nodes JOIN totals USING (p, depth)"""
