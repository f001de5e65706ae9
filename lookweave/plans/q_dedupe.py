"""Deduplication and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe
from .bindings import table, view, words
from .registry import query


def _two_key_rounds(rounds: int = 12) -> str:
    """The scan as rounds: earliest for both keys is kept, its neighbours leave."""
    ctes = ["o0 AS MATERIALIZED (SELECT doc_id, n_chars AS k1, sha256(text) AS k2 FROM documents)"]
    for n in range(rounds):
        ctes.append(f"c{n} AS MATERIALIZED (SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY k1) AS a, min(doc_id) OVER (PARTITION BY k2) AS b FROM o{n}) WHERE doc_id = a AND doc_id = b)")
        ctes.append(f"o{n + 1} AS MATERIALIZED (SELECT * FROM o{n} WHERE k1 NOT IN (SELECT k1 FROM c{n}) AND k2 NOT IN (SELECT k2 FROM c{n}))")
    kept = " UNION ALL ".join(f"SELECT doc_id FROM c{n}" for n in range(rounds))
    return "WITH " + ", ".join(ctes) + f" {kept} UNION ALL SELECT -1 - doc_id FROM o{rounds}"


@query("dedupe_two_keys", _two_key_rounds())
def dedupe_two_keys(spark, sf):
    pins = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("k1"), F.sha2("text", 256).alias("k2"))
    return dedupe.first_by_two_keys(pins, "k1", "k2", "doc_id").select("doc_id")


@query("dedupe_sha256", "SELECT hash, doc_id, source FROM (SELECT sha256(text) AS hash, doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_sha256(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return dedupe.first_by(docs, "hash", F.struct("source", "doc_id"), ["doc_id", "source"])


@query("dedupe_url", "SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def dedupe_url(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return dedupe.first_by(pages, "url", F.col("page_id"), ["page_id"])


@query("distinct_styles", "SELECT DISTINCT person, unnest(string_split(styles, ',')) AS style FROM look_v")
def distinct_styles(spark, sf):
    return view(spark, sf, "look_v").select("person", F.explode(F.array_distinct(words("styles"))).alias("style")).distinct()


@query("unknown_keys", """
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS unknown FROM events WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1""")
def unknown_keys(spark, sf):
    """Requested keys that are not registered, per user."""
    asked = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("asked"))  # a handful of event types
    unknown = F.array_sort(F.array_except("asked", F.array(*[F.lit(k) for k in ("click", "view", "signup")])))
    return asked.select("user_id", F.array_join(unknown, ",").alias("unknown")).where("unknown <> ''")
