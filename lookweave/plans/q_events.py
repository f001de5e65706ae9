"""Event queries: budgets, toggles, queues, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback
from ..session import shared_folder
from ..streaming import jobs
from .bindings import epoch_us, table, view
from .registry import query

WINDOW, LIMIT = 36_000, 2  # the events are sparse: ten hours and two requests make the budget bite


_ADMISSION = f"""
WITH e AS (SELECT user_id, list({{'t': epoch_us(ts), 'id': event_id}} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
a AS (SELECT user_id, l, list_reduce(list_transform(l, lambda s: [s.t]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a >= x[1] - {WINDOW}000000)) < {LIMIT} THEN list_concat(acc, x) ELSE acc END, CAST([] AS BIGINT[])) AS ok FROM e),
r AS (SELECT user_id, ok, unnest(l) AS s FROM a)
SELECT s.id AS event_id, user_id, list_contains(ok, s.t) AS admitted, CASE WHEN list_contains(ok, s.t) THEN 0 ELSE
  greatest(1, ({WINDOW}000000 - (s.t - list_min(list_filter(ok, lambda a: a >= s.t - {WINDOW}000000 AND a < s.t)))) // 1000000) END AS retry_after FROM r"""


def requests(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", epoch_us("ts").alias("t"))


@query("admission_60s", _ADMISSION)
def admission(spark, sf):
    return feedback.admission(requests(spark, sf), "user_id", "t", "event_id", WINDOW, LIMIT)


SLICES = 3  # micro-batches of a replayed table


def _replayed(spark, sf, columns, start):
    """Run a stream over the events in ``SLICES`` slices of time, one micro-batch each, and give what it wrote.

    Every slice is added to the stream's folder and the stream is started again from its checkpoint.
    """
    events = table(spark, sf, "events").select(*columns, epoch_us("ts").alias("t"))
    cuts = events.agg(F.percentile_approx("t", [k / SLICES for k in range(1, SLICES)])).first()[0] or []
    root = shared_folder(spark, "stream")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events.where((F.lit(True) if low is None else F.col("t") > low) & (F.lit(True) if high is None else F.col("t") <= high))
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        made = start(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
        with jobs.timed_state(spark):
            run = made.trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("admission_stream", _ADMISSION)
def admission_stream(spark, sf):
    """The budget as a stream with per-client state over several micro-batches."""
    return _replayed(spark, sf, ["event_id", "user_id"], lambda events: jobs.admission_stream(events, "user_id", "t", "event_id", WINDOW, LIMIT))


@query("stream_upsert", """
SELECT person, kind, look, value FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts DESC, id DESC) AS n FROM fb_v) WHERE n = 1 AND kind <> 'error'""")
def stream_upsert(spark, sf):
    """Latest row per person from the event stream, deletes as tombstones."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").select(
        F.col("user_id").alias("person"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("event_id") % 50).alias("look"), "value",
        (F.col("event_type") == "error").alias("gone"))
    root = shared_folder(spark, "stream")
    run = jobs.upsert_stream(events, root, "person", ["ts", "id"], ["kind", "look", "value"], "gone").start()
    run.awaitTermination()
    return jobs.upserted(spark, root, run.lastProgress["batchId"], "gone").select("person", "kind", "look", "value")


@query("latest_wins", "SELECT person, look, arg_max(id, (ts, id)) AS id, arg_max(value, (ts, id)) AS value FROM fb_v GROUP BY 1, 2")
def latest_wins(spark, sf):
    return feedback.latest_response(view(spark, sf, "fb_v"), ["person", "look"], F.struct("ts", "id"), ["id", "value"])


@query("toggle_state", "SELECT person, look, count(*) % 2 = 1 AS saved FROM fb_v WHERE kind = 'purchase' GROUP BY 1, 2")
def toggle_state(spark, sf):
    return feedback.toggles(view(spark, sf, "fb_v").where("kind = 'purchase'"), ["person", "look"])


_VOTES = """SELECT person, vote_key AS look, list_reduce(list_prepend('', list(vote ORDER BY ts, id)), lambda s, v: CASE WHEN s = v THEN '' ELSE v END) AS vote
FROM (SELECT *, look % 3 AS vote_key FROM fb_v WHERE vote IS NOT NULL) GROUP BY 1, 2"""


def _votes(spark, sf):
    """Votes on three look groups, so that votes repeat and replace each other."""
    cast = view(spark, sf, "fb_v").where("vote IS NOT NULL").withColumn("look", F.col("look") % 3)
    return feedback.votes(cast, ["person", "look"], "vote", ["ts", "id"])


@query("vote_state", f"SELECT * FROM ({_VOTES}) WHERE vote <> ''")
def vote_state(spark, sf):
    return _votes(spark, sf)


@query("feedback_state", f"""
SELECT coalesce(v.look, s.look) AS look, coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(saves, 0) AS saves FROM (
  SELECT look, count(*) FILTER (WHERE vote = 'up') AS up, count(*) FILTER (WHERE vote = 'down') AS down FROM ({_VOTES}) WHERE vote <> '' GROUP BY 1) v
FULL JOIN (SELECT look, count(*) AS saves FROM (SELECT person, look, count(*) AS n FROM fb_v WHERE kind = 'purchase' GROUP BY 1, 2) WHERE n % 2 = 1 GROUP BY 1) s ON s.look = v.look""")
def feedback_state(spark, sf):
    """Standing votes and saves per look."""
    standing = _votes(spark, sf).groupBy("look").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"))
    saves = feedback.toggles(view(spark, sf, "fb_v").where("kind = 'purchase'"), ["person", "look"]).where("saved").groupBy("look").agg(F.count("*").alias("saves"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return standing.join(saves, "look", "full").select("look", zero("up"), zero("down"), zero("saves"))


_PIECES = "id % 700, id * 7 % 900, id * 13 % 1100"  # items an attempt was made of


@query("retain_last_good", f"""
WITH f AS (SELECT person, arg_max({{'look': look, 'id': id, 'items': [{_PIECES}], 'ok': value >= 60}}, (ts, id)) AS fresh,
  arg_max({{'look': look, 'id': id, 'items': [{_PIECES}]}}, (ts, id)) FILTER (WHERE value >= 60) AS good FROM fb_v GROUP BY 1),
alive AS (SELECT list(id) AS ids FROM item_v WHERE NOT deleted)
SELECT person, CASE WHEN fresh.ok THEN fresh.look ELSE good.look END AS look, CASE WHEN fresh.ok THEN fresh.id ELSE good.id END AS id,
  array_to_string(CASE WHEN fresh.ok THEN fresh.items ELSE good.items END, ',') AS items, NOT fresh.ok AS retained FROM f, alive
WHERE fresh.ok OR (good IS NOT NULL AND list_has_all(alive.ids, good.items))""")
def retain_last_good(spark, sf):
    """The last usable match of every person, as long as each of its items is still in the wardrobe."""
    alive = view(spark, sf, "item_v").where("NOT deleted").select(F.col("id").alias("item"))
    attempts = view(spark, sf, "fb_v").withColumn("items", F.expr(f"array({_PIECES})"))
    kept = feedback.retain_last_good(attempts, "person", F.col("value") >= 60, ["ts", "id"], ["look", "id"], "items", alive)
    return kept.select("person", "look", "id", F.array_join("items", ",").alias("items"), "retained")


_QUEUED = """
SELECT id, person FROM (SELECT *, lag(add) OVER (PARTITION BY person ORDER BY ts, id) AS before FROM (SELECT *, kind <> 'signup' AS add FROM fb_v WHERE kind IN ('click', 'view', 'signup')))
WHERE add AND NOT coalesce(before, false)"""


@query("enqueue_once", _QUEUED)
def enqueue_once(spark, sf):
    """Clicks and views queue a person, a signup finishes the work."""
    rows = view(spark, sf, "fb_v").where("kind IN ('click', 'view', 'signup')").select("id", "person", "ts", (F.col("kind") != "signup").alias("add"))
    return feedback.enqueue_once(rows, "person", "add", ["ts", "id"]).select("id", "person")


@query("enqueue_stream", _QUEUED)
def enqueue_stream(spark, sf):
    """The queue as a stream that remembers queued persons only, over several micro-batches."""
    def start(events):
        rows = events.where("event_type IN ('click', 'view', 'signup')").select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), "t", (F.col("event_type") != "signup").alias("add"))
        return jobs.enqueue_stream(rows, "person", "t", "id", "add", "1 day")

    return _replayed(spark, sf, ["event_id", "user_id", "event_type"], start)


@query("apply_tombstones", "SELECT id, person FROM fb_v WHERE person NOT IN (SELECT person FROM fb_v WHERE kind = 'error' AND value > 150)")
def apply_tombstones(spark, sf):
    events = view(spark, sf, "fb_v")
    return jobs.without_tombstones(events, events.where("kind = 'error' AND value > 150"), "person").select("id", "person")
