"""Streams with state: several micro-batches, expiry, late rows."""

import pytest
from pyspark.sql import functions as F

from lookweave.streaming import jobs

SECOND = 1_000_000
START = 10_000 * SECOND  # a watermark starts at zero


def replay(spark, folder, schema, batches, make):
    """Run the stream once per batch from its checkpoint; all it wrote."""
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("t", F.col("t") + START).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        with jobs.timed_state(spark):
            run = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
        run.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]


def keys_held(spark, folder, name):
    rows = spark.read.format("statestore").option("path", f"{folder}/ckpt").option("stateVarName", name).load()
    return sorted({r["key"]["user"] for r in rows.select("key").collect()})


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "s")


def test_budget_over_batches(spark, folder):
    """Three requests a minute; a client is forgotten a window after its last request, and late rows get no answer."""
    schema = "id long, user long, t long"
    batches = [[(i, 1, t * SECOND) for i, t in enumerate([0, 1, 2, 59])] + [(100, 2, 5 * SECOND)], [(10, 1, 60 * SECOND), (11, 1, 61 * SECOND), (12, 1, 62 * SECOND)],
               [(20, 3, 500 * SECOND)], [(30, 3, 501 * SECOND), (31, 4, 100 * SECOND)], [(40, 3, 900 * SECOND)]]
    got = replay(spark, folder, schema, batches, lambda s: jobs.admission_stream(s, "user", "t", "id", 60, 3))
    admitted = {r[0]: r[2] for r in got}
    assert [admitted[i] for i in (0, 1, 2, 3, 10, 11, 12)] == [True, True, True, False, False, True, True]
    assert admitted[100] and admitted[20] and admitted[30] and 31 not in admitted  # 31 came 400 seconds late
    assert keys_held(spark, folder, "times") == [3]


def test_queue_over_batches(spark, folder):
    schema = "id long, user long, t long, add boolean"
    batches = [[(1, 1, 1, True), (2, 1, 2, True), (3, 2, 3, True)], [(4, 1, 4, True), (5, 1, 5, False), (6, 1, 6, True), (7, 3, 6, False)], [(8, 2, 8, False), (9, 1, 9, True)]]
    got = replay(spark, folder, schema, batches, lambda s: jobs.enqueue_stream(s, "user", "t", "id", "add", "1 hour"))
    assert sorted(r[0] for r in got) == [1, 3, 6]
    assert keys_held(spark, folder, "queued") == [1]
