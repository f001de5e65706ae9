"""Keyed tables and guarded outputs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import number_rows


def upsert_latest(changes: DataFrame, key: str, order: Sequence[str], values: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """Latest row per key; keys whose latest change is a delete are gone."""
    gone = F.lit(False) if deleted is None else deleted
    latest = F.max_by(F.struct(*values, gone.alias("_gone")), F.struct(*order))
    return changes.groupBy(key).agg(latest.alias("v")).select(key, "v.*").where(~F.col("_gone")).drop("_gone")


def pending_batches(items: DataFrame, completed: DataFrame, key: str, source: str, order: Sequence[str], size: int = 4) -> DataFrame:
    """Work left over, in batches of ``size`` per source and in the given order."""
    left = items.join(completed.select(key).distinct(), key, "left_anti")
    return number_rows(left, [F.col(c) for c in order], "n", [source]).withColumn("batch", F.floor((F.col("n") - 1) / size)).drop("n")


class PublishError(RuntimeError):
    """A staged table failed its checks; the published one is untouched."""


def check_report(frame: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per named check: passed or not.  ``checks`` are aggregate conditions."""
    row = frame.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in checks])).alias("r")).select("r.*")


def publish(frame: DataFrame, root: str, checks: dict[str, Column]) -> str:
    """Write a new version under ``root``, check what was written, then add a pointer to it.

    Pointers only ever add up and readers follow the one with the largest number, so a failed version never shows and
    there is no moment without a published one.
    """
    spark = frame.sparkSession
    version = f"{root}/v-{uuid.uuid4().hex}"
    frame.write.parquet(version)
    failed = [r["check"] for r in check_report(spark.read.parquet(version), checks).where("NOT passed").collect()]
    if failed:
        raise PublishError(", ".join(failed))
    last = _pointer(spark, root)
    pointer = spark.createDataFrame([(last["number"] + 1 if last else 1, version)], _POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{root}/pointers")
    return version


_POINTER = "number long, path string"


def _pointer(spark, root: str):
    """The newest complete pointer, if any."""
    try:
        rows = spark.read.schema(_POINTER).json(f"{root}/pointers")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("number"), "path").first()


def read_published(spark, root: str) -> DataFrame:
    return spark.read.parquet(_pointer(spark, root)["path"])


def write_report(rows: DataFrame, root: str, run_id: str) -> None:
    """Report rows as JSON lines, one folder per run."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(root)


_SIDECAR = "run_id string, query string, address string, model string, started timestamp, finished timestamp, measures map<string,double>"


def write_observed(rows: DataFrame, root: str, run_id: str, query: str, address: str, model: str, measures: dict[str, Column]) -> dict[str, float]:
    """Report rows of one run as JSON lines by run and query, and a sidecar that says where they come from.

    ``measures`` are aggregates that Spark observes while it writes the rows, so they count what was written and the rows are
    computed once.  The sidecar has the run's query, address, model, times in UTC and measures; it is written last, so a run
    without one did not end.
    """
    spark = rows.sparkSession
    seen = Observation(f"report-{uuid.uuid4().hex}")
    started = datetime.now(timezone.utc)
    watched = rows.withColumns({"run_id": F.lit(run_id), "query": F.lit(query)}).observe(seen, *[c.cast("double").alias(n) for n, c in measures.items()])
    watched.write.mode("append").partitionBy("run_id", "query").json(f"{root}/rows")
    found = dict(seen.get)
    sidecar = spark.createDataFrame([(run_id, query, address, model, started, datetime.now(timezone.utc), found)], _SIDECAR)
    sidecar.coalesce(1).write.mode("append").json(f"{root}/runs")
    return found


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The sidecars of all runs that ended."""
    return spark.read.schema(_SIDECAR).json(f"{root}/runs")


def read_report(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows (of ``schema``) of the runs that ended, with their run and query."""
    rows = spark.read.schema(f"{schema}, run_id string, query string").json(f"{root}/rows")
    return rows.join(read_runs(spark, root).select("run_id", "query").distinct(), ["run_id", "query"], "left_semi")
