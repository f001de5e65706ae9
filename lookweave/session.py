"""Session helpers: a local session for tests and benches, and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = 8, app: str = "lookweave", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session.  On a cluster the caller brings its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder; a cluster without a
    shared folder is an error, because a machine-local path would not survive an executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lookweave-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and read it back.

    A written table survives lost executors like a checkpoint, and its file sizes let the
    planner broadcast it when it is small enough and prune its columns.
    """
    path = shared_folder(df.sparkSession, "stage")
    for stages in _OPEN:
        stages.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OPEN: list[list[str]] = []  # written stages of the scratch blocks that are open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stages that are written within the block are deleted at its end.

    The block gets a function that writes a DataFrame as a stage that stays; what is returned from the block must be
    read from such stages alone.
    """
    stages: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        written = materialize(df)
        kept.add(stages[-1])
        return written

    _OPEN.append(stages)
    try:
        yield keep
    finally:
        _OPEN.remove(stages)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in stages:
            if path not in kept:
                folder = jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)
