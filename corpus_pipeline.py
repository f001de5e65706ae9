"""A training corpus from raw documents: select, clean, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written and read again before
the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookweave.llm import decontam, linededup, neardup, packing, quality
from lookweave.llm.common import table
from lookweave.llm.queries import rating
from lookweave.session import materialize


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least good with a probability of one half or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), rating(), 2)
    return quality.select(docs, model, grade=1, least=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones (Jaccard .8 or more); documents that lose all their lines go."""
    return linededup.drop_lines(docs, linededup.first_lines(docs, percent=80), length="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group (five-word shingles, Jaccard .8 or more).

    Rows that repeat id and text count once; rows without id stay, as no group can name them.
    """
    groups = neardup.near_duplicates(docs, percent=80)
    gone = materialize(groups.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    single = left.join(repeated, "doc_id", "left_anti").select(docs.columns)
    several = left.join(repeated, "doc_id", "left_semi").select(docs.columns)
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality", select_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

# learned scores, signatures and token ids have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
