"""Five stages from raw documents to a mix: quality, lines, near copies, benchmark leaks, target weights.

Each stage takes what the one before it kept and returns a DataFrame; ``run`` writes every stage as Parquet into the
folder that the session shares and reads it again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, lines, mixing, quality, simhash
from tickloom.session import shared_folder, tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the marked ones among them, does not reject."""
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, [F.struct(*docs.columns).alias("row")], F.col("text"))
    return scored.where("predicted = 1").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur elsewhere; those of which nothing is left go."""
    return lines.drop_lines(docs)


def copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, words=5, form=simhash.similar(0.8))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", copy_stage),
    ("benchmark decontamination", leak_stage),
    ("source mixing", mix_stage),
]

# XXH64, ridge scores and edit distances have no SQL twin; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's files go once the next stage is written."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    docs, before = _table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            target = hadoop(before)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        before = path
    return docs
