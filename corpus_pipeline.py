"""Corpus pipeline: the stages, each of which works on what the one before kept.

All but the last return the columns of their input and only leave out rows.
Nulls, empty texts and repeated rows are handled as the operators say: a null
text is an empty one, rows with null ids take part, equal rows share their fate
except that near-dedup keeps one of a group.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from vqspark.lineage import remove, shared_dir
from vqspark.llm import leaks, mixing, nearsets, toxicity
from vqspark.llm.keymap import fresh


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold stay. It learns from the labelled ones among them that aren't held out; empty texts score its bias."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "toxicity_score")
    scored = toxicity.score(docs, model, keep=docs.columns, name=name)
    return scored.where(scored[name] < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are alike to 0.8 or more, the one with the smallest id stays; empty texts are one group."""
    return nearsets.keep_one_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay; null and empty ones hold none."""
    return leaks.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights, with these weights; rows of one id are sampled together."""
    return mixing.mix(docs).where("mix_sampled").drop("mix_sampled")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", without_leaks),
    ("source mix", source_mix),
]
#: The classifier can't be written in SQL; the tests hold the stages against plain computations.
ORACLE_SQL = None


def _leave(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session is still there
        remove(spark, folder)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is a written table in the shared folder.

    A table is removed when the next one is written; the one that the result is
    read from stays until the driver's program ends.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    atexit.register(_leave, spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
