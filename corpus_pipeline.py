"""A corpus pipeline of five operators; each stage works on all that its predecessor kept.

Nulls and edges, for all stages: every column may be NULL; NULL and blank texts pass toxicity, near-dedup, decontamination and
personal data unchanged and give the mix no words; rows with a NULL doc_id pass near-dedup; of fully equal rows with words
near-dedup keeps one; an empty table gives an empty result; extra columns are kept by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidara.llm.common import shared_folder, table
from evidara.llm.op5_anchor_pii import without_personal_data
from evidara.llm.op7_mixing import mixed_blocks
from evidara.llm.op8_pigeonhole import without_leaks
from evidara.llm.op9_subword_toxicity import learn, without_toxic
from evidara.llm.op10_setsketch import without_near_duplicates


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among docs, doesn't reject."""
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: two-word shingles as in the operator's query, similarity 0.8."""
    return without_near_duplicates(docs, width=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return without_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: blocks of words by output shard and slot, with the documents that they are from."""
    return mixed_blocks(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: No SQL: the classifier, the sketches and the edit distances have none; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's documents are written as Parquet in the shared folder and read again by the next."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{root}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
