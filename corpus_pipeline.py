"""A corpus pipeline of five stages over the documents table; each stage's result is written and read again before the next.

Defined cases, for every stage: a null or empty text is a text without words; rows with a null id stay unless their text is rejected; repeated rows
are rows of their own, except that the near-dedup stage keeps one; an empty table gives an empty result; columns other than those of documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfern.llm import decontam, piece_sampling, quality_fm, secret_scan, simhash
from quillfern.llm.common import DOCUMENT_COLUMNS, drop_stash, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. It is trained on the labels of the documents given."""
    machine = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.keep_good(docs.select(*DOCUMENT_COLUMNS), machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id. Groups are linked by five-word shingles at Jaccard similarity 0.8 or more."""
    return simhash.keep_one(docs.select(*DOCUMENT_COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontam.keep_clean(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    model = secret_scan.train_forest(secret_scan.labelled_findings(spark))
    return secret_scan.redact(docs.select(*DOCUMENT_COLUMNS), model)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text that is left."""
    return piece_sampling.sample_digests(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("tokenize", tokenize)]

#: SQL can't express the trained models, the tokenizer's lattice or XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table, in order."""
    docs, used = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if used is not None:
            drop_stash(used)  # the next stage's result is written, so its input is done with
        used = docs
    return STAGES[-1][1](spark, docs, sf_dir)
