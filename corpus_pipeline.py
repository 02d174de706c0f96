"""The corpus pipeline: language ID, near duplicates, decontamination, PII, mixing.

Each stage is a function of (spark, docs, sf_dir) and applies one operator of
``refsieve.llm`` to everything its predecessor kept:

1. ``language_id`` drops documents that the model rejects: no letter, or a
   calibrated score below the threshold.
2. ``near_duplicates`` keeps the document of the least id of each group of
   5-word shingle sets linked at a Jaccard similarity of 0.8 or more.
3. ``decontaminate`` drops documents that hold 10 consecutive words of a
   benchmark item (or a whole shorter item).
4. ``redact_pii`` replaces personal data in the text; all documents stay.
5. ``mix_sources`` samples documents by raked source, language and topic
   weights; it adds ``mix_topic`` and ``mix_weight``.

All but the last return the columns of their input. Nulls, empty texts,
repeated rows, empty tables and extra columns are treated as the operators'
docstrings say. Stages 1 and 2 train on, or iterate over, the documents, which
SQL cannot express, so ``ORACLE_SQL`` is None and tests compare ``run`` with a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from refsieve.llm import decontam, langid, mixing, neardup, pii
from refsieve.llm.common import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
