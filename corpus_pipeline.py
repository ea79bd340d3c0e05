"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes what its predecessor wrote; all but the last return the columns of
documents. Null, empty and repeated rows follow the operators' own docstrings: texts
without a letter go at the first stage, one row of equal texts stays at the second.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayframe.llm import decontaminate, exact_dedup, langid, packing, simhash
from wayframe.llm.common import shared_folder, table

#: Five-word shingle similarity from which texts are near copies.
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.one_per_text(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, similarity=SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("packing", packed)]

#: The stages' models, fingerprints and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
