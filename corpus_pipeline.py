"""Training-data pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

``ORACLE_SQL`` is None: language identification, mixing after it and BPE have no SQL form;
``tests/llm/test_pipeline_rows.py`` compares the rows of ``run`` with a plain Python version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reportloom.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from reportloom.llm.common import read
from reportloom.llm.queries import learnable, tokenizer_path
from reportloom.session import shared_folder

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without a letter go."""
    return language_id.in_known_language(docs, language_id.fit(learnable(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts, the one with the largest doc_id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a similarity of 0.8 or more, the one with the smallest doc_id."""
    return near_dedup.without_near_copies(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, shuffled."""
    return mixing.mix_sources(docs, power=0.5, seed=10).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the decoded text."""
    return bpe.tokenize(docs, tokenizer_path(), outputs=("ids",))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Every stage but the last is stored in the shared folder of the session."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
