"""Scans of the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportloom.schemas import MODEL_TABLES


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Model table ``name`` under ``root`` with its fixed schema (no inference)."""
    return spark.read.schema(MODEL_TABLES[name]).format(fmt).load(f"{root}/{name}")


def read_knowledge_items(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge items for bulk loading, as JSON lines."""
    return spark.read.schema(
        "domain string, category string, title string, content string, tags array<string>, "
        "related_metrics array<string>, source string"
    ).json(path)
