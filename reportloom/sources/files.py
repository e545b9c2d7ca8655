"""File inventory with content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_inventory(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files below ``path`` with folder, name and the first 12 hex digits of their MD5."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(
        "path",
        F.element_at(parts, -2).alias("folder"),
        F.element_at(parts, -1).alias("name"),
        F.substring(F.md5("content"), 1, 12).alias("md5_12"),
    )
