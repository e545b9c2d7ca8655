"""Shared shapes of the operators: stored steps, joins that split a hot key, plain columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportloom.session import cut_lineage

_BROADCAST_KEYS = 1_000_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join every row with the one row of its group.

    ``groups`` is stored first (runs a job). Both sides of the join are then plain shuffles, so adaptive execution can
    split a group that holds a large part of all rows; straight from an aggregate it could not.
    """
    return rows.join(cut_lineage(groups), keys, how)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def told_apart(docs: DataFrame, id_col: str, nulls_first: bool) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column without nulls or repeats, in the order of the ids.

    That is ``id_col`` itself where it has neither. Else all rows are sorted by id, then by a digest of the whole row, and
    stored once with their number in a column of a name that is free, so that every row is decided on its own. Runs jobs.
    """
    unfit = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1 or id is null")
    if unfit.isEmpty():
        return docs, id_col
    by_id = F.col(id_col).asc_nulls_first() if nulls_first else F.col(id_col).asc_nulls_last()
    ordered = docs.orderBy(by_id, F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    number = free_name(docs, "_row")
    return cut_lineage(ordered.withColumn(number, F.monotonically_increasing_id())), number


def without_rows(docs: DataFrame, key: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of ``docs`` whose ``key`` is not in the only column of ``gone``.

    ``gone`` is stored first (runs a job). Up to a million keys are broadcast, so the rows stay in their place; more are joined.
    """
    name = free_name(docs, "_gone")
    named = cut_lineage(gone.toDF(name))
    if named.count() <= _BROADCAST_KEYS:
        named = F.broadcast(named)
    return docs.join(named, docs[key] == named[name], "left_anti").select(*columns)


def unit_interval(seed: int, *parts: Column) -> Column:
    """Uniform double in [0, 1) from an MD5 of the seed and the parts; nulls read as ``null``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
