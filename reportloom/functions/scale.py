"""Shared shapes for skewed data: first row per key, and running totals in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of every key by ``order`` (nulls last).

    An aggregate, not a window: map tasks reduce a hot key to one row before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    parts = []
    for i, item in enumerate(order):
        value = F.col(item) if isinstance(item, str) else item
        parts += [value.isNull().alias(f"n{i}"), value.alias(f"v{i}")]
    best = F.min_by(F.struct(*rest), F.struct(*parts)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def first_places(df: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    """The first ``count`` rows of every key by ``order`` (unique in a key); map tasks send no more than that of a key."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") <= count).drop("_place")


def running_total(
    df: DataFrame, keys: list[str], position: str, values: dict[str, str], width: int = 1024
) -> DataFrame:
    """Sum of earlier rows of the same key for each column of ``values`` (column -> new name).

    ``position`` is a non-negative integer, unique per key. A key is cut into stretches of ``width``
    positions, so a key with very many rows spreads over many tasks; only stretch totals meet.
    """
    stretched = df.withColumn("_stretch", F.floor(F.col(position) / F.lit(width)).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "_stretch").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    totals = stretched.groupBy(*keys, "_stretch").agg(*[F.sum(c).alias(f"_t_{c}") for c in values])
    offsets = totals.select(
        *keys, "_stretch", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in values]
    )
    local = stretched.select(
        "*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_l_{c}") for c in values]
    )
    joined = local.join(offsets, [*keys, "_stretch"])
    return joined.select(
        *df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(new) for c, new in values.items()]
    )


def previous_values(
    df: DataFrame, keys: list[str], position: str, values: dict[str, str], width: int = 1024
) -> DataFrame:
    """Values of the row before, per key, in stretches of ``width`` positions as in ``running_total``."""
    row = F.struct(*[F.col(c) for c in values])
    stretched = df.withColumn("_stretch", F.floor(F.col(position) / F.lit(width)).cast("bigint"))
    by_stretch = Window.partitionBy(*keys).orderBy("_stretch")
    within = Window.partitionBy(*keys, "_stretch").orderBy(position)
    ends = stretched.groupBy(*keys, "_stretch").agg(F.max_by(row, F.col(position)).alias("_end"))
    carried = ends.select(*keys, "_stretch", F.lag("_end").over(by_stretch).alias("_carried"))
    joined = stretched.withColumn("_before", F.lag(row).over(within)).join(carried, [*keys, "_stretch"])
    found = F.coalesce("_before", "_carried")
    return joined.select(*df.columns, *[found.getField(c).alias(new) for c, new in values.items()])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rank from 1 within each key, computed over range partitions, so a large key needs no single task.

    Runs a job: the ranged rows are stored first, since their partition numbers must not change.
    """
    from reportloom.session import cut_lineage

    ranged = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (
        ranged.withColumn("_local", local).join(offsets, [*keys, "_part"])
        .select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))
    )
