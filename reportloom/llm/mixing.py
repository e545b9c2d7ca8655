"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import free_name, unit_interval
from reportloom.session import cut_lineage

_PIECE = 16.0  # a larger mean is the sum of draws of this mean at most, so exp(-mean) keeps its precision
_BROADCAST_SOURCES = 100_000


def poisson(mean: Column, u: Column) -> Column:
    """Poisson count by inversion of ``u``; 12 deviations and 24 steps above the mean reach past the last double."""
    last = F.ceil(mean + 12 * F.sqrt(mean)).cast("int") + 24
    p = F.exp(-mean)
    start = F.struct(p.alias("p"), p.alias("below"), F.lit(0).cast("bigint").alias("count"))

    def step(acc: Column, k: Column) -> Column:
        p_k = acc["p"] * mean / k
        return F.struct(
            p_k.alias("p"), (acc["below"] + p_k).alias("below"),
            F.when(u >= acc["below"], k.cast("bigint")).otherwise(acc["count"]).alias("count"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["count"])


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, budget: float = 1.0,
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``source`` and ``rate``, the mean number of copies of each of its documents.

    A source has the size of its texts in UTF-8 bytes, one more for each document. Its target share is its weight over
    the sum of the weights of sources that occur; a source without a weight has share 0. Without ``weights`` the weight
    is size to the ``power``. The mixture has ``budget`` times the size of the input. A null source is one of its own.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint") + 1
    sizes = cut_lineage(docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()) or [(None, 0.0)], "source string, weight double")
        weighted = sizes.join(F.broadcast(given), "source", "left").fillna(0.0, ["weight"])
    totals = weighted.agg(F.sum("weight").alias("weights"), F.sum("size").cast("double").alias("bytes")).first()
    all_weights, all_bytes = totals["weights"] or 0.0, totals["bytes"] or 0.0
    if all_weights <= 0:
        return weighted.select("source", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(all_weights)
    return weighted.select("source", (share * F.lit(budget * all_bytes) / F.col("size")).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, budget: float = 1.0, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Every document as often as its Poisson count says, in globally random order.

    Adds ``copy`` (from 1), ``copies`` and ``order_key``; columns of these names are replaced. The count inverts a
    Poisson distribution whose mean is the rate of the source, seeded by an MD5 of ``seed``, the id and the draw, so rows
    with the same id and source have the same count and a rerun gives the same mixture. Rows with count 0 are left out:
    that is how a source gets less than its share. The copies are shuffled by ``order_key``, a hash, and sorted by it in
    every partition. Runs jobs to size the sources.
    """
    kept = [c for c in docs.columns if c not in ("copy", "copies", "order_key")]
    its_source, its_rate = free_name(docs, "_mix_source"), free_name(docs, "_mix_rate")
    rates = cut_lineage(source_rates(docs, weights, power, budget, source_col, text_col)).select(
        F.col("source").alias(its_source), F.col("rate").alias(its_rate)
    )
    if rates.count() <= _BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rated = docs.join(rates, docs[source_col].eqNullSafe(F.col(its_source)))
    draws = F.greatest(F.lit(1), F.ceil(F.col(its_rate) / F.lit(_PIECE))).cast("int")
    mean = F.col(its_rate) / draws
    count = F.aggregate(
        F.sequence(F.lit(1), draws), F.lit(0).cast("bigint"),
        lambda total, draw: total + poisson(mean, unit_interval(seed, docs[id_col], draw)),
    )
    counted = rated.select(*[docs[c] for c in kept], count.alias("copies")).filter("copies > 0")
    copies = counted.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    text = F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string"))
    return copies.withColumn("order_key", F.md5(text)).repartition("order_key").sortWithinPartitions("order_key")
