"""Exact top-k inner products with a pivot-distance index.

An extra component makes all vectors equally long, so that the largest inner product is the smallest distance. Every
vector is keyed by its nearest pivot and its distance from it and stored in that order; a run of the order is an annulus.
By the triangle inequality a query's distance from an annulus is at least its distance from the pivot less the outer
radius, or the inner radius less that distance. Annuli are expanded from the least bound on, some more each round; a query
is sent only to those of the round whose bound admits a score as good as its k-th best so far, and stops when none is left.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window, functions as F

from reportloom.session import cut_lineage

_LOG = logging.getLogger(__name__)
_MOST_ANNULI = 65_536  # beyond, the parts of the index grow instead
_FIRST, _GROWTH = 8, 8  # annuli of the first round, and how many times more each later one has
_SLICE = 1 << 21  # bounds computed at a time
_SLACK = 1e-6  # of the squared lengths, far above the rounding of doubles


def quantized(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``z`` = floor(scale * x) in doubles, and its length ``dim``; without rows that take no part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    z = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("double"))
    valid = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return rows.filter(valid).select(F.col(id_col).alias("id"), z.alias("z"), F.size(vector_col).alias("dim"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _lifted(z: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack((z, np.sqrt(np.maximum(0.0, longest - (z * z).sum(1)))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """k-means centres of a sample, started at evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(sample, centres).argmin(1)
        for i in np.unique(nearest):
            centres[i] = sample[nearest == i].mean(0)
    return centres


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as integers, exact: in doubles where these hold every sum, else in Python integers cut to 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return np.array([[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a], np.int64).reshape(len(a), len(b))


def _below(floor: np.ndarray) -> np.ndarray:
    """What a score must reach; a floor beyond 53 bits may have been rounded up."""
    return floor - np.where(np.isfinite(floor), np.abs(floor), 0.0) * 2.0**-52


def admitted(
    q: np.ndarray, floor: np.ndarray, annuli: np.ndarray, centres: np.ndarray, longest: float, start: int, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``q``, row of ``annuli``) that may hold a score of ``floor`` or more.

    ``annuli`` has pivot, inner and outer radius. Only the places ``start`` to ``start + width`` of a query's order of
    bounds are tried.
    """
    rows, found = [np.empty(0, int)], [np.empty(0, int)]
    own = annuli[:, 0].astype(int)
    step = max(1, _SLICE // max(1, len(annuli)))
    for first in range(0, len(q), step):
        some = q[first:first + step]
        away = _distances(np.column_stack((some, np.zeros(len(some)))), centres)[:, own]
        bound = np.maximum(0.0, np.maximum(away - annuli[:, 2], annuli[:, 1] - away))
        order = np.argsort(bound, axis=1, kind="stable")[:, start:start + width]
        bound = np.take_along_axis(bound, order, 1)
        sizes = (some * some).sum(1)[:, None] + longest
        most = (sizes - bound * bound) / 2 + _SLACK * sizes + 1
        i, j = np.nonzero(most >= floor[first:first + step, None])
        rows.append(i + first)
        found.append(order[i, j])
    return np.concatenate(rows), np.concatenate(found)


def top_inner_products(
    rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int = 64, sample_rows: int = 4096,
    part_rows: int = 1024, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score``: the ``k`` best of each query among all rows but its own.

    Queries are the rows whose id is divisible by ``every``. Components are floor(``scale`` * x); the score is their
    inner product, ties go to the smaller id. Rows with a null id, a null vector or a null or non-finite component take
    no part; vectors of different length are not compared; an id that occurs twice asks once and is no candidate of its
    own. Pivots and first bounds come from at most ``sample_rows`` rows by hash; every row is indexed, the result is
    exact. An annulus has about ``part_rows`` rows at most (more beyond 65,536 annuli, whose radii every task knows) and
    is sent once for each ``query_rows`` queries that its bound admits. Scores beyond 64 bits are cut. Runs jobs.
    """
    spark = rows.sparkSession
    valid = cut_lineage(quantized(rows, scale, id_col, vector_col))
    dims = [r["dim"] for r in valid.groupBy("dim").count().orderBy("dim").collect()]
    out = None
    for dim in dims:
        found = _search(valid.filter(F.col("dim") == dim).drop("dim"), every, k, pivots, sample_rows, part_rows, query_rows)
        out = found if out is None else out.union(found)
    if out is None:
        kind = rows.schema[id_col].dataType.simpleString()
        out = spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score bigint")
    return out.withColumnRenamed("id", id_col)


def _search(valid: DataFrame, every: int, k: int, pivots: int, sample_rows: int, part_rows: int, query_rows: int) -> DataFrame:
    spark = valid.sparkSession
    kind = valid.schema["id"].dataType.simpleString()
    square = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    facts = valid.agg(F.count("*").alias("n"), F.max(square).alias("longest")).first()
    n, longest = facts["n"], facts["longest"]
    share = min(1.0, 0.8 * sample_rows / n)
    place = (F.xxhash64("z").cast("double") / F.lit(float(1 << 63)) + 1.0) / 2.0
    sample = valid.filter(place <= share).select("id", "z").limit(sample_rows).toPandas() if n else None
    if sample is None or not len(sample):
        sample = valid.select("id", "z").limit(sample_rows).toPandas()
    sampled = _matrix(sample["z"])
    centres = fit_pivots(_lifted(sampled, longest), pivots)
    shared = spark.sparkContext.broadcast((centres, sampled, sample["id"].to_numpy(), longest))

    def key(batches):
        centres, _, _, longest = shared.value
        for batch in batches:
            away = _distances(_lifted(_matrix(batch["z"]), longest), centres)
            nearest = away.argmin(1)
            yield pd.DataFrame({"id": batch["id"], "z": batch["z"], "pivot": nearest, "distance": away[np.arange(len(batch)), nearest]})

    keyed = valid.select("id", "z").mapInPandas(key, f"id {kind}, z array<double>, pivot int, distance double")
    parts = max(1, min(_MOST_ANNULI, -(-n // part_rows)))
    index = cut_lineage(keyed.repartitionByRange(parts, "pivot", "distance", "id").withColumn("part", F.spark_partition_id()))
    radii = index.groupBy("part", "pivot").agg(F.min("distance").alias("inner"), F.max("distance").alias("outer")).orderBy("part", "pivot").toPandas()
    annuli = radii[["pivot", "inner", "outer"]].to_numpy(float)
    places = spark.sparkContext.broadcast(annuli)
    seats = spark.createDataFrame(radii[["part", "pivot"]].assign(annulus=range(len(radii))), "part int, pivot int, annulus int")
    index = cut_lineage(index.join(seats, ["part", "pivot"]).select("annulus", "id", "z"))

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th best of the sample is a first bound: the true k-th best is no worse."""
        _, sampled, sampled_ids, _ = shared.value
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.iloc[first:first + 256]
                scores = _products(_matrix(batch["z"]), sampled).astype(float)
                scores[batch["id"].to_numpy()[:, None] == sampled_ids[None]] = -np.inf
                floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(batch), -np.inf)
                yield batch.assign(floor=floor)

    def meet(start: int, width: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, _, _, longest = shared.value
            for whole in batches:
                for first in range(0, len(whole), 256):
                    batch = whole.iloc[first:first + 256]
                    rows, found = admitted(
                        _matrix(batch["z"]), _below(batch["floor"].to_numpy()), places.value, centres, longest, start, width
                    )
                    for some in range(0, len(rows), 4096):
                        yield batch.iloc[rows[some:some + 4096]].assign(annulus=found[some:some + 4096])

        return run

    def search(part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        q_ids, ids, z = queries["id"].to_numpy(), part["id"].to_numpy(), _matrix(part["z"])
        got: list[tuple] = []
        for first in range(0, len(queries), 256) if len(part) else ():
            some = slice(first, first + 256)
            scores = _products(_matrix(queries["z"].iloc[some]), z)
            hits = (scores >= _below(queries["floor"].to_numpy()[some])[:, None]) & (ids[None] != q_ids[some][:, None])
            for i in np.flatnonzero(hits.any(1)):
                s, x = scores[i][hits[i]], ids[hits[i]]
                best = np.lexsort((x, -s))[:k]
                got.append((np.repeat(q_ids[first + i], best.size), x[best], s[best]))
        columns = [np.concatenate(c) for c in zip(*got)] if got else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), columns)))

    asked = index.filter(F.col("id") % every == 0).dropDuplicates(["id"]).select("id", "z")
    asked = cut_lineage(asked.mapInPandas(seed, f"id {kind}, z array<double>, floor double"))
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = spark.createDataFrame([], f"query_id {kind}, id {kind}, score bigint, rank int")
    start, width = 0, _FIRST
    while start < len(annuli):
        pairs = cut_lineage(asked.mapInPandas(meet(start, width), f"id {kind}, z array<double>, floor double, annulus int"))
        sent = pairs.count()
        _LOG.info("annuli %d to %d: %d pairs", start, start + width, sent)
        if not sent:
            break
        blocks = pairs.groupBy("annulus").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("blocks"))
        blocks = cut_lineage(blocks)
        left = index.join(blocks, "annulus").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = pairs.join(blocks, "annulus").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        found = left.select("annulus", "block", "id", "z").groupBy("annulus", "block").cogroup(
            right.select("annulus", "block", "id", "z", "floor").groupBy("annulus", "block")
        ).applyInPandas(search, f"query_id {kind}, id {kind}, score bigint")
        best = found.union(best.drop("rank")).withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
        best = cut_lineage(best)
        start, width = start + width, width * _GROWTH
        if start < len(annuli):
            floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("last"))
            raised = F.greatest("floor", F.coalesce("last", "floor"))
            asked = cut_lineage(asked.join(floors, "id", "left").select("id", "z", raised.alias("floor")))
    return best.select("query_id", "rank", "id", "score")
