"""Whitening of embeddings: leading principal components of quantised vectors, scaled to unit variance.

Centred rows are reduced by blockwise QR to one triangular matrix, which has their covariance and their singular
values; ``bidiagonal`` gives its values and directions. No matrix product of the rows with themselves is formed, so
small variances keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reportloom.llm.bidiagonal import leading
from reportloom.session import cut_lineage

_HALF = 1 << 32
_FAN_IN_BYTES = 1 << 28  # triangles that one task joins
_NO_VARIANCE = 1e-13  # share of the largest eigenvalue, for each dimension, that rounding alone can give

Batches = Iterator[pa.RecordBatch]


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, floor(scale * c) of each component in double, of the rows that take part.

    Rows whose vector is null or has a null, NaN or infinite component take no part. Values beyond 64 bits saturate.
    """
    finite = ~F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    return vectors.filter(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def column_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension, added as two halves so that no total overflows."""

    def run(batches: Batches) -> Batches:
        n, high, low = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            high += (x // _HALF).sum(axis=0)
            low += (x % _HALF).sum(axis=0)
        columns = [np.arange(dims, dtype=np.int64), np.full(dims, n, dtype=np.int64), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "dim bigint, n bigint, high bigint, low bigint")
    totals = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    sums = [0] * dims
    for row in totals:
        sums[row["dim"]] = row["high"] * _HALF + row["low"]
    return (totals[0]["n"] if totals else 0), sums


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the centred rows. Every task folds its rows into one triangle; triangles fold in a tree."""
    dims = len(mean)
    schema = "part bigint, r binary"

    def fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        return np.vstack([r, np.zeros((dims - len(r), dims))])

    def run(batches: Batches) -> Batches:
        r, seen = np.zeros((dims, dims)), False
        for batch in batches:
            rows = _matrix(batch.column(0), dims) - mean
            for start in range(0, len(rows), 4 * dims + 64):
                r, seen = fold(r, rows[start : start + 4 * dims + 64]), True
        if seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((dims, dims))
        for data in frame.sort_values("part")["r"]:
            r = fold(r, np.frombuffer(data).reshape(dims, dims))
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // fan_in], "r": [r.tobytes()]})

    fan_in = int(max(2, min(16, _FAN_IN_BYTES // (8 * dims * dims))))
    parts, left = fit.select("x").mapInArrow(run, schema), fit.rdd.getNumPartitions()
    while left > 1:
        parts, left = parts.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(join, schema), -(-left // fan_in)
    found = parts.first()
    return np.zeros((dims, dims)) if found is None else np.frombuffer(found["r"]).reshape(dims, dims)


def _identity_error(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray], n: int, k: int) -> float:
    """Largest entry of |covariance of the whitened fit rows - identity|, measured on the rows."""

    def run(batches: Batches) -> Batches:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = project(_matrix(batch.column(0), batch.column(0).value_lengths()[0].as_py()))
            total += z.sum(axis=0)
            square += z.T @ z
        cells = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    parts = fit.select("x").mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.zeros(k + k * k)
    for row in parts.collect():
        cells[row["cell"]] = row["value"]
    mean = cells[:k] / n
    return float(np.abs(cells[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where it is beyond 64 bits."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if largest * largest * max(1, len(sums)) < 1 << 63:
        apart = n * x - np.array(sums, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``id_col``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    One row for every row of ``quantised`` and each of the leading ``components`` (all, if there are fewer dimensions).
    Everything is fitted on the distinct vectors, ``n`` of them, so copies weigh nothing; equal vectors have equal
    results, and repeated or null ids stay as they are. A component whose variance is nothing but rounding has a null
    ``whitened``; with one distinct vector ``explained`` and ``identity_error`` are null too. Vectors of another length
    than the most frequent one (ties: the longer) and empty vectors take no part. A deviation beyond 64 bits is null.
    Other columns are not read. The driver holds matrices of dimensions by dimensions, whatever the rows. Runs jobs.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"{id_col} {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    rows = quantised(vectors, scale, id_col, vector_col).filter(F.size("x") > 0)
    common = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = common["dims"]
    rows = rows.filter(F.size("x") == dims)
    fit = cut_lineage(rows.select("x").distinct())
    n, sums = column_sums(fit, dims)
    mean = np.array([s / n for s in sums])
    squares, directions = leading(triangle(fit, mean), components)
    values, trace = squares / n, float(squares.sum() / n)
    k = directions.shape[1]
    # Rounding of the mean alone moves every centred entry by its last digit.
    floor = max(_NO_VARIANCE * dims * float(values[0]), float(dims * (np.abs(mean).max() * 4e-16) ** 2))
    usable = int((values[:k] > floor).sum())
    weights = directions[:, :usable] / np.sqrt(values[:usable])
    error = _identity_error(fit, lambda x: (x - mean) @ weights, n, usable) if usable else None
    explained = [float(v) / trace if usable else None for v in values[:k]]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            m = len(x)
            z = np.full((m, k), np.nan)
            z[:, :usable] = (x - mean) @ weights
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                    deviation, pa.array(z.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
