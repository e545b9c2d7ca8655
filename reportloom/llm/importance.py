"""Importance resampling towards a target corpus by hashed word runs.

Every run of 1 to ``max_run`` words falls into the bucket of its CRC-32. A bucket's gain says how much more frequent it
is in the target than in the documents; a document's weight is the mean gain of its runs, and a Gumbel draw seeded by
its id added to the weight makes the highest scores a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.scale import ranked
from reportloom.llm.crc import crc32_spans
from reportloom.session import cut_lineage

_SLICE = 1 << 22
_CODES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
#: After lower-casing: digits, a-z, and every byte of a character beyond ASCII.
_IS_WORD = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)


def _bytes_and_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch and where each starts; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and length of every word, and the text it is from."""
    raw, bounds = _bytes_and_offsets(texts)
    data = _LOWER[raw]
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = _IS_WORD[data]
    opens, closes = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    opens[inner] |= word[1:-1][inner]
    closes[inner - 1] |= word[1:-1][inner - 1]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    return data, starts, lengths, np.searchsorted(bounds, starts, "right") - 1


def runs_of(texts: pa.Array, max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRC-32 of every run of n words of one text, joined by one space, and the text it is from; n from 1 to ``max_run``."""
    data, starts, lengths, owner = words_of(texts)
    if max_run > 1:
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        within = np.arange(int((lengths + 1).sum())) - np.repeat(begin, lengths + 1)
        place = np.repeat(starts, lengths + 1) + within
        spaced = np.append(data, np.uint8(32))[np.minimum(place, len(data))]
        spaced[begin + lengths] = 32
        data, starts = spaced, begin
    for n in range(1, max_run + 1):
        if len(starts) < n:
            return
        last = np.arange(n - 1, len(starts))
        whole = owner[last] == owner[last - n + 1]
        last = last[whole]
        first = last - n + 1
        yield crc32_spans(data, starts[first], starts[last] + lengths[last] - starts[first]), owner[first]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts begin within the same ``_SLICE`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // _SLICE
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, dtype=np.int64)
    for start, stop in zip(starts, np.append(starts[1:], len(group))):
        yield batch.slice(start, stop - start)


def bucket_counts(docs: DataFrame, buckets: int, max_run: int, text_col: str = "text") -> np.ndarray:
    """Number of runs of all texts in each bucket. Every task adds up its own, so at most ``buckets`` rows each meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for crc, _ in runs_of(part.column(0), max_run):
                    counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(counts[hit], pa.int64())], ["bucket", "n"])

    parts = docs.select(text_col).mapInArrow(run, "bucket bigint, n bigint")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the source)."""
    buckets, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t + 1) * float(all_s + buckets)) / (float(s + 1) * float(all_t + buckets))))
        for s, t in zip(source.tolist(), target.tolist())
    ], dtype=np.int64)


def _weighed(gains: np.ndarray, max_run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weighed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        words, features, total = (np.zeros(rows, dtype=np.int64) for _ in range(3))
        for n, (crc, owner) in enumerate(runs_of(batch.column(1), max_run), 1):
            count = np.bincount(owner, minlength=rows)
            features += count
            if n == 1:
                words = count
            so_far = np.append(0, np.cumsum(gains[crc % np.uint32(len(gains))]))
            stop = np.cumsum(count)
            total += so_far[stop] - so_far[stop - count]
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(a, pa.int64()) for a in (words, features, weight))],
            [batch.schema.names[0], "n_words", "n_features", "weight"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield weighed(part)

    return run


def gumbel(seed: str, key: Column) -> Column:
    """floor(1000 * a standard Gumbel draw), the same for equal keys; a null key reads as ``null``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, max_run: int = 1, buckets: int = 10_000, min_words: int = 20,
    seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row for every row of ``docs``: id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (null: not drawn).

    Drawn are floor(percent * N / 100) of the N rows with at least ``min_words`` words, by falling score, ties to the
    smaller id (nulls first), then to the row read first, so repeated rows have ranks of their own. A null or empty text
    has no word, weight 0 and is never drawn; an empty target or table only smooths. Other columns are not read. Both
    tables are read whole, ``docs`` twice; only bucket counts (``buckets`` rows) reach the driver. Runs jobs.
    """
    source = bucket_counts(docs, buckets, max_run, text_col)
    gains = bucket_gains(source, bucket_counts(target, buckets, max_run, target_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    weighed = docs.select(id_col, text_col).mapInArrow(
        _weighed(gains, max_run), f"{id_col} {id_type}, n_words bigint, n_features bigint, weight bigint"
    )
    scored = cut_lineage(weighed.select("*", (F.col("weight") + gumbel(seed, F.col(id_col))).alias("score")))
    fit = F.col("n_words") >= min_words
    wanted = scored.filter(fit).count() * percent // 100
    order = scored.filter(fit).withColumns({"_fall": -F.col("score"), "_read": F.monotonically_increasing_id()})
    placed = ranked(order, [], ["_fall", id_col, "_read"], "place").select(
        *scored.columns, F.when(F.col("place") <= wanted, F.col("place")).cast("bigint").alias("rank")
    )
    return placed.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("bigint")))
