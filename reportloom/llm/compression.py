"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A text that compresses far better than prose of its length repeats itself; one that hardly compresses is noise, encoded
data or a list of random strings. How well prose compresses depends on its length, so every band of lengths has its own
limits. A long text is also cut into chunks of a fixed size, which shows bad parts that the whole hides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame

#: From this many UTF-8 bytes on: the least and the greatest ratio of size to compressed size that passes.
BANDS: list[tuple[int, float, float]] = [
    (0, 0.0, 1e9),
    (128, 0.95, 2.4),
    (256, 1.1, 2.8),
    (512, 1.25, 3.2),
    (2048, 1.4, 4.0),
    (8192, 1.5, 5.0),
    (65536, 1.6, 6.0),
]
CHUNK_BAND = (1.35, 4.5)

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_FIRST = bytes(range(0x80, 0xC0))  # bytes of a code point after its first

FACTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, reason string"
)


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules. ``level`` is that of zstandard; a text fails when over ``chunk_share`` of its chunks do."""

    bands: tuple[tuple[int, float, float], ...] = tuple(BANDS)
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = CHUNK_BAND
    chunk_share: float = 0.2
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur more than once in the text, the first occurrence included."""
    if len(words) <= width:
        return 0
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    windows = codes[: len(codes) - width + 1]
    for shift in range(1, width):
        nxt = codes[shift : len(codes) - width + 1 + shift]
        windows = pd.factorize(windows * (int(codes.max()) + 1) + nxt)[0].astype(np.int64)
    twice = np.bincount(windows)[windows] > 1
    inside = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(inside, np.flatnonzero(twice), 1)
    np.add.at(inside, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _outside(ratio: float, low: float, high: float) -> str | None:
    return "incompressible" if ratio < low else "repetitive" if ratio > high else None


class Judge:
    """Facts of one text after another with one compressor."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.compressor = zstandard.ZstdCompressor(level=limits.level)

    def ratio(self, data: bytes | memoryview) -> float:
        return len(data) / len(self.compressor.compress(data))

    def bands(self, data: bytes) -> tuple[float | None, int, int, str | None]:
        """Ratio of the whole, number of chunks, of chunks outside their band, and the reason of a rejection.

        Chunks are cut from the start; a rest shorter than a chunk counts for the whole only, and so does a text that
        fills no two chunks.
        """
        limits = self.limits
        if not data:
            return None, 0, 0, None
        whole = self.ratio(data)
        low, high = next((low, high) for size, low, high in sorted(limits.bands, reverse=True) if len(data) >= size)
        reason = _outside(whole, low, high)
        view, size = memoryview(data), limits.chunk_bytes
        chunks = len(data) // size if len(data) >= 2 * size else 0
        found = [_outside(self.ratio(view[i * size : (i + 1) * size]), *limits.chunk_band) for i in range(chunks)]
        bad = sum(r is not None for r in found)
        if reason is None and bad > limits.chunk_share * chunks:
            repetitive = sum(r == "repetitive" for r in found)
            reason = "repetitive chunks" if 2 * repetitive >= bad else "incompressible chunks"
        return whole, chunks, bad, reason

    def facts(self, text: str | None) -> tuple:
        """The values of ``FACTS``."""
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        repeats = repeated_words(words)
        failed = len(words) < self.limits.min_words or 100 * repeats > self.limits.max_repeat_percent * len(words)
        ratio, chunks, bad, reason = self.bands(data)
        return (
            len(words), len(data.translate(None, _SPACE + _NOT_FIRST)), len(data) - len(data.translate(None, _SYMBOLS)),
            duplicate_lines(data), repeats, failed, not failed and reason is None, ratio, chunks, bad,
            "base" if failed else reason,
        )


def _columns(judge: Judge, texts: pa.Array) -> dict[str, list]:
    names = [part.split()[0] for part in FACTS.split(", ")]
    rows = [judge.facts(t.as_py()) for t in texts]
    return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: its id and ``FACTS``; other columns are not read.

    Words are split at ASCII white space. ``base_failed``: under ``min_words`` words, or over ``max_repeat_percent`` per
    cent of the words are in three-word windows found twice. ``kept``: the base holds, the ratio of the whole text lies
    in the band of its length, and at most ``chunk_share`` of its chunks lie outside theirs. ``reason`` names the first
    rule that failed, else null. A null or empty text has no word, a null ratio and fails the base; one with a null id
    is judged like any other; equal rows have equal results. Whole texts are read, whatever their length.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {FACTS}"
    return docs.select(id_col, text_col).mapInArrow(_judged(limits), schema)


def _judged(limits: Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Judge(limits)
        for batch in batches:
            facts = _columns(rules, batch.column(1))
            types = {"ratio": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "reason": pa.string()}
            arrays = [pa.array(list(v), types.get(n, pa.int64())) for n, v in facts.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [batch.schema.names[0], *facts])

    return run


def within_bands(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Every row is decided on its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Judge(limits)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array(list(_columns(rules, texts)["kept"]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
