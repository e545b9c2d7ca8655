"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring symbols that occurs inside no vocabulary token is a certain cut: a merge across it would make a
token that holds the pair. The fragments between cuts are encoded independently and their ids are put together.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex

from pyspark import SparkFiles
from pyspark.sql import DataFrame

_SPACE = r"\t-\r \x85\xa0  -     　"
# The splitting pattern of the tokenizer file.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+"
_PYTHON_ONLY_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_CACHED = 1 << 18
_LONG_FRAGMENT = 200  # symbols from which a heap is faster than looking through all ranks
_ROWS = 256  # the ids of a batch weigh several times its text


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in symbols):
        symbols[b] = chr(256 + i)
    return [symbols[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of a tokenizer file (byte-level BPE with word-end suffix, NFC, one space, lower case)."""

    def __init__(self, tokenizer: dict) -> None:
        model = tokenizer["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        by_id = {i: token for token, i in self.ids.items()} | {i: token for token, i in self.special.items()}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        # A merge is found by its two ids in one number; what it gives, by its rank.
        self.rank_of: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if self.rank_of.setdefault(self.ids[left] << 32 | self.ids[right], len(self.merged)) == len(self.merged):
                self.merged.append(self.ids[left + right])
        self.inside = {pair for token in self.ids for s in [self._symbols_of(token)] for pair in zip(s, s[1:])}
        self.bytes = byte_symbols()
        self.pattern = regex.compile(_PATTERN)
        self.blank = regex.compile(f"[{_SPACE}]+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = _Cache(self.word_ids)
        self.chunks = _Cache(self.chunk_ids)

    def _symbols_of(self, token: str) -> list[str]:
        """Characters of a token; the last one carries the word end if the token has it."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def fragment(self, symbols: tuple[str, ...]) -> list[int]:
        """Ids of one fragment: the leftmost pair of lowest rank is merged until none is left."""
        none, rank_of, merged = len(self.merged), self.rank_of.get, self.merged
        parts = [self.ids[s] for s in symbols]
        if len(parts) > _LONG_FRAGMENT:
            return self.long_fragment(parts)
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) != none:
            at = ranks.index(rank)
            parts[at:at + 2] = [merged[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | parts[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 32 | parts[at + 1], none)
        return parts

    def long_fragment(self, parts: list[int]) -> list[int]:
        """The same merges from a heap of pairs over a linked list, in n log n steps."""
        size, none, rank_of, merged = len(parts), len(self.merged), self.rank_of.get, self.merged
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # Rank and place in one number, so that of equal ranks the leftmost pair comes first.
        heap = [rank << 32 | i for i in range(size - 1) if (rank := rank_of(parts[i] << 32 | parts[i + 1], none)) != none]
        heapify(heap)
        while heap:
            pair = heappop(heap)
            rank, at = pair >> 32, pair & 0xFFFFFFFF
            right = after[at]
            if parts[at] < 0 or right >= size or rank_of(parts[at] << 32 | parts[right], none) != rank:
                continue  # one of the two has been merged since
            parts[at], parts[right] = merged[rank], -1
            after[at] = right = after[right]
            if right < size:
                before[right] = at
                if (rank := rank_of(parts[at] << 32 | parts[right], none)) != none:
                    heappush(heap, rank << 32 | at)
            left = before[at]
            if left >= 0 and (rank := rank_of(parts[left] << 32 | parts[at], none)) != none:
                heappush(heap, rank << 32 | left)
        return [i for i in parts if i >= 0]

    def fragments(self, word: str) -> list[tuple[str, ...]]:
        """The word's byte symbols, cut at every pair that no token holds."""
        symbols = list(word) if word.isascii() and word.isprintable() else [self.bytes[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        pairs = list(zip(symbols, symbols[1:]))
        if self.inside.issuperset(pairs):
            return [tuple(symbols)]
        cuts = [0, *[i for i, pair in enumerate(pairs, 1) if pair not in self.inside], len(symbols)]
        return [tuple(symbols[a:b]) for a, b in zip(cuts, cuts[1:])]

    def normalize(self, text: str) -> str:
        # Lower case is taken character by character: the word-final sigma has no form of its own.
        return self.blank.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a text without white space."""
        if chunk.isascii() and chunk.isprintable():  # its bytes are their own symbols
            chunk = chunk.lower()
            words = [chunk] if chunk.isalpha() else self.pattern.findall(chunk)
        else:
            words = self.pattern.findall(self.normalize(chunk))
        return b"".join(map(self.words.__getitem__, words))

    def word_ids(self, word: str) -> bytes:
        ids = [i for fragment in self.fragments(word) for i in self.fragment(fragment)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null encodes as the empty text.

        White space never changes what stands on its other side, so the text is encoded chunk by chunk and chunks seen
        lately are looked up. Special tokens in the text become their own ids.
        """
        text = text or ""
        out = []
        for piece in self.split_special.split(text) if self.split_special else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            elif any(c in piece for c in _PYTHON_ONLY_SPACE):
                out.extend(map(self.chunks.__getitem__, self.blank.split(piece)))
            else:
                out.extend(map(self.chunks.__getitem__, piece.split()))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between them: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Cache(dict):
    """Results of ``make``; forgets all of them when it is full."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= _CACHED:
            self.clear()
        ids = self[key] = self.make(key)
        return ids


@lru_cache(2)
def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as file:
        return Bpe(json.load(file))


_OUTPUTS = {"ids": "array<int>", "decoded": "string"}


def tokenize(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ()
) -> DataFrame:
    """One row for each document: the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``path`` is a tokenizer file on the driver; Spark ships it to every executor. ``outputs`` adds the real outputs,
    ``ids`` (array<int>) and ``decoded``. A null text counts as empty: no tokens. Repeated rows stay repeated.
    """
    name = path.rsplit("/", 1)[-1]
    docs.sparkSession.sparkContext.addFile(path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", {name} {_OUTPUTS[name]}" for name in outputs)

    def encoded(bpe: Bpe, text: str | None) -> dict:
        ids = bpe.encode(text)
        decoded = bpe.decode(ids)
        row = {
            "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(),
        }
        if "ids" in outputs:
            row["ids"] = np.frombuffer(ids, "<i4")
        if "decoded" in outputs:
            row["decoded"] = decoded
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(SparkFiles.get(name))
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                batch = whole.iloc[start:start + _ROWS]
                rows = [encoded(bpe, text) for text in batch["text"]]
                columns = ["n_tokens", "ids_sha256", "decoded_sha256", *outputs]
                yield pd.DataFrame({id_col: batch["id"].to_numpy()} | {c: [r[c] for r in rows] for c in columns})
        bpe.words.clear()  # the worker lives on, other work needs its memory
        bpe.chunks.clear()

    selected = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return selected.mapInPandas(run, schema)
