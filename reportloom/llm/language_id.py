"""Language by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text answers which strings occur in it. A text is
parsed from left to right into the longest phrases that occur (a letter that does not occur is a phrase of its own). The
language that needs the fewest phrases, normalised to bits per character, wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

UNDETERMINED = "und"
_PIECE = 256
_BATCH = 2048
_DENSE = 256
_GAP = 0  # symbol of white space, digits, signs


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_and_gaps(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one zero."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 0)
    return codes[(codes != 0) | (np.append(1, codes[:-1]) != 0)]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            other = moves[at][symbol]
            if length[at] + 1 == length[other]:
                link[new] = other
            else:
                copy = len(moves)
                moves.append(dict(moves[other]))
                length.append(length[at] + 1)
                link.append(link[other])
                while at >= 0 and moves[at].get(symbol) == other:
                    moves[at][symbol] = copy
                    at = link[at]
                link[other] = link[new] = copy
        last = new
    return moves


@dataclass
class Moves:
    """Moves of one language's automaton over its own letters.

    ``place`` gives for every symbol of a text the own one: the gap, own letters, one for all other letters, padding.
    A dense table is flat: row offset of a state plus symbol gives the row offset of the next state, or, where the phrase
    ends, the bitwise complement of the one that the symbol leads to from the start. Over many letters the moves are
    sorted ``keys`` of state and symbol with their ``targets`` and the states ``first`` after the start instead.
    Padding moves nothing; the ``silent`` state knows no phrase.
    """

    place: np.ndarray
    width: int
    silent: int
    table: np.ndarray | None
    keys: np.ndarray | None = None
    targets: np.ndarray | None = None
    first: np.ndarray | None = None

    def ended(self, steps: np.ndarray) -> np.ndarray:
        """Phrases that end in each column of ``steps``."""
        count = np.zeros(steps.shape[1], np.int32)
        if self.table is not None:
            state = np.full(steps.shape[1], self.silent * self.width, np.int32)
            for row in steps:
                state = self.table.take(state + self.place.take(row))
                over = state >> 31
                count -= over
                state ^= over
            return count
        state = np.full(steps.shape[1], self.silent, np.int64)
        for row in steps:
            symbol = self.place.take(row)
            key = state * self.width + symbol
            at = np.searchsorted(self.keys, key)
            goes_on = self.keys.take(at) == key
            text = symbol != self.width - 1
            count += text & ~goes_on
            state = np.where(text, np.where(goes_on, self.targets.take(at), self.first.take(symbol)), state)
        return count


@dataclass
class Parsers:
    """The letters of all languages together and the moves of each."""

    alphabet: np.ndarray
    languages: list[str]
    tables: list[Moves]
    sizes: list[int]

    @property
    def width(self) -> int:
        return self.alphabet.size + 3  # gap, letters, other letter, padding

    def symbols(self, text: str) -> np.ndarray:
        codes = letters_and_gaps(text)
        place = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(place, self.alphabet.size - 1)] == codes if self.alphabet.size else codes < 0
        return np.where(codes == 0, _GAP, np.where(known, place + 1, self.alphabet.size + 1)).astype(np.min_scalar_type(self.width))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of every text in every language.

        Texts are parsed in pieces of 256 symbols, a phrase ends with its piece; all pieces take a step together.
        """
        pieces = np.array([-(-t.size // _PIECE) for t in texts], np.int64)
        ends = np.cumsum(pieces)
        grid = np.full(int(ends[-1]) * _PIECE if len(texts) else 0, self.width - 1, np.min_scalar_type(self.width))
        for t, end, count in zip(texts, ends, pieces):
            at = int(end - count) * _PIECE
            grid[at:at + t.size] = t
        steps = np.ascontiguousarray(grid.reshape(-1, _PIECE).T)
        owner = np.repeat(np.arange(len(texts)), pieces)
        found = np.zeros((len(texts), len(self.tables)), np.int64)
        for column, moves in enumerate(self.tables):
            found[:, column] = np.bincount(owner, moves.ended(steps), len(texts)).astype(np.int64)
        return found

    def judge(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of every text, as ``predict`` gives them."""
        names = np.array(self.languages, object)
        bits = np.log2(np.maximum(2, self.sizes))
        coded = [self.symbols(t) if isinstance(t, str) else np.empty(0, np.uint8) for t in texts]
        spoken = np.array([bool((t != _GAP).any()) for t in coded], bool)
        best = np.full(len(coded), UNDETERMINED, object)
        score = np.zeros(len(coded))
        if names.size and spoken.any():
            cost = self.phrases(coded) * bits
            order = np.argsort(cost, axis=1, kind="stable")
            first = np.take_along_axis(cost, order, 1)
            best[spoken] = names[order[:, 0]][spoken]
            margin = 1 - first[:, 0] / np.maximum(first[:, 1], 1) if names.size > 1 else np.ones(len(coded))
            score[spoken] = np.clip(margin, 0, 1)[spoken]
        return best, score


def train(samples: dict[str, list[str]], sample_chars: int) -> Parsers:
    """Parsers of the languages; every language is cut to ``sample_chars`` letters and gaps."""
    coded: dict[str, list[np.ndarray]] = {}
    for language in sorted(samples):
        left = sample_chars
        for text in samples[language]:
            codes = letters_and_gaps(text)[:left]
            left -= codes.size
            coded.setdefault(language, []).append(codes)
            if left <= 0:
                break
    coded = {language: texts for language, texts in coded.items() if any((t != 0).any() for t in texts)}
    every = np.concatenate([t for texts in coded.values() for t in texts]) if coded else np.empty(0, np.uint32)
    letters = np.unique(every[every != 0])
    parsers = Parsers(letters, [], [], [])
    for language, texts in coded.items():
        own = np.unique(np.concatenate(texts))
        own = own[own != 0]
        symbols: list[int] = []
        for codes in texts:
            symbols += np.where(codes == 0, _GAP, np.searchsorted(own, codes) + 1).tolist() + [-2]
        width = own.size + 3
        place = np.full(parsers.width, own.size + 1, np.min_scalar_type(width))
        place[np.searchsorted(letters, own) + 1] = np.arange(own.size) + 1
        place[_GAP], place[-1] = _GAP, width - 1
        parsers.languages.append(language)
        parsers.tables.append(_moves(suffix_automaton(symbols), place, width))
        parsers.sizes.append(len(symbols))
    return parsers


def _moves(automaton: list[dict[int, int]], place: np.ndarray, width: int) -> Moves:
    """A dense table for up to ``_DENSE`` symbols, sorted keys for more."""
    silent = len(automaton)
    known = [(state * width + symbol, target) for state, to in enumerate(automaton) for symbol, target in to.items() if symbol >= 0]
    keys, targets = np.array(known, np.int64).reshape(-1, 2).T
    order = np.argsort(keys)
    keys, targets = keys[order], targets[order]
    first = np.full(width, silent, np.int64)
    start = keys < width
    first[keys[start]] = targets[start]
    if width > _DENSE or (silent + 1) * width >= 1 << 31:
        return Moves(place, width, silent, None, np.append(keys, np.iinfo(np.int64).max), np.append(targets, silent), first)
    table = np.tile(~(first * width), (silent + 1, 1))
    table.reshape(-1)[keys] = targets * width
    table[:, -1] = np.arange(silent + 1) * width
    return Moves(place, width, silent, table.astype(np.int32).ravel())


def labelled_sample(docs: DataFrame, sample_chars: int, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[str]]:
    """The first distinct texts of each language by hash that have three times ``sample_chars`` characters together.

    A text starts at its first letter and counts up to ``sample_chars``; every language with a letter gives one at least.
    Hashes are counted by their number of leading zeros first, so only about twice what is taken is fetched. Runs two jobs.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    place = (F.xxhash64("text").cast("double") / F.lit(float(1 << 63)) + 1.0) / 2.0
    placed = labelled.select("lang", place.alias("place"), F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, sample_chars).alias("text"))
    zeros = F.least(F.lit(60), F.floor(-F.log2(F.greatest(F.col("place"), F.lit(2.0**-60))))).cast("int")
    placed = placed.filter("text <> ''").withColumn("zeros", zeros)
    distinct = placed.groupBy("lang", "zeros", "place").agg(F.max(F.length("text")).alias("chars"))
    sizes: dict[str, dict[int, int]] = {}
    for row in distinct.groupBy("lang", "zeros").agg(F.sum("chars").alias("chars")).collect():
        sizes.setdefault(row["lang"], {})[row["zeros"]] = row["chars"]
    if not sizes:
        return {}
    least = {}
    for language, chars in sizes.items():
        total = 0
        for least[language] in sorted(chars, reverse=True):
            total += chars[least[language]]
            if total >= 3 * sample_chars:
                break
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang"))
    rows = placed.filter(F.col("zeros") >= bound).select("lang", "place", "text").distinct().collect()
    out: dict[str, list[str]] = {}
    taken = dict.fromkeys(least, 0)
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"], r["text"])):
        if taken[row["lang"]] < 3 * sample_chars:
            taken[row["lang"]] += len(row["text"])
            out.setdefault(row["lang"], []).append(row["text"])
    return out


def unshared_lines(samples: dict[str, list[str]]) -> dict[str, list[str]]:
    """The samples without the lines that occur under two or more languages; a line counts once for its language."""
    under: dict[str, set[str]] = {}
    for language, texts in samples.items():
        for text in texts:
            for line in text.split("\n"):
                under.setdefault(line.strip().lower(), set()).add(language)
    out: dict[str, list[str]] = {}
    for language, texts in samples.items():
        left = {line for line, languages in under.items() if languages == {language}}
        for text in texts:
            lines = [line for line in text.split("\n") if line.strip().lower() in left]
            left.difference_update(line.strip().lower() for line in lines)
            out.setdefault(language, []).append("\n".join(lines))
    return {language: out[language] if any(map(str.isalpha, "".join(out[language]))) else texts for language, texts in samples.items()}


def fit(docs: DataFrame, sample_chars: int = 1 << 15, lang_col: str = "lang", text_col: str = "text") -> Parsers:
    """Learn from labelled rows. ``sample_chars`` bounds what is kept of each language, none is left out. Runs jobs."""
    return train(unshared_lines(labelled_sample(docs, sample_chars, lang_col, text_col)), sample_chars)


def predict(docs: DataFrame, parsers: Parsers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` for every row, from the whole text alone.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or nothing was learned. The score is the
    margin of the best language, 1 - its bits per character / those of the second; with one language it is 1. Ties go to
    the language that sorts first. Repeated rows stay repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parsers)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), _BATCH):
                batch = whole.iloc[start:start + _BATCH]
                best, score = shared.value.judge(batch["text"])
                yield pd.DataFrame({id_col: batch["id"], "lang_pred": best, "score": score})

    selected = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return selected.mapInPandas(run, f"`{id_col}` {kind}, lang_pred string, score double")


def in_known_language(docs: DataFrame, parsers: Parsers, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a predicted language; those without any letter go. All columns as they were.

    Every row is judged by its own text; ids play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parsers)

    def known(texts: pd.Series) -> pd.Series:
        parts = [shared.value.judge(texts.iloc[i:i + _BATCH])[0] for i in range(0, len(texts), _BATCH)]
        return pd.Series(np.concatenate(parts) != UNDETERMINED if parts else np.empty(0, bool))

    return docs.filter(F.pandas_udf(known, "boolean")(F.col(text_col).cast("string")))
