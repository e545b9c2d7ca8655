"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

1. Every labeller votes good, bad or not at all; a text's votes are one pattern number.
2. Expectation-maximisation over the counts of the patterns estimates how each labeller votes on good and on bad texts.
3. The posterior of a pattern labels a bounded sample, on which a logistic scorer of hashed features is trained.
4. The scorer judges every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from reportloom.llm.html_text import STOP_WORDS, unlisted

BAD, GOOD, SILENT = 0, 1, 2
_BITS = 15
_CACHED = 1 << 19
_MARKS = re.compile(r"[#$%&*@^~|<>={}\\_]|!!|\?\?")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


@dataclass
class Facts:
    """What the labellers look at."""

    text: str
    words: list[str]
    letters: int
    capitals: int


def _below(value: float, good: float, bad: float) -> int:
    return GOOD if value <= good else BAD if value >= bad else SILENT


def _marks(f: Facts) -> int:
    return _below(sum(1 for _ in _MARKS.finditer(f.text)) / len(f.words), 0.02, 0.10)


def _capitals(f: Facts) -> int:
    return _below(f.capitals / max(1, f.letters), 0.15, 0.40)


def _stutter(f: Facts) -> int:
    return _below(sum(a == b for a, b in zip(f.words, f.words[1:])) / len(f.words), 0.03, 0.15)


def _variety(f: Facts) -> int:
    """Distinct words in stretches of 100, so that a long text is not poorer than a short one."""
    if len(f.words) < 30:
        return SILENT
    stretches = [f.words[i:i + 100] for i in range(0, max(1, len(f.words) - 29), 100)]
    distinct = sum(len(set(s)) / len(s) for s in stretches) / len(stretches)
    return BAD if distinct < 0.25 else GOOD if distinct > 0.45 else SILENT


def _stop_words(f: Facts) -> int:
    """Silent on a text whose letters show that no list of stop words fits it."""
    if len(f.words) < 10:
        return SILENT
    share = sum(w.lower().strip(".,;:!?") in STOP_WORDS for w in f.words) / len(f.words)
    return GOOD if share >= 0.12 else BAD if share <= 0.04 and not unlisted(f.text) else SILENT


def _sentences(f: Facts) -> int:
    ends = sum(1 for _ in _SENTENCE.finditer(f.text))
    per_end = len(f.words) / max(1, ends)
    return GOOD if ends and 3 <= per_end <= 40 else BAD if per_end > 80 else SILENT


def _letters(f: Facts) -> int:
    share = f.letters / max(1, sum(map(len, f.words)))
    return GOOD if share >= 0.9 else BAD if share <= 0.75 else SILENT


def _length(f: Facts) -> int:
    return GOOD if len(f.words) >= 20 else SILENT


LABELLERS: list[Callable[[Facts], int]] = [_marks, _capitals, _stutter, _variety, _stop_words, _sentences, _letters, _length]


def votes(text: str | None) -> list[int]:
    """A vote of each labeller; an empty or null text has a bad length and no other vote."""
    words = (text or "").split()
    if not words:
        return [SILENT] * (len(LABELLERS) - 1) + [BAD]
    letters = sum(map(str.isalpha, text))
    capitals = sum(map(str.isupper, text))
    facts = Facts(text, words, letters, capitals)
    return [labeller(facts) for labeller in LABELLERS]


def pattern(marks: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(marks))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of good texts and P(vote | class, not silent), an array of labellers by class (bad, good) by vote.

    Starts from bad for the texts that any labeller calls bad. The counts of each labeller are smoothed by a prior worth
    a fiftieth of the texts, which says that labellers are better than chance: kinds of bad texts that only one or two
    labellers know would otherwise be explained away as good ones.
    """
    table = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good = np.where((table == BAD).any(1), 0.1, 0.9)
    belief = np.array([[0.6, 0.4], [0.02, 0.98]]) * (counts.sum() / 50 + 1)
    prior, chances = 0.5, np.ones((len(LABELLERS), 2, 3))  # silence says nothing: its chance stays 1
    for _ in range(rounds):
        weight = np.stack((1 - good, good)) * counts
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for i in range(len(LABELLERS)):
            for vote in (BAD, GOOD):
                chances[i, :, vote] = weight[:, table[:, i] == vote].sum(1) + belief[:, vote]
        chances[:, :, :SILENT] /= chances[:, :, :SILENT].sum(2, keepdims=True)
        good = posteriors(patterns, prior, chances)
    return float(prior), chances


def posteriors(patterns: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    """P(good | pattern)."""
    table = (np.asarray(patterns)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    logs = np.log(chances)
    bad, good = (sum(logs[i, c, table[:, i]] for i in range(len(LABELLERS))) for c in (0, 1))
    return 1 / (1 + np.exp(np.clip(bad - good + np.log(1 - prior) - np.log(prior), -700, 700)))


class _Indices(dict):
    """Feature numbers of a word: its own bucket and that of its shape, in one number; forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHED:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word))
        mask = (1 << _BITS) - 1
        own = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & mask
        shaped = zlib.crc32(b"\x00" + shape.encode("utf-8", "surrogatepass")) & mask
        number = self[word] = own << _BITS | shaped
        return number


_INDICES = _Indices()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values of the whole text: root shares of words, word shapes and stutters; unit length."""
    words = (text or "").split()
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    both = np.fromiter(map(_INDICES.__getitem__, words), np.int64, len(words))
    own, shapes = both >> _BITS, both & ((1 << _BITS) - 1)
    stutters = own[1:][own[1:] == own[:-1]] * 0 + 1  # bucket 1 counts repeated words, bucket 0 stands for no words
    index, count = np.unique(np.concatenate((own, shapes, stutters)), return_counts=True)
    value = np.sqrt(count)
    return index, value / np.linalg.norm(value)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        index, value = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[index] @ value + self.bias, -700, 700))))


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, steps: int = 300, penalty: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels, both classes of equal weight, by gradient steps with momentum."""
    weights, bias = np.zeros(1 << _BITS), 0.0
    if not rows:
        return Scorer(weights, bias)
    lengths = np.array([i.size for i, _ in rows])
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    good = max(targets.sum(), 1e-9)
    bad = max((1 - targets).sum(), 1e-9)
    weight = targets / good + (1 - targets) / bad
    weight /= weight.sum()
    speed, bias_speed = np.zeros_like(weights), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[index] * value, len(rows)) + bias, -700, 700)))
        gap = (p - targets) * weight
        speed = 0.9 * speed - 20.0 * (np.bincount(index, gap[owner] * value, weights.size) + penalty * weights)
        bias_speed = 0.9 * bias_speed - 2.0 * gap.sum()
        weights, bias = weights + speed, bias + bias_speed
    return Scorer(weights, float(bias))


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts, null as empty, and their hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(text.alias("text")).withColumn("hash", F.xxhash64("text"))


def vote_patterns(docs: DataFrame, text_col: str = "text") -> pd.DataFrame:
    """``pattern``, ``n`` (its texts) and ``hash`` (the least of them) of all texts, at most 3^8 rows. Runs a job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"pattern": [pattern(votes(t)) for t in batch["text"]], "hash": batch["hash"]})

    voted = _hashed(docs, text_col).mapInPandas(run, "pattern int, hash bigint")
    found = voted.groupBy("pattern").agg(F.count("*").alias("n"), F.min("hash").alias("hash")).orderBy("pattern").collect()
    return pd.DataFrame([tuple(r) for r in found], columns=["pattern", "n", "hash"])


def label_model(found: pd.DataFrame) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over the counts of ``vote_patterns``."""
    return expectation_maximisation(found["pattern"].to_numpy(int), found["n"].to_numpy(float))


def heaviest(index: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest values with their buckets, ties to the smaller bucket, in the order of the buckets."""
    if index.size <= most:
        return index, value
    keep = np.sort(np.lexsort((index, -value))[:most])
    return index[keep], value[keep]


def fit(
    docs: DataFrame, train_rows: int = 4000, text_col: str = "text", train_features: int = 2048
) -> tuple[Scorer, tuple[float, np.ndarray]]:
    """Label model of all texts, and the scorer trained on a bounded sample of distinct texts. Runs jobs.

    The sample has about ``train_rows`` distinct texts of the smallest hash, and for each vote pattern the text of its
    smallest hash (at most 3^8), so that a text copied many times or a rare kind of text is learned too. A sampled text
    gives its ``train_features`` heaviest features to the training.
    """
    found = vote_patterns(docs, text_col)
    model = label_model(found)
    texts = _hashed(docs, text_col)
    distinct = texts.agg(F.approx_count_distinct("hash", 0.02)).first()[0]
    share = min(1.0, train_rows / max(1, distinct))
    most = min(2**63 - 1, int((2 * share - 1) * 2.0**63))
    firsts = F.col("hash").isin([int(h) for h in found["hash"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [heaviest(*features(t), train_features) for t in batch["text"]]
            yield pd.DataFrame({
                "hash": batch["hash"], "pattern": [pattern(votes(t)) for t in batch["text"]],
                "index": [i.astype("<u2").tobytes() for i, _ in kept], "value": [v.astype("<f4").tobytes() for _, v in kept],
            })

    chosen = texts.filter((F.col("hash") <= most) | firsts).distinct()  # copies count once
    rows = chosen.mapInPandas(run, "hash bigint, pattern int, index binary, value binary").collect()
    rows.sort(key=lambda r: r["hash"])
    targets = posteriors(np.array([r["pattern"] for r in rows], int), *model) if rows else np.empty(0)
    sampled = [(np.frombuffer(r["index"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in rows]
    return train_scorer(sampled, targets), model


def classify(docs: DataFrame, train_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1, 1 is good), ``posterior`` of its votes and ``kept`` (score of a half or more).

    A null text counts as empty; equal texts have equal scores; repeated rows stay repeated; texts are scored whole,
    however long. Runs jobs to learn.
    """
    scorer, model = fit(docs, train_rows, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((scorer, model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, model = shared.value
        for batch in batches:
            score = np.array([scorer.score(t) for t in batch["text"]])
            sure = posteriors(np.array([pattern(votes(t)) for t in batch["text"]], int), *model)
            yield pd.DataFrame({id_col: batch["id"], "score": score, "posterior": sure, "kept": score >= 0.5})

    selected = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return selected.mapInPandas(run, f"`{id_col}` {kind}, score double, posterior double, kept boolean")
