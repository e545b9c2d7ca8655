"""CRC-32 of spans against zlib, importance resampling against a plain version."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reportloom.llm import importance
from reportloom.llm.crc import crc32_spans

SCHEMA = "doc_id bigint, text string, weight string, place string, n_words string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def runs(text, most):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent, most, buckets, min_words=20):
    """id, features, weight, score and rank of every row, in order of the rows."""
    def counted(texts):
        return collections.Counter(zlib.crc32(r.encode()) % buckets for t in texts for r in runs(t, most))

    s, t = counted(text for _, text in docs), counted(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
            for b in (zlib.crc32(r.encode()) % buckets for r in runs(text, most))
        ]
        weight = sum(gains) // len(gains) if gains else 0
        name = "null" if key is None else key
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        out.append([key, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [i for i, (_, text) in enumerate(docs) if len(words_of(text)) >= min_words]
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0))
    for place, i in enumerate(fit[: len(fit) * percent // 100], 1):
        out[i][4] = place
    return out


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 2_500_000).astype(np.uint8)
    lengths = np.concatenate([np.arange(300), rng.integers(0, 9000, 200), [64 * 64, 64 * 1024 + 1, 2_000_003]])
    starts = np.array([rng.integers(0, len(data) - n + 1) for n in lengths])
    got = crc32_spans(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert crc32_spans(data, starts[:0], lengths[:0]).tolist() == []


TEXTS = [
    None, "", "  ", "A", "Éa É1ß_x", "one", "end", "x" * 200_000 + " y", "tail of one", "head", "", "é 漢字 \U0001f600z a-b", "z",
    "a\x00b\x7fc", "`{[@/:",
]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_runs_never_cross_texts(most):
    batch = pa.array(TEXTS)
    for texts, array in ((TEXTS, batch), (TEXTS[3:9], batch.slice(3, 6)), ([], batch.slice(0, 0))):
        got = collections.Counter()
        for crc, owner in importance.runs_of(array, most):
            got.update(zip(owner.tolist(), crc.tolist()))
        want = collections.Counter((i, zlib.crc32(r.encode())) for i, t in enumerate(texts) for r in runs(t, most))
        assert got == want


def documents(seed=3):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(60)], [f"t{i}é" for i in range(40)]
    texts = TEXTS + [" ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randint(5, 60))) for _ in range(200)]
    return [(i, t) for i, t in enumerate(texts + texts[-40:])], [" ".join(rng.choices(rare + common[:5], k=30)) for _ in range(20)] + [None]


@pytest.mark.parametrize("most, buckets, percent", [(1, 10_000, 10), (3, 997, 37), (1, 7, 100), (2, 50, 0)])
def test_resampling_matches_the_plain_version(spark, most, buckets, percent):
    docs, target = documents()
    rows = spark.createDataFrame([(k, t, "x", "x", "x") for k, t in docs], SCHEMA).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(rows, wanted, percent, most, buckets).collect()
    have = sorted([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got)
    assert have == sorted(plain(docs, target, percent, most, buckets))


def test_repeated_and_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(25))
    docs = [(None, text)] * 30 + [(4, text)] * 30 + [(9, text)]
    rows = spark.createDataFrame([(k, t, "x", "x", "x") for k, t in docs], SCHEMA)
    got = importance.resample(rows, rows.select("text"), 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31)) and len(got) == 61
    want = plain(docs, [t for _, t in docs], 50, 1, 10_000)
    assert collections.Counter((r["doc_id"], r["score"], r["rank"] is None) for r in got) == collections.Counter(
        (k, s, rank is None) for k, _, _, s, rank in want
    )


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "a " * 30, "x", "x", "x")], SCHEMA)
    assert importance.resample(empty, one).count() == 0
    row = importance.resample(one, empty.select("text"), 100).first()
    assert (row["n_features"], row["rank"]) == (30, 1) and [list(row[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))] == plain(
        [(1, "a " * 30)], [], 100, 1, 10_000
    )


def test_string_ids(spark):
    rows = spark.createDataFrame([(f"u{i}", "a b " * 15) for i in range(12)], "url string, body string")
    got = importance.resample(rows, rows, 50, id_col="url", text_col="body", target_col="body")
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4, 5, 6]


def test_batches_are_taken_in_slices(monkeypatch):
    monkeypatch.setattr(importance, "_SLICE", 10)
    texts = ["abc", None, "", "d" * 9, "ef", "g" * 50, "h", "i"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    parts = list(importance.slices(batch, 1))
    assert [t for part in parts for t in part.column(1).to_pylist()] == texts and len(parts) == 3
    assert list(importance.slices(batch.slice(0, 0), 1)) == []
