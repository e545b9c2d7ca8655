"""Compression bands against a plain version, on odd rows, and on texts that are to go or to stay."""

import base64
import collections
import random
import re

import pytest
import zstandard

from reportloom.llm import compression
from reportloom.llm.compression import Limits

SCHEMA = "doc_id bigint, text string, kept boolean, ratio string"


def plain(text, limits=Limits()):
    """Facts of one text, counted the long way."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    seen, copies = set(), 0
    for line in lines:
        copies += line in seen
        seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    data = text.encode()
    compressor = zstandard.ZstdCompressor(level=3)
    size = limits.chunk_bytes
    ratio = len(data) / len(compressor.compress(data)) if data else None
    kept = not failed
    chunks = bad = 0
    if data:
        for least, low, high in limits.bands:
            if len(data) >= least:
                band = low, high
        kept = kept and band[0] <= ratio <= band[1]
        if len(data) >= 2 * size:
            for start in range(0, len(data) - size + 1, size):
                own = size / len(compressor.compress(data[start : start + size]))
                chunks += 1
                bad += not limits.chunk_band[0] <= own <= limits.chunk_band[1]
        kept = kept and not bad > limits.chunk_share * chunks
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(inside), failed, kept, ratio, chunks, bad
    )


def sentence_maker(seed):
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"
    vocabulary = ["".join(rng.choice(letters[: 6 + len(letters) * rng.random().__trunc__() or 22]) for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    weights = [1 / (i + 3) for i in range(len(vocabulary))]

    def make(count):
        return ". ".join(" ".join(rng.choices(vocabulary, weights, k=12)).capitalize() for _ in range(count // 12 + 1))

    return make


def cases():
    rng = random.Random(5)
    prose = sentence_maker(1)
    noise = base64.b64encode(rng.randbytes(60_000)).decode()
    spaced = " ".join(noise[i : i + 8] for i in range(0, len(noise), 8))
    return {
        "null": None, "empty": "", "blank": " \t\n\r\v\f ", "short": "one two", "no-break": "a b   c é 漢字",
        "clean 600": prose(80), "clean 3000": prose(500), "clean 40000": prose(6_000), "clean long": prose(40_000),
        "stutter": "word " * 300, "lines": "same line of text here\n" * 40 + "\n\n  \n" + "# * $\n" * 3,
        "noise": spaced, "one word": "x" * 300_000,
        "noise behind prose": prose(18_000) + " " + spaced, "copied page": (prose(300) + "\n") * 60,
        "numbers in order": " ".join(f"item{i:06d}" for i in range(20_000)),
    }


def test_facts_match_the_plain_version(spark):
    texts = list(cases().values())
    rows = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts + texts)] + [(None, "a b", True, None)], SCHEMA)
    got = {r["doc_id"]: r for r in compression.judge(rows).collect()}
    assert len(got) == 2 * len(texts) + 1 and got[None]["n_words"] == 2
    for i, text in enumerate(texts + texts):
        row = got[i]
        facts = tuple(row[c] for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks"
        ))
        assert facts == plain(text), list(cases())[i % len(texts)]
        assert row["kept"] == (row["reason"] is None)


def test_clean_stays_and_bad_goes():
    judge = compression.Judge(Limits())
    reasons = {name: judge.facts(text)[-1] for name, text in cases().items()}
    for name in ("clean 600", "clean 3000", "clean 40000", "clean long"):
        assert reasons[name] is None, name
    assert reasons["noise"] == "incompressible"
    assert reasons["noise behind prose"] == "incompressible chunks"
    assert reasons["numbers in order"] == "repetitive"
    assert reasons["copied page"] == "base" and reasons["stutter"] == "base"


def test_a_page_copied_with_changes_is_repetitive():
    """No three words repeat, yet the text is one page again and again."""
    text = " ".join(f"alpha{i} betagamma delta{i} epsilonzeta{i % 7} eta{i}" for i in range(4000))
    facts = compression.Judge(Limits()).facts(text)
    assert facts[4] == 0 and facts[-1] == "repetitive"


@pytest.mark.parametrize("words", [list(b"aaaa"), list(b"ab"), [], list(b"abcabc"), list(b"xabcyabcabz")])
def test_repeated_words_by_hand(words):
    words = [bytes([w]) for w in words]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    assert compression.repeated_words(words) == len(inside)


def test_limits_of_the_caller(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id bigint, text string")
    assert compression.judge(rows).first()["kept"]
    strict = Limits(bands=((0, 0.0, 1.1),))
    assert compression.judge(rows, strict).first()["reason"] == "repetitive"
    assert compression.judge(rows, Limits(min_words=61)).first()["reason"] == "base"


def test_within_bands_keeps_whole_rows(spark):
    texts = list(cases().values())
    rows = spark.createDataFrame([(None if i == 5 else i, t, None, str(i)) for i, t in enumerate(texts)], SCHEMA)
    kept = compression.within_bands(rows)
    assert kept.schema == rows.schema
    assert sorted(int(r["ratio"]) for r in kept.collect()) == [i for i, t in enumerate(texts) if plain(t)[6]]
    empty = rows.filter("false")
    assert compression.within_bands(empty).count() == 0 and compression.judge(empty).count() == 0
