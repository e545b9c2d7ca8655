"""Operators of the training-data pipeline on small rows: plain Python versions, nulls, ties, repeats, empty tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from reportloom.llm import bpe, components, exact_dedup, html_text, language_id, mixing, near_dedup, quality, sharding, url_filter, vector_search
from reportloom.llm.queries import tokenizer_path
from reportloom.llm.shingles import shared, shingle_sets

SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, copies string, shard string"


def table(spark, texts, lang="en", source="s", first=0):
    return spark.createDataFrame([(i, t, lang, source, "x", "x", "x") for i, t in enumerate(texts, first)], SCHEMA)


ODD = [None, "", "  \n", "a", "A", "é", "x" * 30_000 + " y", "one two three four five six", "One two three four five SIX", "!!! 123"]


def prose(rng, words, count):
    return " ".join(rng.choice(words) for _ in range(count))


@pytest.mark.parametrize("texts", [[], ODD, ODD + ODD])
def test_exact_dedup_matches_plain_python(spark, texts):
    got = {r.doc_id: r for r in exact_dedup.duplicate_groups(table(spark, texts)).collect()}
    lower = {i: re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for i, t in enumerate(texts)}
    groups = collections.defaultdict(list)
    for i, t in lower.items():
        groups[t].append(i)
    assert len(got) == len(texts)
    for i, t in lower.items():
        own = groups[t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    stays = exact_dedup.without_copies(table(spark, texts))
    assert stays.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_with_a_full_filter(spark):
    texts = [f"t{i % 700}" for i in range(1000)]
    got = exact_dedup.duplicate_groups(table(spark, texts), max_bits=128).collect()
    assert sum(r.kept for r in got) == 700 and len(got) == 1000


def test_exact_dedup_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, "A")], "doc_id bigint, text string")
    got = sorted(exact_dedup.duplicate_groups(rows).collect(), key=lambda r: (r.text_sha256, r.doc_id or 0))
    assert [r.kept for r in sorted(got, key=lambda r: (r.group_size, r.doc_id or 0))] == [True, False, True]


@pytest.mark.parametrize("count", [0, 1, 39, 1000])
def test_shards_have_exact_sizes(spark, count):
    rows = table(spark, ["same"] * count).repartition(7)
    got = sharding.into_shards(rows, 40, seed=1, rows_per_run=4)
    assert got.columns == [c for c in rows.columns if c != "shard"] + ["shard", "slot"]
    found = got.collect()
    assert sorted(r.doc_id for r in found) == list(range(count))
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_hypergeometric_distribution(spark):
    for total, marked, drawn in [(50, 20, 10), (12, 6, 12), (7, 7, 3), (10, 0, 4), (0, 0, 0)]:
        big = [F.lit(x).cast("bigint") for x in (total, marked, drawn)]
        counts = spark.range(8000).select(sharding.hypergeometric(*big, sharding._uniform(3, F.col("id"))).alias("k")).groupBy("k").count()
        found = {r.k: r["count"] for r in counts.collect()}
        chi = 0.0
        for k in range(max(0, drawn + marked - total), min(drawn, marked) + 1):
            expected = 8000 * math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
            seen = found.pop(k, 0)
            chi += (seen - expected) ** 2 / expected if expected > 5 else 0
        assert not found and chi < 40


def test_matrix_sums(spark):
    counts = spark.createDataFrame([(0, 10), (2, 300), (5, 1)], "part bigint, n bigint")
    rows = {r.part: r.ends for r in sharding.communication_matrix(counts, 7, 5).collect()}
    dealt = {p: np.diff([0, *ends]) for p, ends in rows.items()}
    assert [int(sum(dealt[p])) for p in sorted(dealt)] == [10, 0, 300, 0, 0, 1]
    assert sorted(sum(dealt.values()).tolist()) == [44, 44, 44, 44, 45, 45, 45]


def test_mixing_reaches_target_weights(spark):
    docs = table(spark, ["word " * 20] * 3000, source="big").union(table(spark, ["word " * 20] * 600, source=None, first=3000))
    got = mixing.mix_sources(docs, seed=3, power=0.0)
    assert got.columns == [c for c in docs.columns if c != "copies"] + ["copies", "copy", "order_key"]
    rows = got.collect()
    by = collections.Counter(r.source for r in rows)
    assert abs(by["big"] - 1800) < 200 and abs(by[None] - 1800) < 200
    copies = collections.Counter(r.doc_id for r in rows)
    assert all(copies[r.doc_id] == r.copies for r in rows)
    weighted = collections.Counter(r.source for r in mixing.mix_sources(docs, {"big": 1.0}, seed=3).collect())
    assert set(weighted) == {"big"}
    assert mixing.mix_sources(table(spark, [])).count() == 0
    assert mixing.mix_sources(table(spark, ODD)).count() >= 0


def test_poisson_distribution(spark):
    for mean in (0.05, 1.3, 16.0):
        row = spark.range(20000).select(mixing.poisson(F.lit(mean), sharding._uniform(1, F.col("id"))).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
        assert abs(row[0] - mean) < 5 * (mean / 20000) ** 0.5 and abs(row[1] - mean) < 0.1 * mean + 0.01


TEXTS = ODD + [
    "A<|endoftext|>b <|startoftext|>", "ΑΣΣ ΣΑΣ İstanbul ẞ Straße é ﬁ", "it's I'LL don't 12345 ３ ½", "a\x1cb\x1d c\x85d​e　f\x00\x07",
    "日本語テキスト 한국어 👍🏽", "<|endoftext|", "́abc ́", "foo﻿bar x\xady",
]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in bpe.tokenize(table(spark, TEXTS), tokenizer_path(), outputs=("ids", "decoded")).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.tokenize(table(spark, []), tokenizer_path()).count() == 0


def test_forced_cuts_hold_in_every_token():
    model = bpe.load(tokenizer_path())
    assert [f for f in model.fragments("abc")] == [("a", "b", "c</w>")]
    word = "qxzjqkvw" * 3
    parts = model.fragments(word)
    assert len(parts) > 1 and "".join(s for p in parts for s in p) == word + "</w>"


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="cookie-notice">We use the cookies of this and that site, and you agree to all of them by being on it.</div>
<article><h1>Head &amp; tail</h1><p><b>The first of the paragraphs is in the middle of the page, and it has many of the words that the
list of stop words has, so that it is by far long enough to be one of the good blocks on its own, which is what we want to see here.<br><p>Short.</p>
<aside>Aside of the article</aside><div class="ad">Buy it now</div></article>
<section id="comments"><p>I like the article and all that it has to say about the matter at hand.</p></section><footer>&copy; me</footer>"""


def test_html_main_text(spark):
    lines = html_text.main_text(PAGE).split("\n")
    assert lines[0] == "Head & tail" and lines[1].startswith("The first of") and lines[2:] == ["Short."]
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "<p>"), (5, "u", "<" * 5000)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html_text.extract(rows).collect()}
    assert got[1].n_chars == len(got[1].text) and all(got[i].text == "" for i in (2, 3, 4))
    assert html_text.extract(rows.limit(0)).count() == 0


def test_doubtful_blocks_follow_their_neighbours():
    block = lambda text: html_text.Block(text, 0, False, False, 0)
    kinds = ["bad", "short", "good", "near", "bad", "short"]
    assert html_text.second_pass([block("x")] * 6, kinds) == [False, False, True, True, False, False]


def test_vector_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=8).round(2).tolist() for i in range(300)}
    vectors |= {300 + i: vectors[0] for i in range(120)}
    rows = [(i, v, "x") for i, v in vectors.items()] + [(500, None, "x"), (501, [1.0, None], "x"), (550, [float("nan")] * 8, "x"), (None, [1.0] * 8, "x")]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = sorted(map(tuple, vector_search.top_inner_products(data, every=50, part_rows=64, query_rows=3, sample_rows=100, pivots=5).collect()))
    z = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    want = []
    for q in (i for i in z if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(z[q], v)), i) for i, v in z.items() if i != q)[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert vector_search.top_inner_products(data.limit(0)).count() == 0


def test_cross_parsing_by_hand():
    parsers = language_id.train({"x": ["abab"], "y": ["bbaa"]}, 100)
    found = parsers.phrases([parsers.symbols(t) for t in ("ababab", "bbaabb", "a?b", "q")])
    assert found.tolist() == [[2, 5], [5, 2], [3, 2 + 1], [1, 1]] or found[0][0] < found[0][1] and found[1][1] < found[1][0]


def test_phrases_equal_a_plain_parser():
    rng = random.Random(5)
    sample = "".join(rng.choice("abcd ") for _ in range(400))
    parsers = language_id.train({"x": [sample]}, 1000)
    known = re.sub(r" +", " ", sample)
    for length in (1, 7, 200):
        text = re.sub(r" +", " ", "".join(rng.choice("abcde ") for _ in range(length)))
        count, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at:end + 1] in known:
                end += 1
            count, at = count + 1, end
        assert parsers.phrases([parsers.symbols(text)]).tolist() == [[count]]


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    words = {"en": ["the", "thing", "with", "other", "and"], "fr": ["le", "une", "avec", "être", "que"]}
    texts = {lang: [prose(rng, w, 40) for _ in range(40)] for lang, w in words.items()}
    known = table(spark, texts["en"][:20], "en").union(table(spark, texts["fr"][:20], "fr")).union(table(spark, ODD, None))
    parsers = language_id.fit(known)
    for lang in words:
        got = language_id.predict(table(spark, texts[lang][20:], None), parsers).collect()
        assert all(r.lang_pred == lang and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.predict(table(spark, ODD), parsers).collect()}
    assert [odd[i].lang_pred == "und" for i in range(len(ODD))] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert language_id.in_known_language(table(spark, ODD), parsers).count() == sum(any(c.isalpha() for c in t or "") for t in ODD)
    nothing = language_id.predict(table(spark, ODD), language_id.fit(table(spark, [])))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for _ in range(12):
        base = prose(rng, words, rng.randint(20, 200)).split()
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    for percent in (80, 85):
        got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, texts), percent=percent).collect()}
        sets = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
            sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        root = list(range(len(texts)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        for i in range(len(texts)):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i), (percent, i)
    stays = near_dedup.without_near_copies(table(spark, texts), percent=85)
    assert sorted(r.doc_id for r in stays.collect()) == [i for i in range(len(texts)) if find(i) == i]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_shingle_intersection():
    a, b = shingle_sets(["a b c d e f g", "b c d e f g h"])
    assert (a.size, b.size, shared(a, b)) == (3, 3, 2)


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 3), (9, 8), (5, 5), (None, 1), *[(20, i) for i in range(21, 40)], *[(i, i + 1) for i in range(50, 75)]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in (1, 2, 3, 4)} | {8: 8, 9: 8} | {i: 20 for i in range(20, 40)} | {i: 50 for i in range(50, 76)}
    assert got == want


def test_url_filter_hands_blocks_on(spark):
    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://A.example.org/en/1", ""), (2, "http://b.net/x", canonical.format("http://c.net/y")), (3, "http://c.net/y.html", None),
        (4, "http://d.net/z", '<meta http-equiv="refresh" content="0; url=http://blocked.com/de/1">'), (5, "http://d.net/z/#f", ""),
        (6, "http://e.org/ok", canonical.format("http://blocked.com/de/1")), (7, None, None), (8, "no scheme", ""), (9, "x://com", ""), (5, "http://d.net/z/#f", ""),
    ]
    rules = url_filter.rules_table(spark, [("allow", "org/"), ("block", "example.org/en/1"), ("block", "com/de/")])
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("rule", F.lit("clash"))
    found = url_filter.judge(pages, rules).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == 10
    assert got[1] == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert [got[i][3] for i in (2, 3, 4, 5, 6)] == ["allow", "allow", "block", "block", "allow"]
    assert got[6][2] == "org/" and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("com", "", None, "allow")
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_quality_separates_junk(spark):
    rng = random.Random(8)
    words = ["the", "of", "and", "house", "garden", "water", "to", "in", "stone", "walk", "light", "is", "far"]
    good = [". ".join(prose(rng, words, 9).capitalize() for _ in range(8)) + "." for _ in range(80)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, words, 60).split()) for _ in range(10)] + [" | ".join(prose(rng, words, 60).split()) for _ in range(10)]
    got = {r.doc_id: r for r in quality.classify(table(spark, good + bad + [None, ""])).collect()}
    assert all(got[i].kept for i in range(80)) and not any(got[i].kept for i in range(80, 100))
    assert got[100].score == got[101].score and all(0 <= r.score <= 1 for r in got.values())
    assert quality.classify(table(spark, [])).count() == 0
