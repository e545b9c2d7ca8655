"""Searches for a table of queries, against plain versions."""

import io
import math
import random
import re
from contextlib import redirect_stdout

import numpy as np
import pytest

from pyspark.sql import functions as F

from reportloom.operators import search, text_search

SECTIONS = "id bigint, slug string, title string, content string, embedding array<float>, period_id bigint, section_type string, page_number int"
QUERIES = "query_id bigint, text string, vector array<double>, company_slug string"
WORDS = [f"ord{i}" for i in range(30)]


def section_rows(count=200, seed=1):
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    rows = []
    for i in range(count):
        vector = draw.standard_normal(6).round(1).tolist() if i % 7 else None
        if i % 5 == 0:
            vector = [1.0, 2.0, 0.0, 0.0, 0.0, 0.5]  # a third of what scores is one vector
        odd = {11: [0.0] * 6, 12: [1.0] * 4, 13: [None] + [1.0] * 5, 16: [math.nan] * 6, 17: []}
        content = " ".join(rng.choices(WORDS, k=12)) + rng.choice([".", " ÅÄÖ!", ", X"])
        rows.append((i, f"c{i % 4}" if i % 9 else None, f"t{i}", None if i == 3 else content, odd.get(i, vector), i % 3, "narrative", i % 20))
    return rows


def query_rows(count=40, seed=2):
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    rows = []
    for i in range(count):
        vector = None if i % 8 == 7 else [1.0, 2.0, 0.0, 0.0, 0.0, 0.5] if i % 8 == 6 else draw.standard_normal(6).tolist()
        text = " ".join(rng.choices(WORDS, k=3)).upper() if i % 5 else ["", "  "][i % 2]
        rows.append((i, text, vector, f"c{i % 5}" if i % 3 == 0 else None))
    return rows + [(900, "ord1", [0.0] * 6, None), (901, "ord1", [1.0] * 3, None), (902, None, [1.0] * 4, None)]


def scored(sections, queries, weights=None):
    """query -> [(score, id)] of every hit, best first."""
    out = {}
    for q, text, vector, company in queries:
        hits = []
        for i, slug, _, content, embedding, *_ in sections:
            if vector is None or embedding is None or len(vector) != len(embedding) or (company is not None and company != slug):
                continue
            if any(c is None or math.isnan(c) for c in embedding):
                continue
            a, b = np.array(vector), np.array(embedding, dtype=np.float32).astype(float)
            if not a.any() or not b.any():
                continue
            score = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
            if weights:
                wanted = set((text or "").lower().split())
                have = set(re.split(r"[^\w]+", (content or "").lower()))
                score = weights[0] * len(wanted & have) / max(1, len(wanted)) + weights[1] * score
            hits.append((score, i))
        out[q] = sorted(hits, key=lambda h: (-round(h[0], 9), h[1]))
    return out


def tables(spark):
    return spark.createDataFrame(section_rows(), SECTIONS).repartition(6), spark.createDataFrame(query_rows(), QUERIES)


def by_query(rows, k):
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r)
    return {q: sorted(own, key=lambda r: r["place"]) for q, own in found.items()}


@pytest.mark.parametrize("weights", [None, (0.3, 0.7)])
@pytest.mark.parametrize("sizes", [{}, {"query_bytes": 700, "row_bytes": 2000}])
def test_top_k_matches_a_plain_version(spark, weights, sizes):
    sections, queries = tables(spark)
    got = by_query(search.top_k(sections, queries, 5, filters={"company_slug": "slug"}, weights=weights, **sizes).collect(), 5)
    want = {q: hits[:5] for q, hits in scored(section_rows(), query_rows(), weights).items() if hits}
    assert set(got) == set(want)
    for q, hits in want.items():
        assert [r["place"] for r in got[q]] == list(range(1, len(hits) + 1))
        assert [round(r["score"], 6) for r in got[q]] == [round(s, 6) for s, _ in hits]
        assert [r["id"] for r in got[q]] == [i for _, i in hits] or len({round(s, 9) for s, _ in hits}) < len(hits)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, None, "t", "x", [1.0, 1.0], 1, "s", 1) for i in range(500)]
    sections = spark.createDataFrame(rows, SECTIONS).repartition(9)
    queries = spark.createDataFrame([(1, "x", [2.0, 2.0], None), (2, "y", [-1.0, -1.0], None)], QUERIES)
    for sizes in ({}, {"query_bytes": 100, "row_bytes": 4000}):
        got = by_query(search.top_k(sections, queries, 4, **sizes).collect(), 4)
        assert {q: [r["id"] for r in own] for q, own in got.items()} == {1: [0, 1, 2, 3], 2: [0, 1, 2, 3]}


def test_small_blocks_of_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "_CELLS", 7)
    block = search._Queries(tables(spark)[1].select("query_id", "vector").filter("vector is not null").toArrow(), [], None)
    best = search._Best(len(block), 3)
    block.meet(tables(spark)[0].select("id", F.col("embedding").alias("v")).toArrow(), best)
    want = scored(section_rows(), [(q, t, v, None) for q, t, v, _ in query_rows()])
    assert len(best.id) == sum(min(3, len(h)) for h in want.values())


def test_string_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(c, [float(i), 1.0]) for i, c in enumerate("dcba")], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, "x", [1.0, 0.0], None)], QUERIES)
    assert [r["id"] for r in search.top_k(rows, queries, 2).orderBy("place").collect()] == ["a", "b"]
    assert search.top_k(rows.limit(0), queries, 2).count() == 0 and search.top_k(rows, queries.limit(0), 2).count() == 0


def plan_text(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_the_plan_does_not_grow_with_the_queries(spark, tmp_path):
    tables(spark)[0].write.parquet(f"{tmp_path}/s")
    sections = spark.read.parquet(f"{tmp_path}/s")
    draw = np.random.default_rng(3)
    many = [(i, "ord1 ord2", draw.standard_normal(6).tolist(), f"c{i % 4}") for i in range(1000)]
    plans = []
    for count in (2, 1000):
        queries = spark.createDataFrame(many[:count], QUERIES)
        found = search.top_k(sections, queries, 3, filters={"company_slug": "slug"}, weights=(0.3, 0.7))
        plans.append(plan_text(found))
        assert by_query(found.collect(), 3).keys() == set(range(count))
    assert abs(len(plans[0]) - len(plans[1])) < 100
    assert plans[1].count("Scan parquet") == plans[0].count("Scan parquet") <= 2 and plans[1].count("MapInArrow") <= 2
    tree = plans[1].split("\n\n")[0]
    assert tree.index("Exchange") < tree.rindex("WindowGroupLimit") < tree.index("MapInArrow")


TEXTS = ["Hello World", "ÅRET var bra 50% off", None, "", "a_b a\\b", "xxxhello", "ab\nab", "über 漢字カ", "HELLO hello", "y" * 5000 + "needle" + "z" * 5000]
TERMS = ["hello", "året", "", "a_b", "a\\_b", "0\\%", "o%w", "zzz", "x", "ab", "b\na", "漢字カ", "HELLO w", "\\\\b", None, "lo\\", "%%", "_", "NEEDLE", "yz", "h%o w"]


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("rounds", [1, 3])
def test_matches_equal_ilike(spark, tmp_path, stored, rounds):
    texts = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(TEXTS * 3)], "id bigint, part int, text string").repartition(5)
    terms = spark.createDataFrame(list(enumerate(TERMS)), "query_id bigint, term string")
    index = None
    if stored:
        text_search.store_postings(text_search.postings(texts), f"{tmp_path}/index")
        index = spark.read.parquet(f"{tmp_path}/index")
    got = sorted((r[0], r[1]) for r in text_search.matches(texts, terms, index, rounds).collect())
    want = [
        (q, r["id"]) for q, term in enumerate(TERMS) if term is not None
        for r in texts.filter(F.ilike("text", F.lit(f"%{term}%"))).select("id").collect()
    ]
    assert got == sorted(want)


def test_a_long_text_is_posted_in_pieces(monkeypatch):
    text = "".join(random.Random(4).choices("abcdefgh", k=5000))
    whole = text_search._runs(text, shorter=True)
    monkeypatch.setattr(text_search, "_PIECE", 17)
    assert text_search._runs(text, shorter=True).tolist() == whole.tolist()
    assert len(whole) == 1 + len({text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)})


def test_many_wanted_runs_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "id bigint, part int, text string")
    terms = spark.createDataFrame([(0, "hello"), (1, "qqq")], "query_id bigint, term string")
    want = sorted(tuple(r) for r in text_search.matches(texts, terms).collect())
    monkeypatch.setattr(text_search, "_PASSED_ON", 2)
    assert sorted(tuple(r) for r in text_search.matches(texts, terms).collect()) == want == [(0, 0), (0, 5), (0, 8)]


def test_rare_terms_read_few_postings(spark):
    """A term of common and rare runs goes by the rare ones."""
    texts = [(i, 0, "the report of the year" + (" quartz" if i == 77 else "")) for i in range(400)]
    table = spark.createDataFrame(texts, "id bigint, part int, text string")
    lists = text_search.postings(table)
    needed = text_search.term_runs(spark.createDataFrame([(1, "year quartz")], "query_id bigint, term string"))
    sizes = sorted(r["count"] for r in lists.join(needed, "gram").groupBy("gram").count().collect())
    assert sizes[:3] == [1, 1, 1] and sizes[-1] == 400
    assert [r["id"] for r in text_search.matches(table, needed.select("query_id", "term").distinct()).collect()] == [77]


def test_knowledge_texts_for_a_table(spark):
    entries = spark.createDataFrame(
        [(1, "d1", "c1", "Alpha one", "first"), (2, "d1", "c2", "beta", "ALPHA two"), (3, "d2", "c1", None, "one/two"), (4, "d2", "c2", "gamma", None)],
        "id bigint, domain string, category string, title string, content string",
    )
    asked = [(1, "alpha", None, None), (2, "alpha", None, "c2"), (3, "gamma/first", None, None), (4, "one two", "d2", None),
             (5, "", None, None), (6, "gamma first beta", None, None)]
    queries = spark.createDataFrame(asked, "query_id bigint, text string, domain string, category string")

    def found(k=5, most=None):
        rows = search.search_knowledge_texts(entries, queries, k, most).orderBy("query_id", "id").collect()
        return {q: [r["id"] for r in rows if r["query_id"] == q] for q, *_ in asked}

    assert found() == {1: [1, 2], 2: [2], 3: [1, 4], 4: [3], 5: [1, 2, 3, 4], 6: [1, 2, 4]}
    assert found(1)[5] == [1] and found(5, 1)[6] == [4]
    for q, text, domain, category in asked:
        one = search.search_knowledge_text(entries, text, 5, domain, category).collect()
        assert [r["id"] for r in one] == found()[q]


def test_search_chain_for_a_table(spark):
    sections, queries = tables(spark)
    got = by_query(search.search_sections(sections, queries, 5).collect(), 5)
    hybrid = {q: hits for q, hits in scored(section_rows(), query_rows(), (0.3, 0.7)).items() if hits}
    for q, text, _, company in query_rows():
        if q in hybrid:
            assert {r["search_type"] for r in got[q]} == {"hybrid"} and len(got[q]) == min(5, len(hybrid[q]))
        else:
            held = [
                i for i, slug, _, content, *_ in section_rows()
                if text is not None and content is not None and text.lower() in content.lower() and company in (None, slug)
            ][:5]
            assert [r["id"] for r in got.get(q, [])] == held and all(r["search_type"] == "text" for r in got.get(q, []))
    only_text = search.search_sections(sections, queries, 5, use_hybrid=False, use_vector=False)
    assert {r["search_type"] for r in only_text.collect()} == {"text"}
