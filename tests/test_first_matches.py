"""The first hits of each query, against all hits in order."""

import random
import time

import pytest

from pyspark.sql import functions as F

from check_queries import DATA
from reportloom.operators import search, text_search
from reportloom.plans.views import Views
from test_search_tables import TERMS, TEXTS, plan_text


def plain(spark, texts, asked, k):
    """First ``k`` ids of each query by ILIKE."""
    want = {}
    for q, term, slug in asked:
        if term is not None:
            held = texts.filter(F.ilike("text", F.lit(f"%{term}%")) & F.lit(True if slug is None else F.col("slug") == slug))
            want.setdefault(q, set()).update(r["id"] for r in held.select("id").collect())
    return {q: sorted(ids)[:k] for q, ids in want.items() if ids}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
        assert r["place"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sizes", [{}, {"first": 5, "growth": 2}, {"first": 3, "growth": 4, "term_bytes": 400}])
@pytest.mark.parametrize("stored", [False, True])
def test_first_matches_are_the_first_of_all(spark, tmp_path, sizes, stored):
    rows = [(i // 2, i % 2, t, f"c{i // 2 % 3}") for i, t in enumerate(TEXTS * 6)]
    random.Random(1).shuffle(rows)
    texts = spark.createDataFrame(rows, "id bigint, part int, text string, slug string").repartition(4)
    asked = [(i, t, [None, "c1", "nobody"][i % 3]) for i, t in enumerate(TERMS)] + [(90, "hello", None), (90, "yz", None), (91, "hello", None), (92, "", None)]
    terms = spark.createDataFrame(asked, "query_id bigint, term string, company string")
    index = None
    if stored:
        text_search.store_postings(text_search.postings(texts), f"{tmp_path}/index")
        index = spark.read.parquet(f"{tmp_path}/index")
    assert found(text_search.first_matches(texts, terms, 3, index, {"company": "slug"}, **sizes)) == plain(spark, texts, asked, 3)


def test_string_ids_no_terms_and_no_texts(spark):
    texts = spark.createDataFrame([(c, 0, "needle") for c in "dcba"], "id string, part int, text string")
    terms = spark.createDataFrame([("q", "needle")], "query_id string, term string")
    assert found(text_search.first_matches(texts, terms, 2, first=1, growth=2)) == {"q": ["a", "b"]}
    assert text_search.first_matches(texts, terms.limit(0), 2).count() == 0 and text_search.first_matches(texts.limit(0), terms, 2).count() == 0


def test_frequent_terms_make_few_rows(spark, monkeypatch):
    """Every text holds every term: a task hands on the first ids only, and later ranges are not asked."""
    seen = []
    look = text_search._look
    monkeypatch.setattr(text_search, "_look", lambda *a: seen.append(look(*a).count()) or look(*a))
    sections = spark.range(4000, numPartitions=4).select("id", F.lit("the report of the year").alias("content"), F.lit("s").alias("slug"), F.lit("t").alias("title"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.element_at(F.array(*[F.lit(x) for x in ("the", "year", "rep", "of")]), (F.col("id") % 4 + 1).cast("int")).alias("text"))
    got = found(search.text_hits(sections, queries, 2))
    assert got == {q: [0, 1] for q in range(300)}
    assert len(seen) == 1 and seen[0] <= 4 * 4 * 2


def test_many_wildcards_in_a_row_are_fast():
    start = time.time()
    assert not text_search._as_regex("%%%% of%%%% x%%% y%%").match("f of " * 40000)
    assert text_search._as_regex("%%%% of%%%% f%%").match("f of " * 40000) and time.time() - start < 5


def test_frequent_terms_of_entries_are_not_joined_with_all_texts(spark, monkeypatch):
    monkeypatch.setattr(text_search, "matches", None)  # the step that makes every hit
    entries = spark.range(600, numPartitions=3).select(
        "id", F.lit("d").alias("domain"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("category"), F.lit("entry 7").alias("title"), F.lit("text").alias("content")
    )
    queries = spark.createDataFrame([(1, "try/7", None, None), (2, "text", "d", "c1"), (3, "text", "e", None)], "query_id int, text string, domain string, category string")
    got = found(search.search_knowledge_texts(entries, queries, 2))
    assert got == {1: [0, 1], 2: [1, 3]}


def test_ranges_of_entries_are_cut_without_their_texts(spark, monkeypatch):
    plans, ranges = [], text_search._ranges
    monkeypatch.setattr(text_search, "_ranges", lambda ids, *a: plans.append(plan_text(ids)) or ranges(ids, *a))
    v = Views(spark, str(DATA))
    assert search.search_knowledge_texts(v["knowledge"], v["searches"].withColumnRenamed("entry_text", "text"), 20).count()
    assert len(plans) == 1 and "ReadSchema" in plans[0] and "text:string" not in plans[0]


def test_the_first_range_is_not_one_task(spark, monkeypatch):
    """Every query is asked in the first range, so its few bytes must not lie in one partition."""
    tasks, look = [], text_search._look
    monkeypatch.setattr(text_search, "_look", lambda texts, *a: tasks.append(texts.select(F.spark_partition_id()).distinct().count()) or look(texts, *a))
    texts = spark.range(400, numPartitions=1).select("id", F.lit(0).alias("part"), F.lit("a needle").alias("text"))
    terms = spark.createDataFrame([(1, "needle"), (2, "a n")], "query_id int, term string")
    assert found(text_search.first_matches(texts, terms, 2)) == {1: [0, 1], 2: [0, 1]}
    assert tasks == [spark.sparkContext.defaultParallelism]
