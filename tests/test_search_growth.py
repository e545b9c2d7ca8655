"""Work of the searches that must not grow with queries times rows beyond the product itself."""

import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from check_queries import DATA
from reportloom.operators import search, text_search
from reportloom.plans.views import Views
from test_search_tables import plan_text


def vectors(m):
    return pa.array(m.tolist(), pa.list_(pa.float64()))


def test_only_queries_with_a_new_row_are_sorted_anew(monkeypatch):
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(search.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    draw, queries, rows, k = np.random.default_rng(1), 2000, 1000, 5
    own = [f"c{i % 50}" for i in range(queries)]
    block = search._Queries(pa.table({"query_id": range(queries), "vector": vectors(draw.standard_normal((queries, 4))), "f0": own}), ["f0"], None)
    best = search._Best(queries, k)
    block.meet(pa.table({"id": range(rows), "v": vectors(draw.standard_normal((rows, 4))), "f0": own[:rows]}), best)
    assert len(best.id) == queries * k
    assert sum(sizes) < 4 * queries * k


def test_best_rows_are_exact_and_equal_rows_go_by_id():
    """Words of all and of few queries, copies of rows over blocks of any size, several blocks of queries."""
    draw, rng, k = np.random.default_rng(2), random.Random(2), 7
    q, r = draw.standard_normal((1100, 24)), np.tile(draw.standard_normal((700, 24)), (4, 1))
    r[5], r[9], r[11], r[13] = 0, np.nan, np.inf, 1e-170
    common = ["the", "of", "and"]
    asked = [sorted({*rng.sample(common, rng.randint(0, 3)), f"w{rng.randint(0, 300)}"}) if i % 9 else [] for i in range(len(q))]
    held = [sorted({*rng.sample(common, 2), *(f"w{rng.randint(0, 300)}" for _ in range(6))}) for _ in range(700)] * 4
    ids = rng.sample(range(10000), len(r))
    block = search._Queries(pa.table({"query_id": range(len(q)), "vector": vectors(q), "words": asked}), [], (0.3, 0.7))
    best = search._Best(len(q), k)
    rows = pa.table({"id": ids, "v": vectors(r), "words": held})
    for start, stop in ((0, 3), (3, 2400), (2400, 2401), (2401, 2800)):
        block.meet(rows.slice(start, stop - start), best)
    with np.errstate(all="ignore"):
        unit_q, unit_r = q / np.sqrt((q * q).sum(axis=1))[:, None], r / np.sqrt((r * r).sum(axis=1))[:, None]
    for i in range(0, len(q), 11):
        share = np.array([len(set(asked[i]) & set(h)) for h in held]) / max(1, len(asked[i]))
        with np.errstate(all="ignore"):
            score = 0.3 * share + 0.7 * (unit_q[i] * unit_r).sum(axis=1)
        want = sorted((-s, n) for s, n in zip(score, ids) if np.isfinite(s))[:k]
        mine = best.query == i
        assert list(zip(-best.score[mine], best.id[mine])) == want


def test_terms_are_found_in_bytes_as_in_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abåé😀 \n", k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(400)] + ["ab" * 700000 + "å"]
    terms = sorted({t[i : i + n] for t in texts[:40] for i in (0, 3) for n in (1, 2, 3, 6, 12) if t[i : i + n]} | {"", "a%b", "_å", "zzz"})
    needed = {t: text_search._needed(max(t.replace("_", "%").split("%"), key=len)).tolist() if t else [0] for t in terms}
    anchors = {t: rng.choice(own) for t, own in needed.items()}
    searches = text_search._Searches(pa.table({"query_id": range(len(terms)), "terms": [[t] for t in terms]}), anchors, [])
    column = pa.array(["skipped", *texts]).slice(1)
    got = [(row, term) for row, text, term, _ in searches.candidates(column, [()] * len(texts)) if searches.holds(text, term)]
    want = [(i, t) for i, text in enumerate(texts) for t in terms if text_search._as_regex(t).match(text)]
    assert sorted(got) == want and len(set(got)) == len(got)


def test_terms_asked_of_no_row_are_not_looked_for():
    asked = pa.table({"query_id": [1, 2, 3], "terms": [["the"], ["the"], ["yea"]], "f0": ["nobody", "c1", "c2"]})
    searches = text_search._Searches(asked, {t: int(text_search._needed(t)[0]) for t in ("the", "yea")}, ["f0"])
    assert not list(searches.candidates(pa.array(["the year"] * 3), [("c3",), (None,), ("c4",)])) and not searches.terms.terms
    assert [(row, term, own) for row, _, term, own in searches.candidates(pa.array(["the year", "the year"]), [("c1",), ("c3",)])] == [(0, "the", [1])]


def test_texts_are_read_once_for_the_hits_and_only_hits_are_dealt_out(spark):
    v = Views(spark, str(DATA))
    hits = search.search_sections(v["searchable_sections"], v["searches"].withColumnRenamed("term", "text"), 10)
    plan = plan_text(hits)
    assert plan.count("text:string") == 1 and "LeftSemi" in plan


def test_many_queries_are_scored_in_few_tasks(spark, monkeypatch):
    """Each task sends its best rows of each query, so tasks times queries must stay small."""
    monkeypatch.setattr(search, "_SENT", 60, raising=False)
    rows = spark.range(300, numPartitions=100).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    queries = spark.range(30).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    scored = search._scores(rows, queries, 2, "embedding", {}, None, 1 << 25, 1 << 26)
    assert scored.select(F.spark_partition_id()).distinct().count() == 4 * spark.sparkContext.defaultParallelism
    assert search.top_k(rows, queries, 2).count() == 60
