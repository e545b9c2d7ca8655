"""What near-duplicate detection stores and holds: rounds of linking, components linked on, arrays of a batch of texts."""

import random
import tracemalloc

import pytest

from reportloom.llm import common, components, near_dedup
from reportloom.llm.shingles import shingle_sets


@pytest.fixture
def steps(monkeypatch):
    """A list that gets an entry for every star step."""
    taken, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda edges, small: (taken.append(small), star(edges, small))[1])
    return taken


def test_stars_need_no_round(spark, steps):
    links = [(1, 5), (6, 1), (1, 5), (7, 7), (None, 2), *[(i, 20) for i in range(21, 40)]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 5: 1, 6: 1} | {i: 20 for i in range(20, 40)}
    assert not steps


def test_final_stars_are_not_run_again(spark, steps):
    links = [(2, 1), (3, 2), (13, 12), (12, 11)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11}
    assert steps == [False, True]


def test_components_are_linked_on(spark, monkeypatch):
    """The second linking sees components that meet, not every link again; the classes are the same."""
    asked, whole = [], components.components
    monkeypatch.setattr(near_dedup, "components", lambda links: (asked.append(links), whole(links))[1])
    rng = random.Random(3)
    chain = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(chain[i * 8:i * 8 + 120]) for i in range(24)]  # each is near its neighbours only
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, percent=80).collect()}
    assert got == dict.fromkeys(range(24), 0)
    assert len(asked) == 2
    nodes = {r.component for r in whole(asked[0]).collect()} | {i for i in range(24)} - {r.node for r in whole(asked[0]).collect()}
    assert {x for r in asked[1].collect() for x in r} <= nodes


def test_memory_of_a_batch():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(250)) for _ in range(2000)]
    tracemalloc.start()
    sets = shingle_sets(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(sets) == 2000 and peak - held < 40 << 20


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_rows_that_go(spark, monkeypatch, most):
    """A few keys that go are brought to the rows, whose texts are not dealt out; many are joined, with the same rows."""
    monkeypatch.setattr(common, "_BROADCAST_KEYS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("id", "cast(id as string) as text")
        left = common.without_rows(rows, "id", spark.range(0, 1000, 3).toDF("x"), ["id", "text"])
        assert sorted(r.id for r in left.collect()) == [i for i in range(1000) if i % 3]
        assert ("Exchange hashpartitioning" in left._jdf.queryExecution().executedPlan().toString()) == (most == 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
