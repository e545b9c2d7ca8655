"""Titles of a few sections each are settled many at once."""

from reportloom.operators import databook
from test_search_tables import plan_text


def test_titles_share_a_task(spark, monkeypatch):
    plans = []
    cut = databook.cut_lineage
    monkeypatch.setattr(databook, "cut_lineage", lambda df: plans.append(plan_text(df)) or cut(df))
    rows = [(i % 7, f"t{i}", i, "abc def") for i in range(400)] + [(1, "x", 1000 + i, t) for i, t in enumerate(["abc", "cab", "abcx", "qrs", "", "abca"])]
    sections = spark.createDataFrame(rows, "company_id bigint, title string, section_no bigint, content string")
    for block in (256, 2):
        got = {r["section_no"] for r in databook.unique_by_title(sections, block=block).collect()}
        assert got == {*range(400), 1000, 1002, 1003, 1004}
    assert not any("FlatMapGroups" in p for p in plans)
