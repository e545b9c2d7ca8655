"""Aliases that a page declares, and none that are made up."""

from reportloom.llm import url_filter


def test_queries_are_pages_and_relative_targets_are_links(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.net/?p=1", link.format("http://blocked.com/de/1")), (2, "http://a.net/?p=2", ""), (3, "https://www.a.net?p=1#x", ""),
        (4, "http://blocked.com/x/y", link.format("/de/9")), (5, "http://blocked.com/x/z", link.format("../de/9")),
        (6, "http://b.net/x", link.format("//www.blocked.com/de/1")), (7, "http://b.net/x.html", ""),
        (8, "http://c.net/a", '<base href="http://blocked.com/de/"><meta http-equiv="refresh" content="0; url=q">'),
        (9, "http://d.net/a", link.format("/login?next=http://blocked.com/de/1")), (10, "http://e.net/a", link.format("mailto:x")),
        (11, "http://f.net/a", link.format("http://[bad/")), (12, "http://m.b.net/x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    rules = url_filter.rules_table(spark, [("block", "com/de/")])
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()}
    assert {i for i, v in found.items() if v == "block"} == {1, 3, 4, 5, 6, 8} and len(found) == 12
