"""Blocks over linked pages against a plain union-find."""

import html
import random
import re
import time
from urllib.parse import urljoin

import pytest

from reportloom.llm import tags, url_filter

RULES = [("block", "com/de/"), ("allow", "org/"), ("block", "bad.org/x/"), ("allow", "com/de/ok")]


def rule_of(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = found.group(1).lower(), found.group(2)
    fits = [
        (len(rule), verdict) for verdict, rule in RULES
        if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.partition("/")[2])
    ]
    return max(fits)[1] if fits else None


def spelling(url):
    host, path, query = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url).groups()
    return re.sub(r"^www\.", "", host.lower()) + re.sub(r"/\Z", "", path) + (query or "")


def web(seed):
    """Chains, cycles and stars of redirects among pages of a few hosts, targets written in many ways."""
    draw = random.Random(seed)
    urls = [f"http://{h}/{p}{i}{q}" for i in range(60) for h, p, q in draw.sample([
        ("a.net", "p", ""), ("www.b.com", "de/", ""), ("b.com", "en/", "?x"), ("c.org", "n", ""), ("bad.org", "x/", ""), ("d.net", "q/", f"?id={i % 3}"),
        ("b.com", "de/ok", ""), ("e.net", "s", "/")], 4)]
    rows, links = [], []
    for n, url in enumerate(urls):
        target = draw.choice(urls[max(0, n - 8) : n + 8]) if draw.random() < 0.6 else None
        page = "<p>text</p>"
        if target:
            links.append((url, target))
            shown = html.escape(target) if draw.random() < 0.5 else "".join(f"&#{ord(c)};" for c in target)
            page = draw.choice([
                f'<link rel="canonical" href="{shown}">', f"<LINK data-href='x' HREF='{shown}' rel='alternate  Canonical'/>",
                f'<meta http-equiv="refresh" content="0; url={shown}">', f"<link href={shown} rel=canonical>",
            ])
        else:  # none of these is a link
            other = draw.choice(urls)
            page += draw.choice([
                "", f'<!-- <link rel="canonical" href="{other}"> -->', f'<script>var s = \'<link rel="canonical" href="{other}">\';</script>',
                f'<link rel="canonical-x" href="{other}">', f'<a rel="canonical" href="{other}">', f'<link rel="canonical" data-href="{other}">',
            ])
        rows.append((n, url, page))
    rows.append((len(urls), "http://a.net/rel/page", '<base href="http://b.com/de/"><link rel="canonical" href="../de/./y#z">'))
    links.append(("http://a.net/rel/page", urljoin("http://b.com/de/", "../de/./y#z")))
    return rows, links


def test_blocks_follow_a_union_find(spark):
    moved = 0
    for seed in (1, 2):
        rows, links = web(seed)
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(spelling(a))] = root(spelling(b))
        known = {url for _, url, _ in rows} | {b for _, b in links}
        blocked = {root(spelling(u)) for u in known if rule_of(u) == "block"}
        want = {n: rule_of(url) or ("block" if root(spelling(url)) in blocked else "allow") for n, url, _ in rows}
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.rules_table(spark, RULES)).collect()}
        assert got == want
        moved += sum(rule_of(url) is None and want[n] == "block" for n, url, _ in rows)
    assert moved > 50


def test_bare_queries_are_pages(spark):
    rows = [(1, "http://a.net/v?17", '<link rel="canonical" href="http://b.com/de/1">'), (2, "http://a.net/v?18", ""), (3, "https://www.a.net/v/?17#x", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = url_filter.judge(pages, url_filter.rules_table(spark, RULES)).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "allow", 3: "block"}


@pytest.mark.parametrize("text", [
    "<a " * 200_000, "<link " * 100_000, '<link rel="' * 50_000, "<!--" * 100_000, "<script>" * 50_000, '<a "" ' * 100_000 + '" >',
    "<meta http-equiv=refresh content='" * 30_000, "<link rel='\"" * 30_000 + "'\">", "</" * 200_000,
])
def test_broken_pages_end_soon(text):
    begin = time.process_time()
    url_filter.targets_of("http://a.net/", text)
    assert time.process_time() - begin < 5


def test_tags_end_as_a_plain_search_says():
    plain = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    draw = random.Random(3)
    for _ in range(400):
        page = "".join(draw.choices("<a '\">", [4, 3, 2, 1, 1, 1], k=40))
        ends = tags.TagEnds(page)
        for at in range(len(page)):
            found = plain.match(page, at)
            assert ends.after(at) == (found.end() if found else -1)
