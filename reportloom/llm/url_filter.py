"""URL rules with redirect equivalence: aliases of a blocked page are blocked, an allow rule of their own protects them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportloom.llm.common import ascii_lower
from reportloom.llm.components import components
from reportloom.llm.tags import opening_tags
from reportloom.session import cut_lineage

_BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``rule_host``, ``rule_path``, ``rule``, ``rule_verdict`` from pairs like ``("block", "example.org/es/")``."""
    rows = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        rows.append((host.lower(), slash + path, rule, verdict))
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url``, ``rule`` and ``rule_verdict`` for distinct URLs that a rule fits; the longest wins, then allow.

    A rule fits its host and all subdomains if the path starts with the rule's. A URL asks once for each suffix of its
    host. Up to 100,000 rules are broadcast; a longer list is joined by host suffix.
    """
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host"))
    side = F.broadcast(rules) if rules.count() <= _BROADCAST_RULES else rules
    fits = asked.join(side, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "allow", "rule")
    best = F.max_by(F.struct("rule", "rule_verdict"), rank).alias("best")
    return fits.groupBy("url").agg(best).select("url", "best.*")


def query_of(url: Column) -> Column:
    """``?`` and what follows it after the host, up to ``#`` or the end; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL without what names no other page: scheme, ``www.``, last slash of the path, fragment."""
    bare = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.concat(bare, F.regexp_replace(path_of(url), r"/\z", ""), query_of(url))


_REFRESH = re.compile(r"url\s*=\s*[\"']?\s*([^\"'\s>]+)", re.I)


_TAGS = frozenset("base link meta".split())


def targets_of(url: str, page: str) -> set[str]:
    """Absolute URLs that a page names as its canonical address or redirects to at once.

    A relative target starts from ``<base href>`` or the page's URL; what resolves to no URL is left out.
    """
    base, targets = "", []
    for name, given in opening_tags(page, _TAGS):
        if name == "base":
            base = base or given.get("href", "")
        elif name == "link" and "canonical" in given.get("rel", "").lower().split():
            targets.append(given.get("href", ""))
        elif name == "meta" and given.get("http-equiv", "").lower() == "refresh":
            refresh = _REFRESH.search(given.get("content", ""))
            targets.append(refresh.group(1) if refresh else "")
    found = set()
    for target in filter(None, targets):
        try:
            whole = target if re.match(r"[a-z][a-z0-9+.-]*://", target, re.I) else urljoin(urljoin(url, base), target)
        except ValueError:
            continue
        if "://" in whole:
            found.add(whole)
    return found


def declared_links(pages: DataFrame, url: Column, html: Column) -> DataFrame:
    """Distinct ``url`` and ``target``, both absolute. Only pages that speak of a canonical address or a refresh are parsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [(u, t) for u, page in zip(frame["url"], frame["html"]) for t in targets_of(u, page)]
            yield pd.DataFrame(pairs, columns=["url", "target"])

    found = pages.select(url.alias("url"), html.alias("html")).filter("url like '%://%'").filter(
        F.col("html").rlike(r"(?i)canonical|refresh|&#")
    )
    return found.mapInPandas(run, "url string, target string").distinct()


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``component`` for every page.

    A rule of the page's own decides. Otherwise the page is blocked if an alias is: aliases are the pages and targets in
    one connected component of spellings of one URL (``canonical``) and of canonical or refresh links in the HTML, relative
    ones too. URLs that differ in a query, in ``.html``, ``/index`` or ``m.`` are pages of their own.
    An allow rule protects the page it fits and is not handed on; pages that nothing blocks are allowed. A null or
    hostless URL has no alias. Repeated URLs share a verdict, every row is returned. Runs jobs.
    """
    asked = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    html = F.col(html_col).cast("string") if html_col else F.lit(None).cast("string")
    links = cut_lineage(declared_links(pages, F.col(url_col).cast("string"), html))

    urls = asked.filter("url like '%://%'").select("url").union(links.select("target")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = urls.join(fitting_rules(urls, rules), "url", "left")
    nodes = cut_lineage(ruled.withColumn("address", F.when(F.col("host") != "", canonical(F.col("url")))))

    named = nodes.select("url", "address")
    edges = (
        links.join(named, "url").withColumnRenamed("address", "a")
        .join(named.select(F.col("url").alias("target"), F.col("address").alias("b")), "target").select("a", "b")
    )
    found = components(edges).withColumnRenamed("node", "address")
    placed = nodes.join(found, "address", "left").withColumn("component", F.coalesce("component", "address"))
    blocked = (
        placed.filter("rule_verdict = 'block'").select("component").distinct().withColumn("alias_blocked", F.lit(True))
    )
    verdict = F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    decided = placed.join(blocked, "component", "left").select("url", "host", "path", "rule", verdict.alias("verdict"), "component")
    out = asked.join(cut_lineage(decided), "url", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "component",
    )
