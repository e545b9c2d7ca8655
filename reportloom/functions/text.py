"""Text expressions: trimming, cutting, excerpts, line kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, also the no-break space Spark's ``trim`` keeps."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of the literal words occur in ``text``."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def cut(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def excerpt(text: Column, query: Column, around: int = 100, head: int = 200) -> Column:
    """Text around the first hit in any case, else the head of the text."""
    hit = F.position(F.lower(query), F.lower(text))
    start = F.greatest(F.lit(0), hit - 1 - around)
    stop = F.least(F.length(text), hit - 1 + F.length(query) + around)
    return F.when(
        hit > 0, F.concat(F.lit("..."), F.substring(text, start + 1, stop - start), F.lit("..."))
    ).otherwise(F.concat(F.substring(text, 1, head), F.lit("...")))


def line_kind(line: Column) -> Column:
    """``bullet``, ``subheader`` or ``text`` for one stripped, non-empty line."""
    marked = line.rlike(r"^[•*–-] ")
    numbered = (F.length(line) > 2) & line.rlike(r"(?U)^\d[.):]")
    words = F.size(F.split(line, r"(?U)\s+"))
    short_title = (F.length(line) <= 50) & (words <= 6) & ~line.rlike(r"[.,]$")
    return F.when(marked | numbered, "bullet").when(short_title, "subheader").otherwise("text")
