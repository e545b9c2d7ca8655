"""Type and severity expressions driven by the word lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from reportloom.functions.text import contains_any, count_contained, let
from reportloom.vocabulary import (
    QUARTERLY_TITLE_WORDS,
    SECTION_TYPE_KEYWORDS,
    SEVERITY_CLASS,
    SEVERITY_DEFAULT,
    TABLE_TYPE_KEYWORDS,
)


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda acc, case: F.when(case[0], case[1]).otherwise(acc), reversed(cases), default)


def mapped_table_type(table_type: Column, title: Column) -> Column:
    """Stored type; a quarterly table takes the type its title names."""
    by_title = let(
        F.lower(_empty(title)),
        lambda low: _chain([(contains_any(low, ws), F.lit(t)) for t, ws in QUARTERLY_TITLE_WORDS], F.lit("other")),
    )
    kind = F.coalesce(table_type, F.lit("other"))
    return F.when(kind == "quarterly", by_title).otherwise(kind)


def table_search_text(title: Column, columns: Column, labels: Column) -> Column:
    """Lower-case title, headers and the first ten row labels, blank entries left out."""
    kept = F.filter(columns, lambda c: F.coalesce(c, F.lit("")) != "")
    first = F.filter(F.slice(labels, 1, 10), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.lower(F.concat_ws(" ", _empty(title), F.array_join(kept, " "), F.array_join(first, " ")))


def keyword_table_type(title: Column, columns: Column, labels: Column) -> Column:
    """Type with most keyword hits; the earlier type on equal scores, ``other`` without a hit."""
    kinds = F.array(*[F.lit(kind) for kind in TABLE_TYPE_KEYWORDS])
    scores = let(
        table_search_text(title, columns, labels),
        lambda text: F.array(*[count_contained(text, words) for words in TABLE_TYPE_KEYWORDS.values()]),
    )
    best = let(scores, lambda s: F.when(F.array_max(s) > 0, F.get(kinds, F.array_position(s, F.array_max(s)).cast("int") - 1)))
    return F.coalesce(best, F.lit("other"))


def keyword_section_type(title: Column, content: Column) -> Column:
    text = F.lower(F.concat(_empty(title), F.lit(" "), F.substring(_empty(content), 1, 500)))
    return let(
        text, lambda t: _chain([(contains_any(t, ws), F.lit(k)) for k, ws in SECTION_TYPE_KEYWORDS.items()], F.lit("other"))
    )


def severity_class(error_type: Column) -> Column:
    return _chain(
        [(error_type.isin(types), F.lit(name)) for name, types in SEVERITY_CLASS.items()], F.lit(SEVERITY_DEFAULT)
    )
