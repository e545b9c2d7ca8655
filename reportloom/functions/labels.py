"""Row-label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reportloom.functions.text import strip
from reportloom.vocabulary import LABEL_SYNONYMS, PLACEHOLDER_LABEL_PATTERNS


def row_key(name: Column) -> Column:
    """Row name as compared across periods: lower case, brackets with content dropped."""
    single = F.replace(strip(F.lower(name)), F.lit("  "), F.lit(" "))
    return F.coalesce(F.regexp_replace(single, r"(?U)\s*\([^)]*\)", ""), F.lit(""))


def is_year_label(label: Column) -> Column:
    return strip(label).rlike(r"^(19|20)[0-9]{2}$")


def is_placeholder_label(label: Column) -> Column:
    pattern = "(?U)^(?:" + "|".join(PLACEHOLDER_LABEL_PATTERNS) + ")$"
    text = F.coalesce(label, F.lit(""))
    return ~is_year_label(text) & strip(F.lower(text)).rlike(pattern)


def row_class(explicit: Column, name: Column) -> Column:
    """``total``, ``subtotal`` or ``data``; an explicit total or subtotal wins."""
    low = F.lower(F.coalesce(name, F.lit("")))
    summed = F.contains(low, F.lit("summa")) | F.contains(low, F.lit("total"))
    balance = F.contains(low, F.lit("tillgångar")) | F.contains(low, F.lit("skulder"))
    return (
        F.when(explicit.isin("total", "subtotal"), explicit)
        .when(summed & balance, "total")
        .when(summed, "subtotal")
        .otherwise("data")
    )


def seed_canonical(label: Column) -> Column:
    """English label to its canonical form by the built-in spellings, else itself in lower case."""
    low = strip(F.lower(label))
    pairs = [F.lit(x) for canonical, words in LABEL_SYNONYMS.items() for word in words for x in (word, canonical)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), low), low)
