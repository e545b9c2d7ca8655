"""Slugs, report language, company names and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reportloom.functions.text import let, strip
from reportloom.vocabulary import (
    CANONICAL_FILE_PATTERN,
    COMPANY_FILE_PATTERNS,
    COMPANY_SUFFIX,
    COMPANY_TEXT_PATTERNS,
    COMPANY_TEXT_SUFFIX,
    ENGLISH_WORDS,
    NORWEGIAN_WORDS,
    NOT_A_COMPANY,
    ONLY_NORWEGIAN_WORDS,
    ONLY_SWEDISH_WORDS,
    STRONG_ENGLISH_WORDS,
    SWEDISH_WORDS,
)


def slug(name: Column) -> Column:
    """Company slug; letters of any language stay."""
    kept = F.regexp_replace(strip(F.lower(name)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), r"^-+|-+$", "")


def ascii_slug(name: Column) -> Column:
    """Slug for paths: Nordic letters folded to ASCII."""
    return slug(F.translate(F.lower(name), "åäöøæéü", "aaooaeu"))


def file_slug(company: Column) -> Column:
    """Slug inside a report file name; runs of hyphens stay."""
    kept = F.regexp_replace(F.lower(company), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), r"^-+|-+$", "")


def language(text: Column) -> Column:
    """``sv``, ``no`` or ``en`` by indicator words; Swedish when nothing decides.

    The text is searched once for every word of any list; the lists are then counted among the hits.
    """
    lists = [
        SWEDISH_WORDS, NORWEGIAN_WORDS, ENGLISH_WORDS, STRONG_ENGLISH_WORDS, ONLY_NORWEGIAN_WORDS, ONLY_SWEDISH_WORDS
    ]

    def words(values: list[str]) -> Column:
        return F.array(*[F.lit(w) for w in values])

    def decide(n: Column) -> Column:
        sv, no, en, strong, only_no, only_sv = (n[i] for i in range(len(lists)))
        nordic = (sv > 0) | (no > 0)
        return (
            F.when((strong >= 2) | (en > F.greatest(sv, no)), "en")
            .when(nordic & ((only_no > only_sv) | ((only_no == only_sv) & (no > sv))), "no")
            .otherwise("sv")
        )

    every = words(list(dict.fromkeys(w for values in lists for w in values)))
    hits = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(every, lambda w: F.contains(low, w)))
    counts = let(hits, lambda h: F.array(*[F.size(F.array_intersect(h, words(values))) for values in lists]))
    return let(counts, decide)


def _trim_marks(name: Column) -> Column:
    return F.regexp_replace(name, r"^[ _-]+|[ _-]+$", "")


def clean_company(name: Column) -> Column:
    bare = F.regexp_replace(name, "(?iU)" + COMPANY_SUFFIX, "")
    return _trim_marks(strip(F.regexp_replace(bare, r"(?U)\s+", " ")))


def company_name(text: Column, stem: Column) -> Column:
    """Company named by the file name, else by the text; null when neither names one."""

    found = [_trim_marks(F.regexp_extract(stem, "(?iU)" + p, 1)) for p in COMPANY_FILE_PATTERNS]
    for pattern in COMPANY_TEXT_PATTERNS:
        name = strip(F.regexp_extract(F.coalesce(text, F.lit("")), "(?imU)" + pattern, 1))
        found.append(F.regexp_replace(name, "(?iU)" + COMPANY_TEXT_SUFFIX, ""))
    usable = F.filter(F.array(*found), lambda n: (F.length(n) >= 2) & ~F.lower(n).isin(NOT_A_COMPANY))
    return clean_company(F.get(usable, F.lit(0)))


def guessed_company(stem: Column) -> Column:
    """Company guessed from the file name alone."""
    low = F.regexp_replace(F.lower(stem), r"[-_]?q[0-9][-_]?[0-9]{4}", "")
    low = F.regexp_replace(low, r"[-_][0-9]{4}", "")
    words = strip(F.regexp_replace(low, r"[-_]", " "))
    return F.when(words != "", F.initcap(words)).otherwise("Okänt")


def report_file_name(company: Column, year: Column, quarter: Column, lang: Column) -> Column:
    return F.concat(
        file_slug(company), F.lit("-"), year.cast("string"), F.lit("-q"), quarter.cast("string"), F.lit("-"), lang,
        F.lit(".pdf"),
    )


def is_canonical_file(name: Column) -> Column:
    return name.rlike("(?U)" + CANONICAL_FILE_PATTERN)


SPREADSHEET_LIMIT = 31


def sheet_name(title: Column, limit: int | None = None) -> Column:
    """Title as a sheet name: forbidden characters out, single blanks; ``limit`` cuts it as spreadsheets do."""
    clean = strip(F.regexp_replace(F.regexp_replace(title, r"[/\\*?:\[\]]", " "), r"(?U)\s+", " "))
    return F.when(F.coalesce(title, F.lit("")) == "", "Sheet").otherwise(clean if limit is None else F.substring(clean, 1, limit))
