"""Period expressions: labels, file names, headers, years."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reportloom.functions.text import let, strip
from reportloom.vocabulary import MONTH_RANGES, PERIOD_HEADER_PATTERNS

_LABEL = r"Q([0-9])(?U:\s*)([0-9]{4})"


def _part(text: Column, pattern: str, group: int) -> Column:
    """Matched group as an integer; null when there is no match."""
    return F.regexp_extract(text, pattern, group).try_cast("int")


def label_quarter(text: Column) -> Column:
    return _part(text, _LABEL, 1)


def label_year(text: Column) -> Column:
    return _part(text, _LABEL, 2)


def period_label(quarter: Column, year: Column) -> Column:
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string"))


def _quarter_year(quarter: Column, year: Column, valid: Column) -> Column:
    return F.when(valid, F.struct(quarter.alias("quarter"), year.alias("year")))


def file_period(name: Column) -> Column:
    """Period in a file name, quarter before year or year before quarter."""
    q_first, y_first = r"[qQ]([0-9])[_-]?([0-9]{4})", r"([0-9]{4})[_-]?[qQ]([0-9])"
    return F.coalesce(
        _quarter_year(_part(name, q_first, 1), _part(name, q_first, 2), name.rlike(q_first)),
        _quarter_year(_part(name, y_first, 2), _part(name, y_first, 1), name.rlike(y_first)),
    )


def find_period(text: Column, name: Column) -> Column:
    """First plausible period in file name and text; the file name comes first."""
    both = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(text, F.lit("")))

    def found(quarter: Column, year: Column) -> Column:
        return F.struct(quarter.alias("quarter"), year.alias("year"))

    long_year = r"[qQ]([0-9])(?U:\s*)[-_/]?(?U:\s*)([0-9]{4})"
    short_year = r"[qQ]([0-9])(?U:\s*)[-_/]?(?U:\s*)([0-9]{2})(?![0-9])"
    year_first = r"([0-9]{4})(?U:\s*)[qQ]([0-9])"

    def attempts(text: Column) -> Column:
        tries = [
            found(_part(text, long_year, 1), _part(text, long_year, 2)),
            found(_part(text, short_year, 1), _part(text, short_year, 2) + 2000),
            found(_part(text, year_first, 2), _part(text, year_first, 1)),
        ]
        for start, end, quarter in MONTH_RANGES:
            tries.append(found(F.lit(quarter), _part(text, rf"(?iu){start}[^0-9]*{end}[^0-9]*([0-9]{{4}})", 1)))
        return F.array(*tries)

    plausible = F.filter(
        let(both, attempts), lambda p: p["quarter"].between(1, 4) & p["year"].between(2000, 2100)
    )
    return F.get(plausible, F.lit(0))


def is_period_header(value: Column) -> Column:
    pattern = "(?iU)^(?:" + "|".join(PERIOD_HEADER_PATTERNS) + ")$"
    return F.coalesce(strip(value).rlike(pattern), F.lit(False))


def header_year(value: Column) -> Column:
    """Year 2020-2039 in a header, else 0."""
    return F.coalesce(F.regexp_extract(value, r"20[2-3][0-9]", 0).try_cast("int"), F.lit(0))


def loose_label(label: Column) -> Column:
    return F.upper(F.replace(label, F.lit(" "), F.lit("")))
