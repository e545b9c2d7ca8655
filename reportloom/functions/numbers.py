"""Number expressions: cells written in Swedish, Norwegian or English style."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reportloom.functions.text import strip
from reportloom.vocabulary import EMPTY_CELLS

CELL_TYPE = "decimal(28,6)"


def is_empty_cell(cell: Column) -> Column:
    return F.lower(strip(F.coalesce(cell, F.lit("")))).isin(EMPTY_CELLS)


def _digits(cell: Column) -> Column:
    """The cell without sign marks, percent sign and any white space."""
    return F.regexp_replace(cell, r"(?U)[\s%()−-]", "")


def is_negative_cell(cell: Column) -> Column:
    bare = F.regexp_replace(cell, r"(?U)[\s%]", "")
    return bare.rlike(r"^\(.*\)$") | bare.rlike(r"^[-−]") | bare.rlike(r"[-−]$")


def parse_cell(cell: Column, language: Column) -> Column:
    """Cell to decimal by the language of its report; anything unreadable is null."""
    body = _digits(cell)
    nordic = F.replace(body, F.lit(","), F.lit("."))
    # A comma before exactly three digits separates thousands in English, any other is a decimal comma.
    english = F.replace(F.regexp_replace(body, r",(?=[0-9]{3}(?![0-9]))", ""), F.lit(","), F.lit("."))
    plain = F.when(language == "en", english).otherwise(nordic)
    number = F.when(plain.rlike(r"^([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), plain).try_cast(CELL_TYPE)
    signed = F.when(is_negative_cell(cell), -number).otherwise(number)
    return F.when(~is_empty_cell(cell), signed).cast(CELL_TYPE)


def reject_reason(cell: Column, language: Column) -> Column:
    """Why a cell has no number: ``empty`` by convention or ``unreadable``; null if it has one."""
    return F.when(is_empty_cell(cell), "empty").when(parse_cell(cell, language).isNull(), "unreadable")


def loose_number(text: Column) -> Column:
    """Number for comparisons: blanks out, comma as decimal point (``1,225`` is 1.225)."""
    plain = F.replace(F.replace(strip(text), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain).try_cast("double")
