from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reportloom.functions import classify, labels, naming, numbers, periods, text

X = F.col("x")


def each(spark, expression, values):
    """Expression over many inputs in one job."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["r"] for r in rows.select("i", expression.alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "language, cells, want",
    [
        ("sv", ["35,1", "1 225", "1 225,50", "-373", "373-", "(373)", "61,1%", "1 225"],
         ["35.1", "1225", "1225.5", "-373", "-373", "-373", "61.1", "1225"]),
        ("en", ["35.1", "1,225", "1,225.50", "(373)", "1,22", "61.1%", "1,225,000"],
         ["35.1", "1225", "1225.5", "-373", "1.22", "61.1", "1225000"]),
        ("sv", ["–", "—", "-", "", "n/a", "N/A", "n.m.", "n.a.", "ej tillämplig", "abc", None], [None] * 11),
    ],
)
def test_cells(spark, language, cells, want):
    got = each(spark, numbers.parse_cell(X, F.lit(language)), cells)
    assert got == [None if w is None else Decimal(w) for w in want]


def test_reject_reason(spark):
    assert each(spark, numbers.reject_reason(X, F.lit("sv")), ["1", "-", "abc"]) == [None, "empty", "unreadable"]


def test_loose_number(spark):
    assert each(spark, numbers.loose_number(X), ["1 225,5", "1,225", "abc", None, "1d", "-3e2"]) == [
        1225.5, 1.225, None, None, None, -300.0]


def test_period_header(spark):
    yes = ["Q1 2024", "Q3 24", "1Q24", "3Q 2024", "Kv1 2024", "H1 2024", "1H 2024", "FY2024", "YTD 2024", "9M24", "LTM",
           "LTM Q3 2024", "Jan-Mar 2024", "2024", "juli-september 2024", " q1'24 ", "Helår 2024"]
    no = ["Revenues", "2019", None, "Q5 2024", ""]
    assert each(spark, periods.is_period_header(X), yes) == [True] * len(yes)
    assert each(spark, periods.is_period_header(X), no) == [False] * len(no)


def test_header_year(spark):
    values = ["Juli-september 2025", "Helår 2024", "Q3 2025", "2019", None]
    assert each(spark, periods.header_year(X), values) == [2025, 2024, 2025, 0, 0]


def test_period_label(spark):
    values = ["Q3 2024", "xQ32024", "q3 2024", "Q9 2024"]
    assert each(spark, periods.label_quarter(X), values) == [3, 3, None, 9]
    assert each(spark, periods.label_year(X), values) == [2024, 2024, None, 2024]


def test_file_period(spark):
    got = each(spark, periods.file_period(X), ["acme-q3-2024", "acme_2024_Q1", "acme"])
    assert [g and tuple(g) for g in got] == [(3, 2024), (1, 2024), None]


def test_find_period(evaluate):
    def find(text_value, name):
        got = evaluate(periods.find_period(F.col("t"), F.col("n")), t=text_value, n=name)
        return got and tuple(got)

    assert find("", "acme Q1-2024") == (1, 2024)
    assert find("rapport q3 24 x", "acme") == (3, 2024)
    assert find("2024 Q2", "acme") == (2, 2024)
    assert find("Delårsrapport Juli – September 2023", "acme") == (3, 2023)
    assert find("Q7 2024 oktober-december 2022", "acme") == (4, 2022)
    assert find("Q1 1999", "acme") is None
    assert find("Q1 2023", "acme q4 2024") == (4, 2024)


def test_labels(spark):
    bad = ["label: 1", "row 1", "rad2", " ", "", None, "Row12"]
    good = ["2025", "Nettoomsättning", "17", "row one"]
    assert each(spark, labels.is_placeholder_label(X), bad) == [True] * len(bad)
    assert each(spark, labels.is_placeholder_label(X), good) == [False] * len(good)
    assert each(spark, labels.row_key(X), ["Kundfordringar  (MSEK)", "A  B", None]) == ["kundfordringar", "a b", ""]
    assert each(spark, labels.seed_canonical(X), [" Net Revenue ", "EBIT", "Foo"]) == ["net sales", "ebit", "foo"]
    got = each(spark, labels.row_class(F.lit(None), X), ["Summa tillgångar", "Summa rörelse", "Netto", "Omsättning"])
    assert got == ["total", "subtotal", "data", "data"]


def test_slugs(spark):
    assert each(spark, naming.slug(X), ["Åhléns & Co AB", " A_b  C- "]) == ["åhléns-co-ab", "a-b-c"]
    assert each(spark, naming.ascii_slug(X), ["Åhléns & Co AB"]) == ["ahlens-co-ab"]
    titles = ["VD: ord/och  mer", "", "x" * 40]
    assert each(spark, naming.sheet_name(X), titles) == ["VD ord och mer", "Sheet", "x" * 40]
    assert each(spark, naming.sheet_name(X, naming.SPREADSHEET_LIMIT), titles) == ["VD ord och mer", "Sheet", "x" * 31]


def test_language(spark):
    texts = ["Interim report. Revenue and earnings grew", "Styrelsen och aktieägare, nettoomsättning",
             "Styret og aksjonærer, konsernet i august", "", "january may equity assets"]
    assert each(spark, naming.language(X), texts) == ["en", "sv", "no", "sv", "en"]


def test_company_and_file_name(evaluate):
    name = naming.company_name(F.col("t"), F.col("n"))
    assert evaluate(name, t="", n="ABG-Sundal-2025-Q3") == "ABG-Sundal"
    assert evaluate(name, t="", n="vitrolife_q3_2024") == "vitrolife"
    assert evaluate(name, t="Delårsrapport Acme Nord AB\nx", n="report") == "Acme Nord"
    assert evaluate(name, t="1: 2", n="12345") is None
    made = naming.report_file_name(F.col("c"), F.lit(2024), F.lit(3), F.lit("sv"))
    assert evaluate(made, c="Vitrolife") == "vitrolife-2024-q3-sv.pdf"
    assert evaluate(naming.is_canonical_file(F.col("c")), c="vitrolife-2024-q3-sv.pdf")
    assert evaluate(naming.guessed_company(F.col("c")), c="acme-nord-q3-2024") == "Acme Nord"


def test_types(evaluate):
    mapped = classify.mapped_table_type(F.col("k"), F.col("t"))
    assert evaluate(mapped, k="quarterly", t="Koncernens resultaträkningar per kvartal") == "income_statement"
    assert evaluate(mapped, k="quarterly", t="Något") == "other"
    assert evaluate(mapped, k="note", t="x") == "note"
    keyword = classify.keyword_table_type(F.col("t"), F.array(F.lit("2024"), F.lit(None)), F.array(F.lit("EBITDA"), F.lit("x")))
    assert evaluate(keyword, t="Balance sheet") == "income_statement"
    assert evaluate(keyword, t="Balance sheet, total assets") == "income_statement"
    assert evaluate(keyword, t="Balance sheet, assets, equity") == "balance_sheet"
    section = classify.keyword_section_type(F.col("t"), F.col("c"))
    assert evaluate(section, t="VD har ordet", c="risk") == "narrative"
    assert evaluate(section, t="x", c="y") == "other"
    assert evaluate(classify.severity_class(F.col("t")), t="missing_table") == "Kritiskt"
    assert evaluate(classify.severity_class(F.col("t")), t="anything") == "Medel"


def test_text(evaluate, spark):
    assert evaluate(text.cut(F.col("x"), 3), x="abcd") == "abc..."
    assert evaluate(text.excerpt(F.col("x"), F.lit("HIT")), x="a" * 150 + "hit" + "b" * 150) == \
        "..." + "a" * 100 + "hit" + "b" * 100 + "..."
    assert evaluate(text.excerpt(F.col("x"), F.lit("no")), x="abc") == "abc..."
    lines = ["• punkt", "- punkt", "1. punkt", "Kort rubrik", "En mening.", "x" * 60, "a b c d e f g"]
    assert each(spark, text.line_kind(X), lines) == ["bullet"] * 3 + ["subheader", "text", "text", "text"]
