"""Look-up queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.operators import lookup
from reportloom.plans.catalog import double, joined, query
from reportloom.plans.views import Views

# Text of the cells of a flat table row, as ``joined`` shows them.
CELLS = "concat(coalesce(v0, '~'), '|', coalesce(v1, '~'), CASE WHEN n_values = 3 THEN '|n' ELSE '' END)"


@query("""
SELECT c.id, c.name, c.slug, count(p.id) AS period_count
FROM {companies} c LEFT JOIN {periods} p ON p.company_id = c.id GROUP BY c.id, c.name, c.slug""")
def companies_with_counts(v: Views) -> DataFrame:
    return lookup.companies_with_counts(v["companies"], v["periods"])


@query("""
SELECT term, id, name, slug FROM (
  SELECT t.term, c.id, c.name, c.slug,
         row_number() OVER (PARTITION BY t.term ORDER BY CASE WHEN c.slug = t.term THEN 0 ELSE 1 END, c.name, c.id) AS rn
  FROM {companies} c JOIN (VALUES ('nation-3'), ('ation_1'), ('EAST'), ('nowhere'), ('%2')) t(term)
    ON c.slug = t.term OR c.name ILIKE '%' || t.term || '%') WHERE rn = 1""")
def resolve_companies(v: Views) -> DataFrame:
    return lookup.resolve_companies(v["companies"], ["nation-3", "ation_1", "EAST", "nowhere", "%2"])


@query("""
SELECT c.name AS company, 'Q' || p.quarter || ' ' || p.year AS period, p.year, p.quarter, p.valuta, p.language
FROM {periods} p JOIN {companies} c ON c.id = p.company_id WHERE c.slug = 'nation-3'""")
def company_periods(v: Views) -> DataFrame:
    company = lookup.company_by_slug(v["companies"], "nation-3")
    return lookup.company_periods(v["periods"], company).select(
        "company", "period", "year", "quarter", "valuta", "language"
    )


@query("""
SELECT p.id, p.company_id, 'Q' || p.quarter || ' ' || p.year AS period, p.quarter, p.year,
       (SELECT count(*) FROM {tables} t WHERE t.period_id = p.id) AS tables,
       (SELECT count(*) FROM {sections} s WHERE s.period_id = p.id) AS sections,
       1 AS charts, p.id % 7 <> 0 AS has_meta
FROM {periods} p""")
def periods_with_counts(v: Views) -> DataFrame:
    out = lookup.periods_with_counts(v["meta_periods"], v["report_tables"], v["sections"], v["charts"])
    return out.withColumn("charts", F.col("charts").cast("int"))


@query("""
SELECT id, company_id, year, quarter, pdf_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC, quarter DESC) AS rn FROM {periods}) WHERE rn = 1""")
def latest_periods(v: Views) -> DataFrame:
    return lookup.latest_periods(v["periods"]).select("id", "company_id", "year", "quarter", "pdf_hash")


def _incoming(v: Views) -> DataFrame:
    """Files as they come in: every fourth has new content."""
    changed = F.when(F.col("id") % 4 == 0, F.concat("pdf_hash", F.lit("x"))).otherwise(F.col("pdf_hash"))
    return v["periods"].select("company_id", "quarter", "year", changed.alias("pdf_hash"), "source_file")


@query("SELECT company_id, quarter, year, pdf_hash, source_file FROM {periods} WHERE id % 4 <> 0")
def already_stored(v: Views) -> DataFrame:
    return lookup.already_stored(_incoming(v), v["periods"])


@query("SELECT company_id, quarter, year, pdf_hash || 'x' AS pdf_hash, source_file FROM {periods} WHERE id % 4 = 0")
def not_yet_stored(v: Views) -> DataFrame:
    return lookup.not_yet_stored(_incoming(v), v["periods"])


@query("SELECT id, company_id, year, quarter FROM {periods} WHERE company_id = 3 AND quarter = 2 AND year = 1997")
def period_row(v: Views) -> DataFrame:
    return lookup.period_row(v["periods"], 3, 2, 1997).select("id", "company_id", "year", "quarter")


_STATEMENTS = f"""
SELECT t.period_id, 'table' AS source, coalesce(t.table_type, 'other') AS table_type, t.title, t.page_number,
       t.label, t.label_en, t.row_type, {CELLS} AS cells, t.row_order AS sort_no
FROM {{table_cells}} t WHERE %s
UNION ALL
SELECT f.period_id, 'legacy', f.statement_type, NULL, NULL, f.row_name, NULL, f.row_type, CAST(f.value AS VARCHAR), f.row_order
FROM {{financial_data}} f WHERE %s"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("period_id", "source", "table_type", "title", "page_number", "label", "label_en", "row_type",
                       joined("values").alias("cells"))


_NO_SORT = "SELECT period_id, source, table_type, title, page_number, label, label_en, row_type, cells FROM (%s)"


@query(_NO_SORT % (_STATEMENTS % (
    "t.table_type = 'income_statement'",
    "f.statement_type = 'resultatrakning' AND f.period_id NOT IN "
    "(SELECT period_id FROM {table_cells} WHERE table_type = 'income_statement')",
)))
def income_statements(v: Views) -> DataFrame:
    """Income statements of all periods, with the legacy fall-back."""
    return _shown(lookup.statements(v["periods"], v["report_tables"], v["financial_data"], "income_statement"))


@query(_NO_SORT % (_STATEMENTS % ("t.year = 1998 AND t.quarter = 3", "FALSE")))
def statements_of_period(v: Views) -> DataFrame:
    """All statements of one labelled period of every company."""
    picked = lookup.pick_periods(v["periods"], "Q3 1998")
    return _shown(lookup.statements(picked, v["report_tables"], v["financial_data"]))


@query("SELECT id, period_id, title, page_number, n_rows FROM {tables} WHERE table_type = 'kpi'")
def kpi_tables(v: Views) -> DataFrame:
    return lookup.kpi_tables(v["periods"], v["report_tables"]).select(
        "id", "period_id", "title", "page_number", F.size("rows").alias("n_rows")
    )


@query("""
SELECT s.id, s.period_id, 'Q' || p.quarter || ' ' || p.year AS period, s.title, s.section_type, s.page_number,
       md5(CASE WHEN length(s.content) > 2000 THEN substring(s.content, 1, 2000) || '...' ELSE s.content END) AS content
FROM {sections} s JOIN {periods} p ON p.id = s.period_id""")
def text_sections(v: Views) -> DataFrame:
    return lookup.text_sections(v["periods"], v["sections"]).withColumn("content", F.md5("content"))


@query("""
SELECT period_id, CAST(month AS VARCHAR) AS label, CAST(value AS DOUBLE) AS value,
       CAST(row_number() OVER (PARTITION BY period_id ORDER BY month) - 1 AS INT) AS point_no,
       CASE WHEN quarter <> 3 THEN 'antal' END AS y_axis, quarter % 2 = 0 AS estimated
FROM {chart_points}""")
def chart_points(v: Views) -> DataFrame:
    return lookup.chart_points(v["periods"], v["charts"]).select(
        "period_id", "label", double("value"), "point_no", "y_axis", "estimated"
    )


@query("""
SELECT p.id AS period_id, c.name AS bolag, 'Q' || p.quarter || ' ' || p.year AS period, x.component, x.page, x.item_id, x.title
FROM {periods} p JOIN {companies} c ON c.id = p.company_id LEFT JOIN (
  SELECT period_id, 'table' AS component, page_number AS page, CAST(id AS VARCHAR) AS item_id, title FROM {tables}
  UNION ALL SELECT period_id, 'section', page_number, CAST(id AS VARCHAR), title FROM {sections}
  UNION ALL SELECT period_id, 'chart', quarter, CAST(period_id AS VARCHAR), 'Orders ' || year FROM {periods_with_children}
  UNION ALL SELECT period_id, statement_type, row_order, CAST(id AS VARCHAR), row_name FROM {financial_data}
    WHERE period_id NOT IN (SELECT period_id FROM {tables} UNION SELECT period_id FROM {sections})) x ON x.period_id = p.id
""".replace("{periods_with_children}", """(SELECT id AS period_id, year, quarter FROM {periods} WHERE id IN
  (SELECT period_id FROM {tables} UNION SELECT period_id FROM {sections}))"""))
def period_components(v: Views) -> DataFrame:
    return lookup.period_components(
        v["companies"], v["periods"], v["report_tables"], v["sections"], v["charts"], v["financial_data"]
    ).select("period_id", "bolag", "period", "component", "page", "item_id", "title")


@query("SELECT id, year, quarter FROM {periods} WHERE (year = 1996 AND quarter = 1) OR (year = 1997 AND quarter = 2)")
def filter_periods(v: Views) -> DataFrame:
    return lookup.filter_periods(v["periods"], ["q1 1996", "Q21997"], loose=True).select("id", "year", "quarter")


@query("""
SELECT company_id, 'Q' || min(year * 10 + quarter) % 10 || ' ' || min(year * 10 + quarter) // 10 AS first_period,
       'Q' || max(year * 10 + quarter) % 10 || ' ' || max(year * 10 + quarter) // 10 AS last_period,
       name || ' Q' || min(year * 10 + quarter) % 10 || ' ' || substring(CAST(min(year) AS VARCHAR), 3)
            || ' - Q' || max(year * 10 + quarter) % 10 || ' ' || substring(CAST(max(year) AS VARCHAR), 3) AS export_name
FROM {periods} p JOIN {companies} c ON c.id = p.company_id GROUP BY company_id, name""")
def period_span(v: Views) -> DataFrame:
    return lookup.period_span(v["periods"], v["companies"])
