"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.operators import quality
from reportloom.plans.catalog import query
from reportloom.plans.views import Views

_ROWS = """
  SELECT period_id AS report, table_id AS item_id, title, label, v0, v1, n_values, row_type, row_order,
         CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_order) - 1 AS INT) AS row_index FROM {table_cells}"""
_TABLE_FINDINGS = f"""
  SELECT report, item_id, title, 'invalid_label' AS error_type, row_index, 'error' AS severity,
         'Ogiltig label ''' || label || ''' - ska vara verklig text från PDF' AS message
  FROM ({_ROWS}) WHERE label = 'row 1'
  UNION ALL SELECT report, item_id, title, 'values_length_mismatch', row_index, 'error',
         'Rad ''' || label || ''' har 3 values men 2 columns' FROM ({_ROWS}) WHERE n_values = 3
  UNION ALL SELECT report, item_id, title, 'first_value_not_null', row_index, 'warning',
         'Rad ''' || label || ''' har forsta vardet x istallet for null' FROM ({_ROWS}) WHERE v0 = 'x'
  UNION ALL SELECT report, item_id, title, 'no_data_values', row_index, 'warning',
         'Rad ''' || label || ''' har inga numeriska varden (alla null)'
  FROM ({_ROWS}) WHERE v1 IS NULL AND n_values = 2 AND row_type <> 'header'"""
_SHARE = """
  SELECT period_id AS report, table_id AS item_id, title, sum(n_values - 1) AS cells,
         sum((CASE WHEN v1 IS NULL THEN 0 ELSE 1 END) + n_values - 2) AS filled
  FROM {table_cells} WHERE row_type <> 'header' GROUP BY period_id, table_id, title"""
_PERCENT = "CAST(CAST(round_even(filled * 100.0 / cells, 0) AS INT) AS VARCHAR) || '%'"
_COMPLETENESS = f"""
  SELECT report, item_id, title, 'data_completeness_error' AS error_type, CAST(NULL AS INT) AS row_index, 'error' AS severity,
         'Endast ' || {_PERCENT} || ' dataceller har värden (min 50% krävs)' AS message FROM ({_SHARE}) WHERE filled * 2 < cells
  UNION ALL SELECT report, item_id, title, 'data_completeness_warning', NULL, 'warning', {_PERCENT} || ' dataceller har värden'
  FROM ({_SHARE}) WHERE filled * 2 >= cells AND filled * 10 < cells * 7"""
_HEADERS = """
  SELECT report, item_id, title, CASE WHEN abs(want - 2) > 1 THEN 'column_count_mismatch' ELSE 'column_count_warning' END
           AS error_type, CAST(NULL AS INT) AS row_index, CASE WHEN abs(want - 2) > 1 THEN 'error' ELSE 'warning' END AS severity,
         CASE WHEN abs(want - 2) > 1 THEN 'Förväntade ' || want || ' kolumner men fick 2'
              ELSE 'Kolumnantal skiljer: ' || want || ' (Pass 1) vs 2 (Pass 2)' END AS message
  FROM (SELECT period_id AS report, id AS item_id, title, id % 6 AS want FROM {tables}) WHERE want > 0 AND want <> 2"""
_LOST = """
  SELECT id AS report, 'lost-' || id AS item_id, 'Okänd' AS title, 'missing_table' AS error_type, CAST(NULL AS INT) AS row_index,
         'error' AS severity, 'Tabell saknas i extraktion (identifierad på sida ' ||
         CASE WHEN quarter = 4 THEN '?' ELSE CAST(quarter AS VARCHAR) END || ')' AS message
  FROM {periods} WHERE id % 10 = 3"""
_SECTION_FINDINGS = """
  SELECT report, item_id, CASE WHEN title = '' THEN 'Section ' || position ELSE title END AS title,
         'empty_content' AS error_type, CAST(NULL AS INT) AS row_index, 'warning' AS severity,
         'Sektionen har inget innehall' AS message
  FROM {checked_sections} WHERE trim(content) = ''
  UNION ALL SELECT report, item_id, 'Section ' || position, 'missing_title', NULL, 'warning', 'Sektionen saknar titel'
  FROM {checked_sections} WHERE trim(title) = ''""".replace("{checked_sections}", """(
    SELECT period_id AS report, CASE WHEN id % 4 = 0 THEN 'section_' || id ELSE 's' || id END AS item_id, id AS position,
           CASE WHEN id % 10 = 0 THEN '' ELSE title END AS title, CASE WHEN id % 17 = 0 THEN '   ' ELSE content END AS content
    FROM {sections})""")
_TEXT_ID = "SELECT report, CAST(item_id AS VARCHAR) AS item_id, title, error_type, row_index, severity, message FROM (%s)"
_ALL = " UNION ALL ".join(f"({_TEXT_ID % x})" for x in (_TABLE_FINDINGS, _COMPLETENESS, _HEADERS, _LOST, _SECTION_FINDINGS))


def _tables(v: Views) -> DataFrame:
    return v["report_tables"].select(
        F.col("period_id").alias("report"), F.col("id").cast("string").alias("id"), "title",
        F.col("page_number").alias("page"), "columns", "rows",
    )


def _sections(v: Views) -> DataFrame:
    """Some sections lack their id, title or content."""
    return v["sections"].select(
        F.col("period_id").alias("report"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("id"),
        F.col("id").alias("position"),
        F.when(F.col("id") % 10 != 0, F.col("title")).otherwise("").alias("title"),
        F.when(F.col("id") % 17 != 0, F.col("content")).otherwise("   ").alias("content"),
    )


def _expected(v: Views) -> DataFrame:
    """Structure map: header counts of 0 to 5, and one lost table in some reports."""
    known = v["tables"].select(
        F.col("period_id").alias("report"), F.col("id").cast("string").alias("id"), "title", F.col("page_number").alias("page"),
        F.array_repeat(F.lit("h"), (F.col("id") % 6).cast("int")).alias("column_headers"),
    )
    lost = v["periods"].filter("id % 10 = 3").select(
        F.col("id").alias("report"), F.concat(F.lit("lost-"), F.col("id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("title"), F.when(F.col("quarter") != 4, F.col("quarter")).alias("page"),
        F.array(F.lit("h")).alias("column_headers"),
    )
    return known.unionByName(lost)


@query(_TEXT_ID % _TABLE_FINDINGS)
def table_findings(v: Views) -> DataFrame:
    return quality.table_findings(_tables(v))


@query(_TEXT_ID % _LOST)
def missing_table_findings(v: Views) -> DataFrame:
    return quality.missing_table_findings(_expected(v), _tables(v))


@query(_TEXT_ID % _HEADERS)
def column_count_findings(v: Views) -> DataFrame:
    return quality.column_count_findings(_expected(v), _tables(v))


@query(_TEXT_ID % _COMPLETENESS)
def completeness_findings(v: Views) -> DataFrame:
    return quality.completeness_findings(_tables(v))


@query(_SECTION_FINDINGS)
def section_findings(v: Views) -> DataFrame:
    return quality.section_findings(_sections(v))


@query(f"""
SELECT p.id AS report, count(*) FILTER (WHERE f.severity = 'error') AS errors,
       count(*) FILTER (WHERE f.severity = 'warning') AS warnings, count(*) FILTER (WHERE f.severity = 'error') = 0 AS is_valid
FROM {{periods}} p LEFT JOIN ({_ALL}) f ON f.report = p.id GROUP BY p.id""")
def verdict(v: Views) -> DataFrame:
    found = quality.all_findings(_tables(v), _sections(v), _expected(v))
    return quality.verdict(v["periods"].select(F.col("id").alias("report")), found)


@query("""
SELECT report, item_id, title, error_type, message, severity FROM (
  WITH r AS (SELECT p.id AS report, p.id % 14 AS pages, greatest(1, (p.id % 14) // 4) AS want,
                    (SELECT count(*) FROM {tables} t WHERE t.period_id = p.id) AS n,
                    (SELECT count(*) FROM {sections} s WHERE s.period_id = p.id AND length(s.content) < 50) AS short,
                    p.quarter
             FROM (SELECT id, quarter FROM {periods} UNION ALL SELECT id + 5, NULL FROM {periods}) p)
  SELECT report, NULL AS item_id, NULL AS title, 'few_tables' AS error_type, 'warning' AS severity,
         'Få tabeller extraherade: ' || n || ' (förväntade minst ' || want || ' för ' || pages || ' sidor)' AS message
  FROM r WHERE n < want
  UNION ALL SELECT report, NULL, NULL, 'short_sections', 'warning', short || ' sektion(er) har mindre än 50 tecken'
  FROM r WHERE short > 0
  UNION ALL SELECT report, NULL, NULL, 'untitled_charts', 'warning', '1 graf(er) saknar titel' FROM r WHERE quarter = 3
  UNION ALL SELECT report, NULL, NULL, 'no_tables', 'error', 'Inga tabeller extraherade från ett flersidigt dokument'
  FROM r WHERE n = 0 AND pages > 2
  UNION ALL SELECT period_id, CAST(id AS VARCHAR), title, 'thin_table', 'warning',
         'Tabell ''' || title || ''' har bara ' || n_rows || ' rad(er)' FROM {tables} WHERE n_rows < 2)""")
def report_heuristics(v: Views) -> DataFrame:
    """Every period twice: as it is, and as a report of which nothing was extracted."""
    ids = v["periods"].select("id").union(v["periods"].select(F.col("id") + 5))
    reports = ids.select(F.col("id").alias("report"), (F.col("id") % 14).alias("pages"))
    tables = v["report_tables"].withColumnRenamed("period_id", "report")
    charts = v["charts"].select(F.col("period_id").alias("report"), F.when(F.col("quarter") != 3, F.col("title")).alias("title"))
    sections = v["sections"].withColumnRenamed("period_id", "report")
    return quality.report_heuristics(reports, tables, sections, charts).drop("row_index")


@query(f"""
SELECT f.report, f.item_id, f.title, coalesce(CAST(t.page_number AS VARCHAR), '?') AS page, f.row_index, f.error_type, f.message
FROM ({_ALL}) f JOIN {{tables}} t ON t.period_id = f.report AND CAST(t.id AS VARCHAR) = f.item_id
WHERE f.error_type IN ('invalid_label', 'values_length_mismatch', 'empty_table', 'column_count_mismatch', 'no_data_values',
                       'data_completeness_error')""")
def retry_labels(v: Views) -> DataFrame:
    found = quality.all_findings(_tables(v), _sections(v), _expected(v))
    return quality.retry_labels(_tables(v), found)
