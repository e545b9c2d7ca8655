"""Databook queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.naming import SPREADSHEET_LIMIT
from reportloom.operators import databook, export
from reportloom.plans.catalog import double, query
from reportloom.plans.views import Views

# Rows of a statement stand in another order in every period: numbers times a step, modulo a prime.
_STATEMENT_ROWS = """
  SELECT company_id, flag_no AS statement, (year - 1995) * 4 + quarter - 1 AS period_no,
         brand_no * (1 + ((year - 1995) * 4 + quarter - 1) % 5) % 29 AS row_no, p_brand AS name, lower(p_brand) AS row_key,
         'Q' || quarter || ' ' || year AS period, CAST(value AS DOUBLE) AS value
  FROM {brand_values}"""
_ORDER = """
  WITH RECURSIVE r AS (
    SELECT *, lag(row_key) OVER (PARTITION BY company_id, statement, period_no ORDER BY row_no) AS prev FROM (%s)),
  f AS (SELECT *, CASE WHEN period_no > 0 THEN prev END AS anchor FROM (
          SELECT *, row_number() OVER (PARTITION BY company_id, statement, row_key ORDER BY period_no, row_no) AS rn FROM r)
        WHERE rn = 1),
  t AS (
    SELECT company_id, statement, row_key, name, [CAST(period_no * 1000 + row_no AS BIGINT)] AS path FROM f WHERE anchor IS NULL
    UNION ALL
    SELECT f.company_id, f.statement, f.row_key, f.name,
           list_append(t.path, CAST(-(f.period_no * 1000 + f.row_no) AS BIGINT))
    FROM f JOIN t ON t.company_id = f.company_id AND t.statement = f.statement AND t.row_key = f.anchor)
  SELECT company_id, statement, row_key, name AS label,
         row_number() OVER (PARTITION BY company_id, statement ORDER BY path) AS position FROM t"""
_ORDERED = _ORDER % _STATEMENT_ROWS


def _statement_rows(v: Views) -> DataFrame:
    number = (F.col("year") - 1995) * 4 + F.col("quarter") - 1
    return v["brand_values"].select(
        "company_id", F.col("flag_no").alias("statement"), number.alias("period_no"),
        (F.col("brand_no") * (1 + number % 5) % 29).alias("row_no"), F.col("p_brand").alias("name"),
        F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string")).alias("period"),
        "value", F.lit("data").alias("row_type"),
    )


@query(f"SELECT * FROM ({_ORDERED})")
def statement_order(v: Views) -> DataFrame:
    return databook.statement_order(_statement_rows(v))


@query(f"""
SELECT o.company_id, o.statement, o.row_key, o.label, o.position, r.period, r.value
FROM ({_ORDERED}) o JOIN ({_STATEMENT_ROWS}) r
  ON r.company_id = o.company_id AND r.statement = o.statement AND r.row_key = o.row_key""")
def period_matrix(v: Views) -> DataFrame:
    rows = _statement_rows(v)
    return databook.period_matrix(rows, databook.statement_order(rows)).select(
        "company_id", "statement", "row_key", "label", "position", "period", double("value")
    )


_PERIODS = [f"Q{quarter} {year}" for year in range(1995, 2002) for quarter in range(1, 5)]
_PERIOD_COLUMNS = ", ".join(f"max(value) FILTER (WHERE period = '{p}') AS \"{p}\"" for p in _PERIODS)


@query(f"SELECT company_id, statement, row_key, {_PERIOD_COLUMNS} FROM ({_STATEMENT_ROWS}) GROUP BY company_id, statement, row_key")
def wide_matrix(v: Views) -> DataFrame:
    rows = _statement_rows(v)
    order = rows.groupBy("company_id", "statement", F.lower("name").alias("row_key")).agg(
        F.min("name").alias("label"), F.min("row_no").alias("position")
    )
    wide = databook.wide_matrix(databook.period_matrix(rows, order), _PERIODS)
    return wide.select("company_id", "statement", "row_key", *[double(f"`{p}`").alias(p) for p in _PERIODS])


_DUMPED = """
SELECT table_id AS id, CASE WHEN table_type = 'quarterly' THEN 'cash_flow' ELSE coalesce(table_type, 'other') END AS sheet_type,
       title || CASE WHEN page_number IS NULL THEN '' ELSE ' (s. ' || page_number || ')' END AS table_title,
       CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_order) - 1 AS INT) AS row_no, label, row_type,
       'Q' || quarter || ' ' || year AS header, v1 AS value, n_values
FROM {table_cells}"""
_DUMP_COLUMNS = ["id", "sheet_type", "table_title", "row_no", "label", "row_type", "header", "value"]


def _dumped(v: Views) -> DataFrame:
    number = (F.col("year") - 1995) * 4 + F.col("quarter") - 1
    return v["report_tables"].withColumn("period_no", number).withColumn("period", F.get("columns", F.lit(1)))


# A row of three values has one beyond the headers.
@query(f"""
SELECT * EXCLUDE (n_values) FROM ({_DUMPED})
UNION ALL
SELECT * EXCLUDE (n_values) REPLACE (NULL AS header, 'n' AS value) FROM ({_DUMPED}) WHERE n_values = 3""")
def table_dump(v: Views) -> DataFrame:
    return databook.table_dump(_dumped(v)).select(*_DUMP_COLUMNS)


@query(f"SELECT * EXCLUDE (n_values) FROM ({_DUMPED})")
def clipped_table_dump(v: Views) -> DataFrame:
    """The six sheet types, values up to the width of the headers."""
    return databook.table_dump(_dumped(v), known_types_only=True, clip=True).select(*_DUMP_COLUMNS)


def _bulleted() -> Column:
    """Contents of sections, some with bullet lines derived from the id."""
    number = F.col("id")
    bullets = F.concat(*[
        x for k, m in ((1, 2), (2, 3), (3, 5), (4, 7))
        for x in (F.lit(f"\n• punkt {k} "), (number % m).cast("string"))
    ])
    return F.when(number % 3 == 0, F.concat("content", bullets)).otherwise(F.col("content"))


def _company_sections(v: Views) -> DataFrame:
    """Sections of each company in order."""
    return v["sections"].select(
        "company_id", F.col("id").alias("section_no"), "title", F.col("page_number").alias("page"), _bulleted().alias("content")
    )


# The same sections, numbered within their group, and the greedy choice as a recursion over them.
_NUMBERED = """
  SELECT company_id, id AS section_no, title, page_number AS page,
         content || CASE WHEN id % 3 = 0 THEN chr(10) || '• punkt 1 ' || id % 2 || chr(10) || '• punkt 2 ' || id % 3 || chr(10)
                         || '• punkt 3 ' || id % 5 || chr(10) || '• punkt 4 ' || id % 7 ELSE '' END AS content
  FROM {sections}"""
_LINES = "list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
_DESCRIPTION = f"""
  SELECT company_id, section_no, title, page, row_number() OVER (PARTITION BY company_id ORDER BY section_no) AS rn,
         list_distinct(list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^[•*–-] ')),
                                                  lambda x: trim(lower(substring(x, 3, 50)))), lambda x: x <> '')) AS b,
         coalesce(replace(lower(substring(list_filter(ls, lambda x: length(x) > 50 AND regexp_matches(x, '[.•]'))[1], 1, 100)),
                          ' ', ''), '') AS s
  FROM (SELECT *, {_LINES} AS ls FROM (%s)) WHERE title <> ''"""


_FIRST_WINS = f"""
SELECT company_id, section_no, title, page FROM (
  WITH RECURSIVE d AS (SELECT *, {{{{'b': b, 's': s}}}} AS c FROM ({_DESCRIPTION})),
  g AS (
    SELECT company_id, rn, section_no, title, page, TRUE AS kept, [title] AS titles, [c] AS contents FROM d WHERE rn = 1
    UNION ALL
    SELECT company_id, rn, section_no, title, page, ok, CASE WHEN ok THEN list_append(titles, title) ELSE titles END,
           CASE WHEN ok THEN list_append(contents, c) ELSE contents END
    FROM (SELECT d.*, g.titles, g.contents, NOT list_contains(g.titles, d.title) AND len(list_filter(g.contents, lambda x:
                   (len(x.b) > 0 AND len(d.b) > 0 AND len(list_intersect(x.b, d.b)) >= least(3, len(x.b), len(d.b)))
                   OR (x.s <> '' AND x.s = d.s))) = 0 AS ok
          FROM g JOIN d ON d.company_id = g.company_id AND d.rn = g.rn + 1))
  SELECT * FROM g) WHERE kept""".replace("{{", "{").replace("}}", "}")


@query(_FIRST_WINS % _NUMBERED)
def unique_sections(v: Views) -> DataFrame:
    """Greedy choice over sections in order."""
    return databook.unique_sections(_company_sections(v)).select("company_id", "section_no", "title", "page")


_BY_TITLE = """
SELECT company_id, title, section_no FROM (
  WITH RECURSIVE d AS (
    SELECT company_id, title, section_no, replace(lower(substring(content, 1, 200)), ' ', '') AS a,
           row_number() OVER (PARTITION BY company_id, title ORDER BY section_no) AS rn FROM (%s)),
  g AS (
    SELECT company_id, title, section_no, rn, TRUE AS kept, [a] AS leads FROM d WHERE rn = 1
    UNION ALL
    SELECT company_id, title, section_no, rn, ok, CASE WHEN ok THEN list_append(leads, a) ELSE leads END
    FROM (SELECT d.*, g.leads, len(list_filter(g.leads, lambda x: x <> '' AND d.a <> '' AND
                   len(list_filter(string_split(d.a, ''), lambda c: contains(x, c))) > 0.8 * greatest(length(d.a), length(x)))) = 0 AS ok
          FROM g JOIN d ON d.company_id = g.company_id AND d.title = g.title AND d.rn = g.rn + 1))
  SELECT * FROM g) WHERE kept"""


@query(_BY_TITLE % _NUMBERED)
def unique_by_title(v: Views) -> DataFrame:
    """Greedy choice within a title."""
    return databook.unique_by_title(_company_sections(v))


@query("""
SELECT company_id, period_id AS id, 'Orders ' || year AS title,
       'Q' || quarter || ' ' || year || CASE WHEN quarter <> 3 THEN ' | antal' ELSE '' END
         || CASE WHEN quarter % 2 = 0 THEN ' | Uppskattade värden' ELSE ' | Exakta värden' END AS caption,
       CAST(row_number() OVER (PARTITION BY period_id ORDER BY month) - 1 AS INT) AS point_no, CAST(month AS VARCHAR) AS label,
       CAST(value AS DOUBLE) AS value
FROM {chart_points}""")
def chart_rows(v: Views) -> DataFrame:
    label = F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"))
    return databook.chart_rows(v["charts"].withColumn("period", label)).select(
        "company_id", "id", "title", "caption", "point_no", "label", double("value")
    )


@query("""
SELECT company_id, flag_no * 1000 + brand_no AS number, arg_min(p_brand || ' ' || (year * 10 + quarter), year * 10 + quarter) AS title,
       CAST(arg_max(value, year * 10 + quarter) AS DOUBLE) AS body, max(year * 10 + quarter) AS period_no
FROM {brand_values} GROUP BY company_id, flag_no * 1000 + brand_no""")
def latest_notes(v: Views) -> DataFrame:
    number = F.col("year") * 10 + F.col("quarter")
    notes = v["brand_values"].select(
        "company_id", (F.col("flag_no") * 1000 + F.col("brand_no")).alias("number"), number.alias("period_no"), F.col("value").alias("body"),
        F.concat("p_brand", F.lit(" "), number.cast("string")).alias("title"),
    )
    return databook.latest_notes(notes).withColumn("body", double("body"))


_SHEETS = """
SELECT company_id, block, CAST(spot AS BIGINT) AS spot, sheet FROM (
  SELECT DISTINCT company_id, 0 AS block, CASE k WHEN 'income_statement' THEN 1 WHEN 'balance_sheet' THEN 2 WHEN 'cash_flow' THEN 3
           WHEN 'kpi' THEN 4 ELSE 6 END AS spot,
         CASE k WHEN 'income_statement' THEN 'Resultaträkning' WHEN 'balance_sheet' THEN 'Balansräkning'
           WHEN 'cash_flow' THEN 'Kassaflöde' WHEN 'kpi' THEN 'Nyckeltal' ELSE 'Övrigt' END AS sheet
  FROM (SELECT company_id, CASE WHEN table_type = 'quarterly' THEN 'cash_flow' ELSE coalesce(table_type, 'other') END AS k FROM {tables}
        WHERE company_id <> 11)
  UNION ALL SELECT DISTINCT company_id, 0, 0, '═ SIFFROR & GRAFER ═' FROM {tables} WHERE company_id <> 11
  UNION ALL SELECT DISTINCT company_id, 0, 100, 'Grafer' FROM {tables} WHERE company_id <> 11
  UNION ALL SELECT DISTINCT company_id, 1, -1, '═ TEXT ═' FROM {sections} WHERE company_id <> 11
  UNION ALL SELECT 11, 0, 0, '═ SIFFROR ═'
  UNION ALL SELECT DISTINCT 11, 0, CASE statement_type WHEN 'resultatrakning' THEN 1 WHEN 'balansrakning' THEN 2 ELSE 3 END,
         CASE statement_type WHEN 'resultatrakning' THEN 'Resultaträkning' WHEN 'balansrakning' THEN 'Balansräkning'
              ELSE 'Kassaflöde' END FROM {financial_data} WHERE company_id = 11
  UNION ALL SELECT company_id, 1, page, sheet FROM (
    SELECT company_id, page, sheet, row_number() OVER (PARTITION BY company_id, sheet ORDER BY page, id) AS rn FROM (
      SELECT company_id, page_number AS page, id, %s AS sheet FROM {sections} WHERE company_id <> 11)) WHERE rn = 1)"""
_LONG_NAME = "'Del ' || id % 7 || ' av rapporten, avsnitt nummer ' || id % 11"


def _sheets(v: Views, name_limit: int | None = None) -> DataFrame:
    """Sheets of all databooks; company 11 has only legacy statements."""
    tables = v["report_tables"].filter("company_id <> 11")
    texts = v["sections"].select(
        "company_id", F.col("id").alias("section_no"), F.col("page_number").alias("page"),
        F.concat(F.lit("Del: "), (F.col("id") % 7).cast("string"), F.lit("/av rapporten,  avsnitt nummer "),
                 (F.col("id") % 11).cast("string")).alias("title"),
    )
    plan = databook.sheet_plan(v["periods"], tables, v["financial_data"], v["charts"], texts, name_limit)
    return plan.select("company_id", "block", "spot", "sheet")


@query(_SHEETS % _LONG_NAME)
def sheet_plan(v: Views) -> DataFrame:
    return _sheets(v)


@query(_SHEETS % f"substring({_LONG_NAME}, 1, 31)")
def short_sheet_plan(v: Views) -> DataFrame:
    """With names as short as a spreadsheet wants them."""
    return _sheets(v, SPREADSHEET_LIMIT)


_PLACED = """
  SELECT id AS period_id, company_id, 'Q' || quarter || ' ' || year AS period,
         row_number() OVER (PARTITION BY company_id ORDER BY year, quarter) - 1 AS period_no FROM {periods} %s"""
_SPOTS = (
    "CASE sheet_type WHEN 'income_statement' THEN 1 WHEN 'balance_sheet' THEN 2 WHEN 'cash_flow' THEN 3 WHEN 'kpi' THEN 4 ELSE 6 END"
)
_CELL_COLUMNS = [
    "company_id", "block", "spot", "period_no", "part_id", "row_no", "cell_no", "sheet", "period", "part", "label", "header", "number", "text"
]


def export_sql(labels: list[str] | None = None) -> str:
    """All cells of an export; companies other than 11 have report tables."""
    names = ", ".join(f"'{x}'" for x in labels or [])
    placed = _PLACED % (f"WHERE 'Q' || quarter || ' ' || year IN ({names})" if labels else "")
    texts = f"""
      SELECT p.company_id, p.period_no * 4294967296 + s.id AS section_no, s.title, s.page_number AS page, p.period, p.period_no, s.id,
             s.content || CASE WHEN s.id % 3 = 0 THEN chr(10) || '• punkt 1 ' || s.id % 2 || chr(10) || '• punkt 2 ' || s.id % 3 || chr(10)
                       || '• punkt 3 ' || s.id % 5 || chr(10) || '• punkt 4 ' || s.id % 7 ELSE '' END AS content
      FROM {{sections}} s JOIN ({placed}) p ON s.period_id = p.period_id
      WHERE p.company_id <> 11"""
    statements = f"""
      SELECT f.company_id, CASE statement_type WHEN 'resultatrakning' THEN 1 WHEN 'balansrakning' THEN 2 ELSE 3 END AS statement,
             p.period_no, f.row_order AS row_no, f.row_name AS name, lower(f.row_name) AS row_key, p.period, f.value
      FROM {{financial_data}} f JOIN ({placed}) p ON f.period_id = p.period_id WHERE f.company_id = 11"""
    return f"""
SELECT * REPLACE (CAST(spot AS BIGINT) AS spot, CAST(cell_no AS INT) AS cell_no) FROM (WITH texts AS ({texts}), kept AS ({_FIRST_WINS % "SELECT * FROM texts"}),
named AS (
  SELECT company_id, section_no, title, coalesce(page, 999) AS page,
         trim(regexp_replace(regexp_replace(title, '[/\\\\*?:\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')) AS sheet FROM kept),
sheets AS (
  SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY company_id, sheet ORDER BY page, section_no) = 1),
by_title AS ({_BY_TITLE % "SELECT t.* FROM texts t JOIN sheets s ON s.company_id = t.company_id AND s.title = t.title"}),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY company_id, section_no ORDER BY n) AS seq FROM (
    SELECT t.company_id, t.section_no, t.title, t.page, t.period, t.period_no, t.id, s.sheet, s.page AS spot,
           generate_subscripts(string_split(t.content, chr(10)), 1) - 1 AS n, unnest(string_split(t.content, chr(10))) AS line
    FROM texts t JOIN by_title b ON b.company_id = t.company_id AND b.section_no = t.section_no
      JOIN sheets s ON s.company_id = t.company_id AND s.title = t.title))
SELECT company_id, 1 AS block, spot, period_no, CAST(id AS VARCHAR) AS part_id, n AS row_no, 0 AS cell_no, sheet, period,
       title || CASE WHEN page <> 0 THEN ' (s. ' || page || ')' ELSE '' END AS part, NULL AS label, NULL AS header, NULL AS number,
       regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text
FROM lines WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''
UNION ALL
SELECT DISTINCT company_id, 1, -1, NULL, NULL, NULL, NULL, '═ TEXT ═', NULL, NULL, NULL, NULL, NULL, '═ TEXT ═' FROM kept
  WHERE company_id IN (SELECT company_id FROM {{tables}} JOIN ({placed}) USING (period_id, company_id))
UNION ALL
SELECT company_id, 0, {_SPOTS}, period_no, CAST(id AS VARCHAR), row_no, cell_no,
       CASE {_SPOTS} WHEN 1 THEN 'Resultaträkning' WHEN 2 THEN 'Balansräkning' WHEN 3 THEN 'Kassaflöde' WHEN 4 THEN 'Nyckeltal' ELSE 'Övrigt' END,
       period, table_title, label, header, NULL, value
FROM (SELECT d.*, 0 AS cell_no FROM ({_DUMPED}) d UNION ALL
      SELECT * EXCLUDE (n_values) REPLACE (NULL AS header, 'n' AS value), n_values, 1 FROM ({_DUMPED}) WHERE n_values = 3) c
  JOIN (SELECT id AS table_id, period_id FROM {{tables}}) t ON t.table_id = c.id JOIN ({placed}) p ON p.period_id = t.period_id
WHERE p.company_id <> 11
UNION ALL
SELECT DISTINCT company_id, 0, 0, NULL, NULL, NULL, NULL, '═ SIFFROR & GRAFER ═', NULL, NULL, NULL, NULL, NULL, '═ SIFFROR & GRAFER ═'
  FROM {{tables}} JOIN ({placed}) USING (period_id, company_id) WHERE company_id <> 11
UNION ALL
SELECT company_id, 0, 100, period_no, CAST(period_id AS VARCHAR), row_number() OVER (PARTITION BY period_id ORDER BY month) - 1, 0, 'Grafer',
       period, 'Orders ' || year, CAST(month AS VARCHAR), period || CASE WHEN quarter <> 3 THEN ' | antal' ELSE '' END
         || CASE WHEN quarter % 2 = 0 THEN ' | Uppskattade värden' ELSE ' | Exakta värden' END, CAST(value AS DOUBLE), NULL
FROM {{chart_points}} JOIN ({placed}) USING (period_id, company_id)
WHERE company_id IN (SELECT company_id FROM {{tables}} JOIN ({placed}) USING (period_id, company_id) WHERE company_id <> 11)
UNION ALL
SELECT o.company_id, 0, o.statement, 0, NULL, o.position, r.period_no,
       CASE o.statement WHEN 1 THEN 'Resultaträkning' WHEN 2 THEN 'Balansräkning' ELSE 'Kassaflöde' END, r.period, NULL, o.label, r.period,
       CAST(r.value AS DOUBLE), NULL
FROM ({_ORDER % statements}) o JOIN ({statements}) r
  ON r.company_id = o.company_id AND r.statement = o.statement AND r.row_key = o.row_key
UNION ALL
SELECT DISTINCT 11, 0, 0, NULL, NULL, NULL, NULL, '═ SIFFROR ═', NULL, NULL, NULL, NULL, NULL, '═ SIFFROR ═' FROM ({statements})
  WHERE statement < 3)"""


def export_reports(v: Views) -> export.Reports:
    """Sections stand in their period by their id; company 11 has only legacy statements."""
    sections = v["sections"].withColumns({"content": _bulleted(), "position": F.col("id")})
    return export.Reports(
        v["periods"], v["financial_data"], v["report_tables"].filter("company_id <> 11"), v["charts"], sections
    )


def _export(v: Views, labels: list[str] | None = None) -> DataFrame:
    cells = export.databook_cells(export_reports(v), labels)
    return cells.select(*[double("number") if c == "number" else F.col(c) for c in _CELL_COLUMNS])


@query(export_sql())
def export_cells(v: Views) -> DataFrame:
    """Databooks of all companies over all periods."""
    return _export(v)


@query(export_sql(["Q2 1996", "Q3 1996", "Q1 1998"]))
def export_some_periods(v: Views) -> DataFrame:
    return _export(v, ["Q2 1996", "Q3 1996", "Q1 1998"])
