"""Comparison, set-difference and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.operators import compare, lookup, status
from reportloom.plans.catalog import double, query
from reportloom.plans.views import Views

_CANONICAL = "coalesce(s.canonical, lower(trim(coalesce(t.label_en, ''))))"
_ORDER = "t.page_number ASC NULLS LAST, t.table_id, t.row_order"
_VALUE = "TRY_CAST(replace(replace(trim(coalesce(v0, v1, CASE WHEN n_values = 3 THEN 'n' END)), ' ', ''), ',', '.') AS DOUBLE)"
_LABELLED = f"""
  SELECT t.*, {_CANONICAL} AS canonical,
         row_number() OVER (PARTITION BY t.period_id, {_CANONICAL} ORDER BY {_ORDER}) AS rn,
         {_VALUE} AS value
  FROM {{table_cells}} t LEFT JOIN {{label_synonyms}} s ON s.synonym = lower(trim(coalesce(t.label_en, '')))"""
_PAIRS = """
  SELECT a.id AS pair_id, a.id AS period_1, b.id AS period_2
  FROM {periods} a JOIN {periods} b ON b.company_id = a.company_id + 1 AND b.year = a.year AND b.quarter = a.quarter"""


def _rows(v: Views) -> DataFrame:
    return compare.canonical_labels(lookup.table_rows(v["report_tables"]), v["label_synonyms"])


def _neighbours(v: Views) -> DataFrame:
    """Each company with the next one, period by period."""
    periods = v["periods"].select("id", "company_id", "year", "quarter")
    other = periods.select(F.col("id").alias("period_2"), (F.col("company_id") - 1).alias("company_id"), "year", "quarter")
    return periods.join(other, ["company_id", "year", "quarter"]).select(
        F.col("id").alias("pair_id"), F.col("id").alias("period_1"), "period_2"
    )


def _successive(v: Views) -> DataFrame:
    """Each period with the same quarter a year later."""
    periods = v["periods"].select("id", "company_id", "year", "quarter")
    later = periods.select(F.col("id").alias("period_2"), "company_id", (F.col("year") - 1).alias("year"), "quarter")
    return periods.join(later, ["company_id", "year", "quarter"]).select(
        F.col("id").alias("pair_id"), F.col("id").alias("period_1"), "period_2"
    )


@query(f"SELECT period_id, table_id, label, label_en, canonical FROM ({_LABELLED})")
def canonical_labels(v: Views) -> DataFrame:
    return _rows(v).select("period_id", "table_id", "label", "label_en", "canonical")


@query(f"""
SELECT p.pair_id, a.canonical, a.label_en, CASE WHEN a.canonical <> lower(trim(a.label_en)) THEN a.canonical END AS matched_via,
       a.label AS label_1, a.value AS value_1, b.label AS label_2, b.value AS value_2,
       round(a.value - b.value, 2) AS difference, CASE WHEN b.value <> 0 THEN round(a.value / b.value, 2) END AS ratio
FROM ({_PAIRS}) p JOIN ({_LABELLED}) a ON a.period_id = p.period_1 AND a.rn = 1 AND a.canonical <> ''
JOIN ({_LABELLED}) b ON b.period_id = p.period_2 AND b.rn = 1 AND b.canonical = a.canonical""")
def compare_companies(v: Views) -> DataFrame:
    return compare.compare_companies(_rows(v), _neighbours(v))


_UNMATCHED = f"""
  SELECT p.pair_id, t.label_en,
         CAST(row_number() OVER (PARTITION BY p.pair_id ORDER BY {_ORDER}) AS INT) AS place
  FROM ({_PAIRS}) p JOIN ({_LABELLED}) t ON t.period_id = p.period_1 AND t.canonical <> '' AND t.label_en <> ''
  WHERE t.rn > 1 OR NOT EXISTS (
    SELECT 1 FROM ({_LABELLED}) b WHERE b.period_id = p.period_2 AND b.canonical = t.canonical)"""


@query(_UNMATCHED)
def unmatched_rows(v: Views) -> DataFrame:
    return compare.unmatched_rows(_rows(v), _neighbours(v))


@query(f"SELECT * FROM ({_UNMATCHED}) WHERE place <= 10")
def first_unmatched_rows(v: Views) -> DataFrame:
    """The first ten of each pair."""
    return compare.unmatched_rows(_rows(v), _neighbours(v), limit=10)


@query("""
SELECT p.id AS pair_id, x.side, f.period_id, f.statement_type, f.row_name, CAST(f.value AS DOUBLE) AS value
FROM {periods} p JOIN {periods} q ON q.company_id = p.company_id AND q.year = p.year + 1 AND q.quarter = p.quarter
JOIN (VALUES (1), (2)) x(side) ON TRUE
JOIN {financial_data} f ON f.period_id = CASE x.side WHEN 1 THEN p.id ELSE q.id END""")
def compare_periods(v: Views) -> DataFrame:
    rows = v["financial_data"].select("period_id", "statement_type", "row_name", double("value"))
    return compare.compare_periods(rows, _successive(v)).select(
        "pair_id", "side", "period_id", "statement_type", "row_name", "value"
    )


@query("""
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.row_key, b.row_key) AS row_key, a.label AS label_1,
       a.value AS value_1, b.label AS label_2, b.value AS value_2
FROM (SELECT p.id AS pair_id, lower(x.p_brand) || ' ' || x.flag_no AS row_key, x.p_brand || ' ' || x.flag_no AS label,
             CAST(x.value AS DOUBLE) AS value
      FROM {periods} p JOIN {periods} q ON q.company_id = p.company_id AND q.year = p.year + 1 AND q.quarter = p.quarter
      JOIN {brand_values} x ON x.period_id = p.id) a
FULL JOIN (SELECT p.id AS pair_id, lower(x.p_brand) || ' ' || x.flag_no AS row_key, x.p_brand || ' ' || x.flag_no AS label,
             CAST(x.value AS DOUBLE) AS value
      FROM {periods} p JOIN {periods} q ON q.company_id = p.company_id AND q.year = p.year + 1 AND q.quarter = p.quarter
      JOIN {brand_values} x ON x.period_id = q.id) b
  ON a.pair_id = b.pair_id AND a.row_key = b.row_key""")
def align_periods(v: Views) -> DataFrame:
    rows = v["brand_values"].select(
        "period_id", (F.col("flag_no") * 1000 + F.col("brand_no")).alias("row_order"),
        F.concat("p_brand", F.lit(" "), F.col("flag_no").cast("string")).alias("label"), "value",
    )
    return compare.align_periods(rows, _successive(v)).select(
        "pair_id", "row_key", "label_1", double("value_1"), "label_2", double("value_2")
    )


@query("""
SELECT e.report, e.id, e.title, e.page FROM {expected_items} e
WHERE NOT EXISTS (SELECT 1 FROM {extracted_items} x WHERE x.report = e.report AND x.id = e.id)""")
def missing_items(v: Views) -> DataFrame:
    return compare.missing_items(v["expected_items"], v["extracted_items"], ["report", "id"]).select(
        "report", "id", "title", "page"
    )


_RETRY = """
  SELECT e.report, e.id, e.page, 'SAKNAS - extrahera från PDF' AS issue FROM {expected_items} e
  WHERE NOT EXISTS (SELECT 1 FROM {extracted_items} x WHERE x.report = e.report AND x.id = e.id)
  UNION ALL
  SELECT report, id, page, 'FEL: kort' || CASE WHEN m % 46 = 0 THEN '; tom' ELSE '' END FROM {extracted_items}
  WHERE m % 23 = 0"""


def _retry_items(v: Views) -> DataFrame:
    """Every report lacks the tables that were not extracted, and some extracted tables have one or two errors."""
    found = v["extracted_items"]

    def finding(when: str, message: str) -> DataFrame:
        return found.filter(when).select("report", F.col("id").alias("item_id"), F.lit(message).alias("message"),
                                         F.lit("error").alias("severity"))

    findings = finding("m % 23 = 0", "kort").unionByName(finding("m % 46 = 0", "tom")).unionByName(
        finding("m % 5 = 0", "bara varning").withColumn("severity", F.lit("warning"))
    )
    return compare.retry_items(v["expected_items"], found.drop("m"), findings)


def _documents(v: Views) -> DataFrame:
    return v["periods"].select(F.col("id").alias("report"), (F.col("id") % 14 + 2).alias("pages"))


@query(f"SELECT report, id, page, issue FROM ({_RETRY})")
def retry_items(v: Views) -> DataFrame:
    return _retry_items(v).select("report", "id", "page", "issue")


@query(f"""
SELECT r.report, r.pages, r.tables_to_fix, coalesce(n.needed, 0) AS needed,
       coalesce(n.needed, 0) > 0 AND coalesce(n.needed, 0) < r.pages * 0.5 AS partial
FROM (SELECT i.report, p.id % 14 + 2 AS pages, count(*) AS tables_to_fix FROM ({_RETRY}) i JOIN {{periods}} p ON p.id = i.report
      GROUP BY i.report, p.id) r
LEFT JOIN (SELECT report, count(DISTINCT near) AS needed FROM (
             SELECT i.report, i.page + d.d AS near, i.report % 14 + 2 AS pages
             FROM ({_RETRY}) i JOIN (VALUES (-1), (0), (1)) d(d) ON TRUE) WHERE near BETWEEN 1 AND pages GROUP BY report) n
  ON n.report = r.report""")
def retry_scope(v: Views) -> DataFrame:
    return compare.retry_scope(_retry_items(v), _documents(v))


@query("""
SELECT report, id, title FROM {extracted_items} WHERE m % 5 <> 0
UNION ALL SELECT report, id, title || ' fixed' FROM {extracted_items} WHERE m % 5 = 0
UNION ALL SELECT report, id || 'n', title FROM {extracted_items} WHERE m % 50 = 0""")
def apply_retry(v: Views) -> DataFrame:
    current = v["extracted_items"]
    fixed = current.filter("m % 5 = 0").withColumn("title", F.concat("title", F.lit(" fixed"))).unionByName(
        current.filter("m % 50 = 0").withColumn("id", F.concat("id", F.lit("n")))
    )
    return compare.apply_retry(current, fixed).select("report", "id", "title")


_RECONCILED = """
  SELECT source_file AS path, CASE WHEN id % 2 = 0 AND id % 7 <> 0 THEN 'moved_to_db' WHEN id % 2 = 0 THEN 'not_in_db'
                                   WHEN id % 7 <> 0 THEN 'already_correct' ELSE 'moved_to_extract' END AS action
  FROM {periods}"""


def _inventory(v: Views) -> DataFrame:
    """A file for every period in one of the two folders; every seventh has content that is not stored."""
    folder = F.when(F.col("id") % 2 == 0, "skall_extractas").otherwise("ligger_i_databasen")
    content = F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.col("pdf_hash"))
    return v["periods"].select(
        F.col("source_file").alias("path"), folder.alias("folder"), F.col("source_file").alias("name"), content.alias("md5_12")
    )


@query(_RECONCILED)
def reconcile_files(v: Views) -> DataFrame:
    return compare.reconcile_files(_inventory(v), v["periods"]).select("path", "action")


@query(f"SELECT action, count(*) AS files FROM ({_RECONCILED}) GROUP BY action")
def reconcile_counts(v: Views) -> DataFrame:
    return compare.reconcile_counts(_inventory(v), v["periods"])


@query("""
SELECT e.id, p.company_id, coalesce('Q' || p.quarter || ' ' || p.year, 'Okänd') AS period, e.error_type, e.severity, e.component
FROM {errors} e LEFT JOIN {periods} p ON p.id = e.period_id WHERE NOT e.resolved""")
def open_errors(v: Views) -> DataFrame:
    return compare.open_errors(v["errors"], v["periods"]).drop("details")


@query("""
SELECT s.id, c.name AS company, 'Q' || p.quarter || ' ' || p.year AS period, p.source_file, s.title
FROM {sections} s JOIN {periods} p ON p.id = s.period_id JOIN {companies} c ON c.id = p.company_id
WHERE s.content ILIKE '%ation%'""")
def hits_with_company(v: Views) -> DataFrame:
    hits = v["sections"].drop("company_id").filter(F.ilike(F.col("content"), F.lit("%ation%")))
    return compare.with_period_and_company(hits, v["periods"], v["companies"]).select(
        "id", "company", "period", "source_file", "title"
    )


@query("""
SELECT DISTINCT f.batch_id, f.path FROM {file_events} f
WHERE NOT EXISTS (SELECT 1 FROM {file_events} d WHERE d.batch_id = f.batch_id AND d.path = f.path AND d.outcome = 'completed')""")
def remaining_inputs(v: Views) -> DataFrame:
    inputs = v["file_events"].select("batch_id", "path").distinct()
    return compare.remaining_inputs(inputs, status.completed_files(status.fold_file_events(v["file_events"])))
