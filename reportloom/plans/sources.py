"""Ingest queries: payloads, markdown, page text, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.periods import label_quarter, label_year
from reportloom.plans.catalog import joined, query
from reportloom.plans.views import Views
from reportloom.sources import pages, payloads


def _raw_payloads(v: Views) -> DataFrame:
    """Report payloads as text, one per period, most of them damaged in one of the known ways."""
    rows = F.transform("rows", lambda r: F.struct(r["label"].alias("label"), r["values"].alias("values")))
    table = F.struct(F.col("id").cast("string").alias("id"), "title", F.col("table_type").alias("type"),
                     F.col("page_number").alias("page"), "columns", rows.alias("rows"))
    # At most three tables per period.
    tables = v["report_tables"].groupBy(F.col("period_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("id", table.alias("t")))).alias("tables")
    )
    head = v["periods"].join(tables, "id", "left")
    body = F.to_json(F.struct(
        F.struct(F.concat(F.when(F.col("id") % 6 == 4, "Nation {").otherwise("Nation "), F.col("company_id").cast("string")).alias("bolag"),
                 F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string")).alias("period"),
                 "valuta").alias("metadata"),
        F.transform("tables", lambda t: t["t"]).alias("tables"),
    ))
    return head.select("id", F.lit(1).alias("seq"), "pdf_hash", _damaged(body, F.col("id") % 6).alias("raw"))


def _damaged(body: Column, form: Column) -> Column:
    fence = F.concat(F.lit("```json\n"), body, F.lit("\n```\nklart"))
    comma = F.regexp_replace(body, r"\}$", ",}")
    cut = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(', "sections": [{"title": "a", "content": "avbru'))
    tail = F.concat(body, F.lit(" och sedan } text"))
    return (
        F.when(form == 1, fence).when(form == 2, comma).when(form == 3, F.concat(cut, F.lit(" } "))).when(form == 4, tail)
        .when(form == 5, F.lit("ingen data")).otherwise(body)
    )


@query("""
SELECT p.id, CASE p.id % 6 WHEN 2 THEN 'commas' WHEN 3 THEN 'closed' WHEN 4 THEN 'balanced' WHEN 5 THEN NULL ELSE 'none' END AS repair,
       CASE WHEN p.id % 6 <> 5 THEN p.quarter END AS quarter, CASE WHEN p.id % 6 <> 5 THEN p.year END AS year,
       CASE WHEN p.id % 6 <> 5 THEN CASE WHEN p.id % 6 = 4 THEN 'Nation {' ELSE 'Nation ' END || p.company_id END AS bolag,
       CASE WHEN p.id % 6 <> 5 THEN coalesce(t.n, 0) END AS tables
FROM {periods} p LEFT JOIN (SELECT period_id, CAST(count(*) AS INT) AS n FROM {tables} GROUP BY period_id) t ON t.period_id = p.id""")
def parse_payloads(v: Views) -> DataFrame:
    parsed = payloads.parse_payloads(_raw_payloads(v))
    meta = F.col("payload.metadata")
    count = F.when(F.col("repair").isNotNull(), F.greatest(F.coalesce(F.size("payload.tables"), F.lit(0)), F.lit(0)))
    return parsed.select(
        "id", "repair", label_quarter(meta["period"]).alias("quarter"), label_year(meta["period"]).alias("year"),
        meta["bolag"].alias("bolag"), count.alias("tables"),
    )


@query("""
SELECT c.company_id, c.year, c.quarter, c.title, c.page_number, coalesce(c.table_type, '') AS table_type,
       string_agg(coalesce(label, '~'), '|' ORDER BY row_order) AS labels
FROM {table_cells} c WHERE c.period_id % 6 <> 5 GROUP BY ALL""")
def ingest_tables(v: Views) -> DataFrame:
    """Payload texts to stored table rows."""
    raw = _raw_payloads(v)
    companies = v["companies"].filter("id < 1000").select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("nation-"), F.col("id").cast("string")).alias("slug")
    )
    periods = payloads.period_rows(payloads.parse_payloads(raw), companies)
    tables = payloads.report_table_rows(periods).drop("id")
    return tables.join(periods.select(F.col("id").alias("period_id"), "company_id", "year", "quarter"), "period_id").select(
        F.col("company_id").cast("bigint").alias("company_id"), "year", "quarter", "title", "page_number",
        F.coalesce("table_type", F.lit("")).alias("table_type"), joined(F.transform("rows", lambda r: r["label"])).alias("labels"),
    )


@query("""
SELECT r_name AS name, lower(replace(r_name, ' ', '-')) AS slug FROM {region}
UNION SELECT s_name, lower(replace(s_name, '#', '')) FROM {supplier}""")
def new_companies(v: Views) -> DataFrame:
    """Names that come in more than once, some of them stored already."""
    names = v["supplier"].select(F.col("s_name").alias("name")).unionByName(
        v["nation"].select(F.col("n_name").alias("name"))
    ).unionByName(v["region"].select(F.col("r_name").alias("name")))
    stored = v["companies"].filter("id < 1000")
    return payloads.new_companies(names.unionByName(names), stored).select("name", "slug")


@query("""
SELECT table_id AS id, 'MSEK|Q' || quarter || ' ' || year AS columns, string_agg(
         CASE WHEN v1 IS NULL THEN label || ':' || CASE WHEN n_values = 3 THEN 'n' ELSE '' END
              ELSE label || ':' || v1 || CASE WHEN n_values = 3 THEN '|n' ELSE '' END END, ';' ORDER BY row_order) AS rows
FROM {table_cells} GROUP BY table_id, quarter, year""")
def parse_markdown_tables(v: Views) -> DataFrame:
    """Tables written as markdown and read back; empty cells vanish."""
    line = lambda r: F.concat(
        F.lit("| "), r["label"], F.lit(" | "), F.coalesce(r["values"][1], F.lit("")), F.lit(" | "),
        F.coalesce(F.get(r["values"], F.lit(2)), F.lit("")), F.lit(" |"),
    )
    text = F.concat(
        F.lit("| "), F.array_join("columns", " | "), F.lit(" |\n|---|---|\n\n"),
        F.array_join(F.transform("rows", line), "\n"),
    )
    parsed = pages.parse_markdown_tables(v["report_tables"].select("id", text.alias("markdown")))
    shown = F.transform("rows", lambda r: F.concat(r["label"], F.lit(":"), F.array_join(r["values"], "|")))
    return parsed.select("id", joined("columns").alias("columns"), F.array_join(shown, ";").alias("rows"))


def _pages(v: Views) -> DataFrame:
    """Web pages as report pages: five of them make one document."""
    return v["pages"].select(
        F.floor(F.col("page_id") / 5).cast("bigint").alias("doc_id"), (F.col("page_id") % 5 + 1).cast("int").alias("page_num"),
        pages.html_to_lines(F.col("html")).alias("markdown"),
    )


_MARKDOWN = """
  SELECT page_id // 5 AS doc_id, CAST(page_id % 5 + 1 AS INT) AS page_num, regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>|<!--.*?-->', '', 'g'),
        '(?i)<h1[^>]*>', chr(10) || '# ', 'g'), '(?i)<h2[^>]*>', chr(10) || '## ', 'g'), '(?i)<h3[^>]*>', chr(10) || '### ', 'g'),
      '(?i)</?(p|div|article|nav|ul|ol|li|br|table|tr|section|footer|h[1-6])\\b[^>]*>', chr(10), 'g'),
      '(?s)<[^>]*>', '', 'g') AS markdown FROM {pages}"""
_SECTIONS = f"""
  WITH l AS (SELECT doc_id, page_num, unnest(generate_series(1, len(xs))) AS n, trim(unnest(xs), ' ' || chr(9) || chr(13)) AS line
             FROM (SELECT doc_id, page_num, string_split(markdown, chr(10)) AS xs FROM ({_MARKDOWN}))),
  h AS (SELECT *, regexp_matches(line, '^#{{1,3}}\\s+.+$') AS head, NOT starts_with(line, '|') AND length(line) > 50 AS long FROM l),
  s AS (SELECT *, sum(CAST(head AS INT)) OVER w AS hs, sum(CAST(long AND NOT head AS INT)) OVER w AS ls FROM h
        WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, n)),
  k AS (SELECT doc_id, hs, page_num, n, line, head FROM s WHERE hs > 0 OR ls > 0)
  SELECT doc_id, hs AS section_no, arg_min(CASE WHEN head THEN trim(regexp_replace(line, '^#+\\s+', ''))
                                            ELSE 'Text från sida ' || page_num END, page_num * 1000000 + n) AS title,
         min(page_num) AS page,
         string_agg(line, chr(10) ORDER BY page_num, n) FILTER (WHERE NOT head AND line <> '' AND NOT starts_with(line, '|')
                    AND NOT regexp_matches(line, '^[-|:\\s]+$')) AS content
  FROM k GROUP BY doc_id, hs"""


@query(f"""
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, title, page, md5(content) AS content
FROM ({_SECTIONS}) WHERE length(content) >= 100""")
def page_sections(v: Views) -> DataFrame:
    return pages.page_sections(_pages(v)).select(
        "doc_id", "section_no", "title", "page", F.md5("content").alias("content")
    )


@query(f"SELECT doc_id, page_num, md5('--- Sida ' || page_num || ' ---' || chr(10) || markdown) AS text FROM ({_MARKDOWN})")
def page_texts(v: Views) -> DataFrame:
    return pages.page_texts(_pages(v)).withColumn("text", F.md5("text"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'Okänt' ELSE 'Bolag ' || doc_id END AS bolag,
       CASE WHEN doc_id % 4 IN (0, 1) THEN '' ELSE 'Q1 2024' END AS period, 'SEK' AS valuta, 'sv' AS sprak, antal_sidor
FROM (SELECT page_id // 5 AS doc_id, count(*) AS antal_sidor FROM {pages} GROUP BY 1)""")
def document_metadata(v: Views) -> DataFrame:
    """Documents whose first page has no annotation, a broken one, or a partial one."""
    doc, page = F.floor(F.col("page_id") / 5).cast("bigint"), (F.col("page_id") % 5 + 1).cast("int")
    good = F.to_json(F.struct(F.concat(F.lit("Bolag "), doc.cast("string")).alias("company_name"), F.lit("Q1 2024").alias("period")))
    text = F.when(page != 1, good).when(doc % 4 == 0, F.lit(None)).when(doc % 4 == 1, "{trasig").otherwise(good)
    return pages.document_metadata(v["pages"].select(doc.alias("doc_id"), page.alias("page_num"), text.alias("annotation")))


@query("""
SELECT event_id AS doc_id, 'chart_p' || user_id || '_1' AS id, CASE event_type WHEN 'click' THEN 'chart' ELSE 'diagram' END AS element_type,
       CASE WHEN event_type = 'click' THEN 'bar' ELSE 'other' END AS chart_type, 'T' || event_id AS title, '' AS description
FROM {events} WHERE event_type IN ('click', 'view')""")
def annotated_charts(v: Views) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "chart").when(F.col("event_type") == "view", "diagram").otherwise("logo")
    note = F.to_json(F.struct(
        kind.alias("element_type"), F.when(F.col("event_type") == "click", "bar").alias("chart_type"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title"),
    ))
    images = v["events"].select(
        F.col("event_id").alias("doc_id"), F.col("user_id").alias("page_num"), F.lit(1).alias("image_no"),
        F.when(F.col("event_type") == "error", "{trasig").otherwise(note).alias("annotation"),
    )
    return pages.annotated_charts(images).select("doc_id", "id", "element_type", "chart_type", "title", "description")
