"""Queries that store rows in the shared folder, change or stream them, and read them back."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from reportloom.functions.scale import ranked
from reportloom.operators import export, knowledge, lookup, quality, stats
from reportloom.plans.catalog import double, query
from reportloom.plans.databooks import export_reports, export_sql
from reportloom.plans.normalising import FILE_PLAN, report_files
from reportloom.plans.views import Views
from reportloom.session import shared_folder
from reportloom.sources import files, store, tables
from reportloom.streaming import streams


def _folder(v: Views) -> str:
    return f"{shared_folder(v.spark)}/stored-{uuid.uuid4().hex}"


def _ended(stream: StreamingQuery) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


def _children(v: Views) -> dict[str, DataFrame]:
    """Rows of all periods; the store takes those of the periods it is given."""
    return {name: v[name].drop("company_id", "year", "quarter") for name in ("financial_data", "sections", "report_tables", "charts")}


def _stored_periods(v: Views, root: str) -> None:
    store.replace_periods(v.spark, root, v["periods"], _children(v))


@query("""
SELECT p.id, CASE WHEN p.quarter = 2 THEN 'replaced' ELSE p.source_file END AS source_file,
       coalesce(CASE WHEN p.quarter = 2 THEN f.income ELSE f.n END, 0) AS statements,
       coalesce(s.n, 0) AS sections, CASE WHEN p.quarter = 2 THEN 0 ELSE coalesce(t.n, 0) END AS tables,
       CAST(CASE WHEN p.quarter = 2 THEN 0 ELSE 1 END AS BIGINT) AS charts
FROM {periods} p
LEFT JOIN (SELECT period_id, count(*) AS n, count(*) FILTER (WHERE statement_type = 'resultatrakning') AS income
           FROM {financial_data} GROUP BY period_id) f ON f.period_id = p.id
LEFT JOIN (SELECT period_id, count(*) AS n FROM {sections} GROUP BY period_id) s ON s.period_id = p.id
LEFT JOIN (SELECT period_id, count(*) AS n FROM {tables} GROUP BY period_id) t ON t.period_id = p.id""")
def replaced_periods(v: Views) -> DataFrame:
    """All periods stored, those of second quarters replaced: fewer statements, no tables, charts that cannot be written."""
    root = _folder(v)
    v.keep("period_counts", "financial_data", "chart_points")  # few rows a period, from all lines and orders
    _stored_periods(v, root)
    again = v["periods"].filter("quarter = 2").withColumn("source_file", F.lit("replaced"))
    children = _children(v)
    children["financial_data"] = children["financial_data"].filter("statement_type = 'resultatrakning'")
    children["report_tables"] = children["report_tables"].filter("false")
    children["charts"] = children["charts"].withColumn("title", F.raise_error(F.col("title")).cast("string"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        store.replace_periods(v.spark, root, again, children)

    def stored(name: str) -> DataFrame:
        return v.spark.read.parquet(f"{root}/{name}")

    parts = [stored("periods").select("id", "source_file")]
    for name, shown in (("financial_data", "statements"), ("sections", "sections"), ("report_tables", "tables"), ("charts", "charts")):
        parts.append(stored(name).groupBy(F.col("period_id").alias("id")).agg(F.count("*").alias(shown)))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "id", "left")
    return out.fillna(0, ["statements", "sections", "tables", "charts"])


@query("""
SELECT p.id, CAST(p.embeddings_count + coalesce(n, 0) AS BIGINT) AS embeddings_count
FROM {periods} p LEFT JOIN (SELECT period_id, count(embedding) AS n FROM {section_vectors} GROUP BY period_id) s ON s.period_id = p.id""")
def added_vector_counts(v: Views) -> DataFrame:
    """A stream of all sections counts their vectors into the stored periods; a second run of the stream adds nothing."""
    root = _folder(v)
    store.replace_periods(v.spark, root, v["periods"], {})
    sections = v["section_vectors"].select("id", "period_id", "embedding")
    sections.write.parquet(f"{root}/new")
    for _ in range(2):
        new = v.spark.readStream.schema(sections.schema).parquet(f"{root}/new")
        _ended(streams.count_new_vectors(new, root, f"{root}/seen"))
    return v.spark.read.parquet(f"{root}/periods").select("id", F.col("embeddings_count").cast("bigint").alias("embeddings_count"))


@query(FILE_PLAN)
def streamed_file_plan(v: Views) -> DataFrame:
    """The rename plan of the report files as a stream."""
    root = _folder(v)
    report_files(v).write.parquet(f"{root}/new")
    new = v.spark.readStream.schema("folder bigint, name string, text string").parquet(f"{root}/new")
    _ended(streams.plan_new_files(new, f"{root}/plan", f"{root}/seen"))
    return v.spark.read.parquet(f"{root}/plan").select("folder", "name", "action", "new_name")


@query("SELECT DISTINCT 'b' || batch_id || '/' || path AS path FROM {file_events}")
def streamed_first_events(v: Views) -> DataFrame:
    """Repeated file events of a stream."""
    root = _folder(v)
    start = F.timestamp_seconds(F.col("ts") + 1_700_000_000)
    events = v["file_events"].select(F.concat(F.lit("b"), F.col("batch_id").cast("string"), F.lit("/"), "path").alias("path"), start.alias("ts"))
    events.write.parquet(f"{root}/new")
    new = v.spark.readStream.schema("path string, ts timestamp").parquet(f"{root}/new")
    once = streams.first_file_events(new).select("path").writeStream.format("parquet").option("path", f"{root}/once")
    _ended(once.option("checkpointLocation", f"{root}/seen").trigger(availableNow=True).start())
    return v.spark.read.parquet(f"{root}/once")


@query("""
SELECT 'part=' || part AS folder, substring(md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)), 1, 12) AS md5_12
FROM (SELECT doc_id, text, doc_id // 100 AS part FROM {documents}) GROUP BY part""")
def file_hashes(v: Views) -> DataFrame:
    """Inventory of text files of a hundred documents each."""
    root = _folder(v)
    parts = v["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("doc_id div 100").alias("part"))
    parts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(f"{root}/files")
    return files.file_inventory(v.spark, f"{root}/files", "*.txt").select("folder", "md5_12")


@query("""
SELECT sha256('bransch|' || lang || '|' || source || ' ' || doc_id || '|' || coalesce(text, '')) AS id, source || ' ' || doc_id AS title,
       [source] AS tags, 0 AS metrics
FROM {documents} WHERE lang IN ('en', 'fr')""")
def loaded_knowledge(v: Views) -> DataFrame:
    """Items as JSON lines, loaded, appended to the stored entries and read by their schema; some have no valid domain."""
    root = _folder(v)
    items = v["documents"].select(
        F.when(F.col("lang").isin("en", "fr"), "bransch").otherwise("annat").alias("domain"), F.col("lang").alias("category"),
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("content"),
        F.array("source").alias("tags"),
    )
    items.write.json(f"{root}/items")
    store.append(knowledge.new_entries(tables.read_knowledge_items(v.spark, f"{root}/items")), f"{root}/knowledge")
    stored = tables.read_table(v.spark, root, "knowledge")
    return stored.select("id", "title", "tags", F.size("related_metrics").alias("metrics"))


@query("""
SELECT period, row_number() OVER (ORDER BY year, quarter, period) AS place FROM (
  SELECT DISTINCT 'Q' || quarter || ' ' || year AS period, year, quarter FROM {periods} UNION ALL
  SELECT DISTINCT 'år ' || year, 0, 0 FROM {periods})""")
def sorted_labels(v: Views) -> DataFrame:
    """Labels of periods in time order; those that name no quarter come first."""
    year = F.col("year").cast("string")
    labels = v["periods"].select(F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), year).alias("period")).unionByName(
        v["periods"].select(F.concat(F.lit("år "), year).alias("period"))
    ).distinct()
    in_order = lookup.sort_by_period(labels).withColumn("_at", F.monotonically_increasing_id())
    return ranked(in_order, [], ["_at"], "place").select("period", "place")


@query("SELECT page_id // 5 AS doc_id, CAST(count(*) * 0.001 AS DOUBLE) AS cost_usd FROM {pages} GROUP BY page_id // 5")
def ocr_costs(v: Views) -> DataFrame:
    pages = v["pages"].groupBy(F.expr("page_id div 5").alias("doc_id")).agg(F.count("*").alias("pages"))
    return pages.select("doc_id", stats.ocr_cost_usd(F.col("pages")).alias("cost_usd")).select("doc_id", double("cost_usd"))


@query("""
SELECT CAST(period_id AS VARCHAR) AS report, CAST(id AS VARCHAR) AS item_id, 'empty_table' AS error_type, 'error' AS severity FROM {tables} WHERE id % 3 = 0""")
def empty_tables(v: Views) -> DataFrame:
    """Every third table has lost its rows."""
    rows = F.when(F.col("id") % 3 != 0, F.col("rows"))
    lost = v["report_tables"].withColumn("rows", F.when(F.col("id") % 2 == 0, F.coalesce(rows, F.slice("rows", 1, 0))).otherwise(rows))
    found = quality.table_findings(lost.withColumn("report", F.col("period_id")).withColumn("id", F.col("id").cast("string")))
    return found.filter("error_type = 'empty_table'").select(F.col("report").cast("string").alias("report"), "item_id", "error_type", "severity")


_SCOPE = ["Q2 1996", "Q3 1996", "Q1 1998"]


@query(f"SELECT CAST(company_id AS VARCHAR) AS company_id, sheet, count(*) AS cells, count(number) AS numbers FROM ({export_sql(_SCOPE)}) GROUP BY company_id, sheet")
def stored_export(v: Views) -> DataFrame:
    """An export of some periods, written as a dataset for each sheet and read back."""
    root = _folder(v)
    export.write_cells(export.databook_cells(export_reports(v), _SCOPE), root)
    cells = v.spark.read.parquet(root)
    return cells.groupBy(F.col("company_id").cast("string").alias("company_id"), "sheet").agg(
        F.count("*").alias("cells"), F.count("number").alias("numbers")
    )
