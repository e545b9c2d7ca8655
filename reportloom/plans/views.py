"""Model tables derived from the star-schema tables, for queries and benches.

The flat views are plain SQL that Spark and the checking engine both read; ``{name}`` stands for a base table or
another view. The nested views are built from them with the DataFrame API.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from reportloom.schemas import EXTRACTION_META
from reportloom.session import cut_lineage

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

FLAT = {
    "companies": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(replace(n_name, '_', '-')) AS slug FROM {nation}
        UNION ALL
        SELECT CAST(1000 + r_regionkey AS BIGINT), r_name, lower(replace(r_name, ' ', '-')) FROM {region}""",
    "order_periods": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority, company_id, year, quarter, month,
               CAST(o_totalprice AS DECIMAL(18,2)) AS price, company_id * 100000 + year * 10 + quarter AS period_id
        FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(c_nationkey AS BIGINT) AS company_id,
                     CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter,
                     CAST(month(o_orderdate) AS INT) AS month
              FROM {orders} JOIN {customer} ON o_custkey = c_custkey) t""",
    "period_counts": """
        SELECT period_id AS id, company_id, year, quarter,
               CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INT) AS tables_count,
               CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS INT) AS sections_count,
               CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS INT) AS charts_count,
               CAST(sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS INT) AS embeddings_count,
               CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INT) AS error_count,
               CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS INT) AS warning_count,
               CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS INT) AS open_count,
               CAST(sum(price) AS DECIMAL(28,2)) AS cost_sek,
               CAST(sum(o_orderkey % 100) AS DECIMAL(28,2)) AS extraction_time_seconds
        FROM {order_periods} GROUP BY period_id, company_id, year, quarter""",
    "periods": """
        SELECT id, company_id, year, quarter,
               CASE company_id % 3 WHEN 0 THEN 'MSEK' WHEN 1 THEN 'NOKm' ELSE 'EURm' END AS valuta,
               CASE company_id % 3 WHEN 0 THEN 'sv' WHEN 1 THEN 'no' ELSE 'en' END AS language,
               substring(md5(CAST(id AS STRING)), 1, 12) AS pdf_hash,
               concat('nation-', CAST(company_id AS STRING), '-', CAST(year AS STRING), '-q', CAST(quarter AS STRING), '.pdf')
                 AS source_file,
               CASE WHEN id % 11 = 0 THEN 'pending' WHEN error_count > warning_count AND error_count > open_count THEN 'failed'
                    WHEN warning_count > open_count THEN 'partial' ELSE 'success' END AS extraction_status,
               tables_count, sections_count, charts_count, embeddings_count, cost_sek, extraction_time_seconds,
               error_count, warning_count, open_count
        FROM {period_counts}""",
    "line_facts": """
        SELECT period_id, company_id, year, quarter, l_returnflag, p_type, p_brand,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price
        FROM {lineitem} JOIN {order_periods} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "financial_data": """
        SELECT period_id * 100 + flag_no * 10 + row_order AS id, period_id,
               CASE flag_no WHEN 0 THEN 'resultatrakning' WHEN 1 THEN 'balansrakning' ELSE 'kassaflodesanalys' END
                 AS statement_type,
               row_order, p_type AS row_name, value, CASE WHEN row_order = 5 THEN 'total' ELSE 'data' END AS row_type,
               company_id, year, quarter, flag_no
        FROM (SELECT period_id, company_id, year, quarter, p_type,
                     CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag_no,
                     CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3
                                 WHEN 'LARGE' THEN 4 ELSE 5 END AS row_order,
                     CAST(sum(price) AS DECIMAL(28,2)) AS value
              FROM {line_facts} GROUP BY period_id, company_id, year, quarter, p_type, l_returnflag) t""",
    "table_cells": """
        SELECT period_id, company_id, year, quarter, table_id, table_type, title, page_number, row_order,
               CASE WHEN m % 17 = 0 THEN 'row 1' ELSE label END AS label,
               CASE WHEN m % 19 = 0 THEN NULL ELSE label END AS label_en,
               CASE WHEN row_order = 0 THEN 'header' WHEN row_order = 5 THEN 'total' ELSE 'data' END AS row_type,
               CASE WHEN m % 13 = 0 THEN 'x' WHEN m % 13 = 1 THEN '1999' ELSE NULL END AS v0,
               CASE WHEN m % 7 = 0 THEN NULL ELSE CAST(value AS STRING) END AS v1,
               CASE WHEN m % 5 = 0 THEN 3 ELSE 2 END AS n_values
        FROM (SELECT period_id, company_id, year, quarter, period_id * 10 + flag_no AS table_id, row_order,
                     row_name AS label, value, CAST(floor(value) AS BIGINT) AS m,
                     CASE WHEN flag_no = 0 THEN 'income_statement' WHEN flag_no = 1 AND quarter = 2 THEN 'kpi'
                          WHEN flag_no = 1 THEN 'balance_sheet' WHEN quarter = 4 THEN 'quarterly'
                          WHEN quarter = 1 THEN NULL ELSE 'cash_flow' END AS table_type,
                     CASE WHEN flag_no = 0 THEN 'Income statement' WHEN flag_no = 1 THEN 'Balance sheet'
                          ELSE 'Koncernens kassaflöde' END AS title,
                     CASE WHEN flag_no = 2 AND quarter = 3 THEN CAST(NULL AS INT) ELSE 4 - flag_no END AS page_number
              FROM {financial_data} WHERE NOT (company_id % 5 = 4 AND flag_no = 0)) t""",
    "tables": """
        SELECT table_id AS id, period_id, company_id, year, quarter, table_type, title, page_number,
               CAST(count(*) AS INT) AS n_rows
        FROM {table_cells}
        GROUP BY table_id, period_id, company_id, year, quarter, table_type, title, page_number""",
    "brand_values": """
        SELECT period_id, company_id, year, quarter, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag_no,
               p_brand, CAST(substring(p_brand, 7) AS INT) AS brand_no, CAST(sum(price) AS DECIMAL(28,2)) AS value
        FROM {line_facts} GROUP BY period_id, company_id, year, quarter, l_returnflag, p_brand""",
    "expected_items": """
        SELECT period_id AS report, concat(p_brand, '-', CAST(flag_no AS STRING)) AS id, p_brand AS title,
               'table' AS type, brand_no % 9 + 1 AS page
        FROM (SELECT DISTINCT period_id, p_brand, brand_no, 0 AS flag_no FROM {brand_values}
              UNION ALL SELECT DISTINCT period_id, p_brand, brand_no, 1 FROM {brand_values}
              UNION ALL SELECT DISTINCT period_id, p_brand, brand_no, 2 FROM {brand_values}) t""",
    "extracted_items": """
        SELECT period_id AS report, concat(p_brand, '-', CAST(flag_no AS STRING)) AS id, p_brand AS title,
               'table' AS type, brand_no % 9 + 1 AS page, CAST(floor(value) AS BIGINT) AS m
        FROM {brand_values}""",
    "label_synonyms": """
        SELECT 'standard' AS synonym, 'common' AS canonical UNION ALL SELECT 'economy', 'common'
        UNION ALL SELECT 'small', 'sized' UNION ALL SELECT 'medium', 'sized' UNION ALL SELECT 'large', 'sized'""",
    "sections": """
        SELECT doc_id AS id, (doc_id % 25) * 100000 + (1995 + doc_id % 6) * 10 + 1 + doc_id % 4 AS period_id,
               doc_id % 25 AS company_id, substring(split_part(text, chr(10), 1), 1, 60) AS title,
               CAST(doc_id % 20 AS INT) AS page_number,
               CASE lang WHEN 'en' THEN 'narrative' WHEN 'fr' THEN 'summary' WHEN 'de' THEN 'outlook' ELSE 'risk' END
                 AS section_type,
               text AS content, source
        FROM {documents}""",
    "section_vectors": """
        SELECT s.id, s.period_id, s.company_id, s.title, s.page_number, s.section_type, s.content, e.embedding
        FROM {sections} s LEFT JOIN {embeddings} e ON s.id = e.vec_id""",
    "searchable_sections": """
        SELECT s.id, s.period_id, s.company_id, s.title, s.page_number, s.section_type, s.content, s.embedding, c.slug
        FROM {section_vectors} s JOIN {companies} c ON s.company_id = c.id""",
    "searches": """
        SELECT e.vec_id AS query_id, substring(d.text, 3, 30) AS words,
               CASE e.vec_id % 80 WHEN 0 THEN substring(d.text, 4, 4) WHEN 20 THEN upper(substring(d.text, 9, 8))
                                  WHEN 40 THEN concat('zq', CAST(e.vec_id AS STRING)) ELSE substring(d.text, 1, 2) END AS term,
               CASE WHEN e.vec_id % 140 <> 0 THEN e.embedding END AS vector,
               CASE WHEN e.vec_id % 220 = 0 THEN 'nobody' WHEN e.vec_id % 60 = 0 THEN c.slug END AS company_slug,
               CASE WHEN e.vec_id % 40 = 0 THEN substring(d.text, 4, 6)
                    ELSE concat(substring(d.text, 4, 3), '/', CAST(e.vec_id % 50 AS STRING)) END AS entry_text,
               CASE WHEN e.vec_id % 60 = 0 THEN 'bransch' END AS domain, CASE WHEN e.vec_id % 100 = 0 THEN 'c2' END AS category
        FROM {embeddings} e JOIN {documents} d ON e.vec_id = d.doc_id JOIN {companies} c ON c.id = e.vec_id % 25
        WHERE e.vec_id % 20 = 0""",
    "chart_points": """
        SELECT period_id, company_id, year, quarter, month, CAST(count(*) AS BIGINT) AS value
        FROM {order_periods} GROUP BY period_id, company_id, year, quarter, month""",
    "knowledge": """
        SELECT vec_id AS id, CASE label % 5 WHEN 0 THEN 'nyckeltal' WHEN 1 THEN 'redovisning' WHEN 2 THEN 'bransch'
                                            WHEN 3 THEN 'värdering' ELSE 'kvalitativ' END AS domain,
               concat('c', CAST(label AS STRING)) AS category,
               concat('entry ', CAST(vec_id % 50 AS STRING)) AS title, coalesce(text, '') AS content, embedding
        FROM {embeddings} LEFT JOIN {documents} ON vec_id = doc_id""",
    "errors": """
        SELECT event_id AS id, (user_id % 25) * 100000 + (1995 + event_id % 6) * 10 + 1 + event_id % 4 AS period_id,
               CASE WHEN value < 10 THEN 'missing_table' WHEN value < 40 THEN 'invalid_label' ELSE 'empty_content' END
                 AS error_type,
               CASE WHEN value < 10 THEN 'critical' WHEN value < 40 THEN 'error' ELSE 'warning' END AS severity,
               CASE WHEN value < 40 THEN 'tables' ELSE 'sections' END AS component, props AS details,
               event_id % 3 = 0 AS resolved
        FROM {events} WHERE event_type = 'error'""",
    "job_events": """
        SELECT user_id AS job_id, event_id, CAST(ts AS TIMESTAMP) AS ts,
               CASE event_type WHEN 'click' THEN 'extracting' WHEN 'view' THEN 'pass_1' WHEN 'purchase' THEN 'done'
                               WHEN 'error' THEN 'failed' ELSE 'queued' END AS status,
               CASE WHEN event_type = 'purchase' THEN value ELSE NULL END AS cost_sek
        FROM {events}""",
    "batch_jobs": """
        SELECT conv_id AS batch_id, turn AS job_id,
               CASE WHEN conv_id % 7 = 0 THEN 'done' WHEN role = 'assistant' THEN 'done' WHEN role = 'system' THEN 'pending'
                    WHEN conv_id % 3 = 0 THEN 'failed' ELSE 'pending' END AS status,
               CAST(length(text) AS DOUBLE) AS cost_sek
        FROM {conversations}""",
    "file_events": """
        SELECT conv_id AS batch_id, concat('f', CAST(turn % 4 AS STRING), '.pdf') AS path,
               CASE role WHEN 'assistant' THEN 'completed' ELSE 'failed' END AS outcome,
               substring(text, 1, 20) AS error, turn AS ts, CAST(conv_id % 6 AS INT) AS total_files
        FROM {conversations}""",
    "passes": """
        SELECT period_id AS report, CASE WHEN o_orderpriority = '5-LOW' THEN 'haiku' ELSE 'sonnet' END AS model,
               CAST(floor(price) AS BIGINT) AS input_tokens, o_orderkey % 5000 AS output_tokens,
               o_orderkey % 300 AS elapsed_seconds
        FROM {order_periods}""",
}

_NAME = re.compile(r"\{([a-z_]+)\}")
_UPPER = re.compile(r"\bupper\(((?:[^()]|\([^()]*\))*)\)")
# One character for one: Spark's upper() makes SS of ß, where the checking engine makes ẞ.
_UPPER_EACH = r"""array_join(transform(split(\1, ''), c -> CASE WHEN c = 'ß' THEN 'ẞ' WHEN char_length(upper(c)) = 1 THEN upper(c)
                  WHEN char_length(initcap(c)) = 1 THEN initcap(c) ELSE c END), '')"""


def checking_sql(query: str) -> str:
    """``query`` with every view it needs in front, as one SQL text."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in FLAT and name not in order:
                visit(FLAT[name])
                order.append(name)

    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text)

    visit(query)
    head = ",\n".join(f"{name} AS ({plain(FLAT[name])})" for name in order)
    return (f"WITH {head}\n" if head else "") + plain(query)


class Views:
    """Base tables of a folder and the views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in FLAT:
                text = _UPPER.sub(_UPPER_EACH, FLAT[name])
                self._made[name] = self.spark.sql(text, **{n: self[n] for n in set(_NAME.findall(text))})
            else:
                self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def keep(self, *names: str) -> None:
        """Store the rows of these views, so what is derived from them later does not compute them again. Runs jobs."""
        for name in names:
            self._made[name] = cut_lineage(self[name])

    def _report_tables(self) -> DataFrame:
        """Nested tables; a table has at most six rows here, one per part type."""
        text = F.lit(None).cast("string")
        values = F.when(F.col("n_values") == 3, F.array("v0", "v1", F.lit("n"))).otherwise(F.array("v0", "v1"))
        row = F.struct(
            "label", "label_en", text.alias("note_ref"), values.alias("values"), F.col("row_order").alias("order"),
            F.col("row_type").alias("type"), F.lit(0).alias("indent"),
        )
        rows = F.array_sort(F.collect_list(F.struct("row_order", row.alias("row"))))
        keys = ["table_id", "period_id", "company_id", "year", "quarter", "table_type", "title", "page_number"]
        label = F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"))
        return self["table_cells"].groupBy(*keys).agg(rows.alias("r")).select(
            F.col("table_id").alias("id"), *keys[1:], F.array(F.lit("MSEK"), label).alias("columns"),
            F.transform("r", lambda x: x["row"]).alias("rows"),
        )

    def _charts(self) -> DataFrame:
        """One chart per period with a point per month of the quarter."""
        point = F.struct(F.col("month").cast("string").alias("label"), F.col("value").cast("decimal(28,6)").alias("value"),
                         F.lit(None).cast("string").alias("segment"))
        return self["chart_points"].groupBy("period_id", "company_id", "year", "quarter").agg(
            F.array_sort(F.collect_list(F.struct("month", point.alias("p")))).alias("p")
        ).select(
            F.col("period_id").alias("id"), "period_id", "company_id", "year", "quarter",
            F.concat(F.lit("Orders "), F.col("year").cast("string")).alias("title"), F.col("quarter").alias("page_number"),
            F.lit("bar").alias("chart_type"), F.lit("month").alias("x_axis"),
            F.when(F.col("quarter") != 3, "antal").alias("y_axis"), (F.col("quarter") % 2 == 0).alias("estimated"),
            F.transform("p", lambda x: x["p"]).alias("data_points"), F.lit(None).cast("string").alias("image_path"),
        )

    def _meta_periods(self) -> DataFrame:
        """Periods with typed extraction metadata; every seventh has none."""
        parts = {
            "pass1_counts": F.struct(
                F.col("tables_count").alias("tables"), F.col("warning_count").alias("sections"),
                F.when(F.col("quarter") != 2, F.col("charts_count")).alias("charts"),
            ),
            "validation": F.struct(
                F.struct(
                    (F.col("error_count") < 8).alias("is_valid"),
                    F.when(F.col("quarter") != 1, F.col("error_count") % 3).alias("error_count"),
                    F.col("warning_count"),
                    F.array(F.struct(
                        F.lit("t1").alias("table_id"), F.col("source_file").alias("table_title"),
                        F.when(F.col("quarter") == 3, "invalid_label").otherwise("values_length_mismatch").alias("error_type"),
                        F.lit("m").alias("message"), F.lit(0).alias("row_index"),
                    )).alias("errors"),
                ).alias("tables"),
                F.struct(
                    F.lit(True).alias("is_valid"), F.lit(0).alias("error_count"), F.lit(1).alias("warning_count"),
                    F.filter(F.array(F.struct(
                        F.lit("s1").alias("section_id"), F.lit(None).cast("string").alias("section_title"),
                        F.lit("missing_title").alias("warning_type"), F.lit("w").alias("message"),
                    )), lambda _: F.col("quarter") == 4).alias("warnings"),
                ).alias("sections"),
            ),
            "missing_tables": F.filter(F.array(F.struct(
                F.lit("t9").alias("table_id"), F.lit("Kassaflöde").alias("table_title"),
                F.when(F.col("quarter") == 1, F.lit(None)).otherwise(F.lit("7")).cast("string").alias("page"),
                F.lit("cash_flow").alias("type"),
            )), lambda _: F.col("tables_count") % 4 == 0),
            "total_cost_sek": F.col("cost_sek").cast("double"),
            "total_elapsed_seconds": F.col("extraction_time_seconds").cast("double"),
        }
        names = ["retry_stats", "validation", "total_cost_sek", "total_elapsed_seconds", "passes", "pass1_counts", "missing_tables"]
        meta = F.struct(*[parts.get(n, F.lit(None)).alias(n) for n in names]).cast(EXTRACTION_META)
        return self["periods"].withColumn("extraction_meta", F.when(F.col("id") % 7 != 0, meta))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
