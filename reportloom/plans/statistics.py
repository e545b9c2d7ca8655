"""Statistics, cost and status queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.operators import compare, knowledge, lookup, stats, status
from reportloom.plans.catalog import double, query
from reportloom.plans.views import Views
from reportloom.sources import sinks

_GLOBAL = """
SELECT c.id AS company_id, c.name AS company_name, c.slug AS company_slug, count(p.id) AS reports_count,
       CAST(coalesce(sum(p.tables_count), 0) AS BIGINT) AS tables_total,
       CAST(coalesce(sum(p.sections_count), 0) AS BIGINT) AS sections_total,
       CAST(coalesce(sum(p.charts_count), 0) AS BIGINT) AS charts_total,
       CAST(coalesce(sum(p.embeddings_count), 0) AS BIGINT) AS embeddings_total,
       CAST(coalesce(sum(p.cost_sek), 0) AS DOUBLE) AS cost_total,
       CAST(coalesce(sum(p.extraction_time_seconds), 0) AS DOUBLE) AS time_total,
       count(p.id) FILTER (WHERE p.extraction_status = 'success') AS success_count,
       count(p.id) FILTER (WHERE p.extraction_status = 'partial') AS partial_count,
       count(p.id) FILTER (WHERE p.extraction_status = 'failed') AS failed_count
FROM {companies} c LEFT JOIN {periods} p ON c.id = p.company_id GROUP BY c.id, c.name, c.slug"""


@query(_GLOBAL)
def global_stats(v: Views) -> DataFrame:
    out = stats.global_stats(v["companies"], v["periods"])
    return out.select(*[double(c) if c in ("cost_total", "time_total") else F.col(c) for c in out.columns])


@query(f"""
SELECT count(*) AS total_companies, CAST(sum(reports_count) AS BIGINT) AS total_reports,
       CAST(sum(tables_total) AS BIGINT) AS total_tables, CAST(sum(sections_total) AS BIGINT) AS total_sections,
       CAST(sum(charts_total) AS BIGINT) AS total_charts,
       (SELECT CAST(round(sum(cost_sek), 2) AS DOUBLE) FROM {{periods}}) AS total_cost_sek
FROM ({_GLOBAL})""")
def grand_totals(v: Views) -> DataFrame:
    totals = stats.grand_totals(stats.global_stats(v["companies"], v["periods"]))
    return totals.withColumn("total_cost_sek", double("total_cost_sek"))


@query("""
SELECT id AS period_id, quarter, year, extraction_status, tables_count, sections_count, charts_count, embeddings_count,
       CAST(cost_sek AS DOUBLE) AS cost_sek, CAST(extraction_time_seconds AS DOUBLE) AS extraction_time_seconds,
       error_count, warning_count FROM {periods} WHERE company_id = 7""")
def company_stats(v: Views) -> DataFrame:
    out = stats.company_stats(v["periods"], 7)
    return out.select(*[
        double(c) if c in ("cost_sek", "extraction_time_seconds") else F.col(c) for c in out.columns
    ])


@query("""
SELECT c.id AS company_id, c.name, c.slug, coalesce(p.n, 0) AS total_reports, coalesce(p.t, 0) AS total_tables,
       coalesce(p.s, 0) AS total_sections, coalesce(p.c, 0) AS total_charts, coalesce(p.e, 0) AS total_embeddings,
       coalesce(p.cost, 0) AS total_cost_sek, coalesce(p.secs, 0) AS total_time_seconds, coalesce(o.n, 0) AS open_errors
FROM {companies} c
LEFT JOIN (SELECT company_id, count(*) AS n, CAST(sum(tables_count) AS BIGINT) AS t, CAST(sum(sections_count) AS BIGINT) AS s,
                  CAST(sum(charts_count) AS BIGINT) AS c, CAST(sum(embeddings_count) AS BIGINT) AS e,
                  CAST(sum(cost_sek) AS DOUBLE) AS cost, CAST(sum(extraction_time_seconds) AS DOUBLE) AS secs
           FROM {periods} GROUP BY company_id) p ON p.company_id = c.id
LEFT JOIN (SELECT q.company_id, count(*) AS n FROM {errors} e JOIN {periods} q ON q.id = e.period_id WHERE NOT e.resolved
           GROUP BY q.company_id) o ON o.company_id = c.id""")
def company_rollup(v: Views) -> DataFrame:
    out = stats.company_rollup(v["companies"], v["periods"], v["errors"])
    return out.select(*[
        double(c) if c in ("total_cost_sek", "total_time_seconds") else F.col(c) for c in out.columns
    ])


_CHILDREN = """
  SELECT p.*, coalesce(t.n, 0) AS tables, coalesce(s.n, 0) AS sections, coalesce(s.v, 0) AS vectors, coalesce(c.n, 0) AS charts
  FROM {periods} p
  LEFT JOIN (SELECT period_id, count(*) AS n FROM {tables} GROUP BY period_id) t ON t.period_id = p.id
  LEFT JOIN (SELECT period_id, count(*) AS n, count(embedding) AS v FROM {section_vectors} GROUP BY period_id) s ON s.period_id = p.id
  LEFT JOIN (SELECT period_id, count(DISTINCT period_id) AS n FROM {chart_points} GROUP BY period_id) c ON c.period_id = p.id"""


@query(f"""
SELECT company_id, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(sections) AS BIGINT) AS sections,
       CAST(sum(charts) AS BIGINT) AS charts FROM ({_CHILDREN}) GROUP BY company_id""")
def company_child_counts(v: Views) -> DataFrame:
    return stats.company_child_counts(v["periods"], v["report_tables"], v["sections"], v["charts"])


@query(f"""
SELECT company_id, CAST(sum(sections) AS BIGINT) AS sections_total, CAST(sum(vectors) AS BIGINT) AS sections_with_embedding,
       CAST(sum(sections) - sum(vectors) AS BIGINT) AS missing,
       CASE WHEN sum(sections) = 0 THEN 'none' WHEN sum(sections) = sum(vectors) THEN 'complete' ELSE 'missing' END AS verdict
FROM ({_CHILDREN}) GROUP BY company_id""")
def embedding_coverage(v: Views) -> DataFrame:
    return stats.embedding_coverage(v["periods"], v["section_vectors"])


@query(f"""
SELECT id, tables || '/' || CASE WHEN id % 7 = 0 THEN '?' ELSE CAST(tables_count AS VARCHAR) END AS tables_status,
       sections || '/' || CASE WHEN id % 7 = 0 THEN '?' ELSE CAST(warning_count AS VARCHAR) END AS sections_status,
       charts || '/' || CASE WHEN id % 7 = 0 OR quarter = 2 THEN '?' ELSE CAST(charts_count AS VARCHAR) END AS charts_status
FROM ({_CHILDREN})""")
def found_and_extracted(v: Views) -> DataFrame:
    counted = lookup.child_counts(v["meta_periods"], v["report_tables"], v["sections"], v["charts"])
    return stats.found_and_extracted(stats.with_found_counts(counted)).select(
        "id", "tables_status", "sections_status", "charts_status"
    )


@query(f"""
SELECT company_id, x.kind, CAST(CASE x.kind WHEN 'tables' THEN lt WHEN 'sections' THEN ls ELSE lc END AS BIGINT) AS logged,
       CAST(CASE x.kind WHEN 'tables' THEN t WHEN 'sections' THEN s ELSE c END AS BIGINT) AS stored,
       CASE x.kind WHEN 'tables' THEN lt = t WHEN 'sections' THEN ls = s ELSE lc = c END AS ok
FROM (SELECT company_id, sum(tables_count) AS lt, sum(sections_count) AS ls, sum(charts_count) AS lc, sum(tables) AS t,
             sum(sections) AS s, sum(charts) AS c FROM ({_CHILDREN}) GROUP BY company_id) y
JOIN (VALUES ('tables'), ('sections'), ('charts')) x(kind) ON TRUE""")
def consistency_check(v: Views) -> DataFrame:
    return stats.consistency_check(v["periods"], v["report_tables"], v["sections"], v["charts"])


@query("""
SELECT p.id AS period_id, 'Q' || p.quarter || ' ' || p.year || ' ' || c.name AS rapport, x.beskrivning, x.bedomning
FROM {periods} p JOIN {companies} c ON c.id = p.company_id JOIN (
  SELECT id, 'SAKNAD: ''Kassaflöde'' (sida ' || CASE WHEN quarter = 1 THEN '?' ELSE '7' END || ')' AS beskrivning,
         'Kritiskt' AS bedomning FROM {periods} WHERE tables_count % 4 = 0
  UNION ALL SELECT id, 'FEL: ''' || source_file || ''' - m', CASE WHEN quarter = 3 THEN 'Medel' ELSE 'Kritiskt' END FROM {periods}
  UNION ALL SELECT id, 'VARNING: Sektion ''?'' - w', 'Lag' FROM {periods} WHERE quarter = 4) x ON x.id = p.id
WHERE p.id % 7 <> 0""")
def all_problems(v: Views) -> DataFrame:
    return stats.all_problems(v["meta_periods"], v["companies"])


@query("""
SELECT report, count(*) AS passes, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(elapsed_seconds) AS BIGINT) AS total_elapsed_seconds,
       CAST(sum(((input_tokens * CASE model WHEN 'haiku' THEN 80 ELSE 300 END
                  + output_tokens * CASE model WHEN 'haiku' THEN 400 ELSE 1500 END) * 1050 + 5000) // 10000) AS DOUBLE) / 1000000
         AS total_cost_sek
FROM {passes} GROUP BY report""")
def pass_totals(v: Views) -> DataFrame:
    return stats.pass_totals(v["passes"]).drop("retries").withColumn("total_cost_sek", double("total_cost_sek"))


@query("""
SELECT p.id AS report, CASE WHEN EXISTS (SELECT 1 FROM {errors} e WHERE e.period_id = p.id AND e.severity = 'error'
                                         AND e.component IN ('tables', 'embeddings')) THEN 'partial' ELSE 'success' END
       AS final_status FROM {periods} p""")
def final_status(v: Views) -> DataFrame:
    errors = v["errors"].withColumnRenamed("period_id", "report")
    return stats.final_status(v["periods"].select(F.col("id").alias("report")), errors)


@query(f"""
SELECT id, CASE WHEN due THEN tables ELSE tables_count END AS tables_count,
       CASE WHEN due THEN sections ELSE sections_count END AS sections_count,
       CASE WHEN due THEN charts ELSE charts_count END AS charts_count,
       CASE WHEN due THEN vectors ELSE embeddings_count END AS embeddings_count,
       CASE WHEN due AND id % 7 = 0 THEN 0 ELSE CAST(cost_sek AS DOUBLE) END AS cost_sek,
       CASE WHEN NOT due THEN extraction_status WHEN id % 7 = 0 THEN 'success' WHEN error_count >= 8 THEN 'partial'
            WHEN quarter <> 1 AND error_count % 3 > 0 THEN 'partial' ELSE 'success' END AS extraction_status,
       CASE WHEN NOT due THEN error_count WHEN id % 7 = 0 OR quarter = 1 THEN 0 ELSE error_count % 3 END AS error_count,
       CASE WHEN due AND id % 7 = 0 THEN 0 ELSE warning_count END AS warning_count
FROM (SELECT *, extraction_status = 'pending' AS due FROM ({_CHILDREN}))""")
def backfill_counters(v: Views) -> DataFrame:
    out = stats.backfill_counters(v["meta_periods"], v["report_tables"], v["section_vectors"], v["charts"])
    return out.select(
        "id", *[F.col(c).cast("bigint").alias(c) for c in ("tables_count", "sections_count", "charts_count", "embeddings_count")],
        double("cost_sek"), "extraction_status", "error_count", "warning_count",
    )


@query("""
SELECT p.id, CASE WHEN p.id % 9 = 0 THEN 'success' ELSE p.extraction_status END AS extraction_status,
       CASE WHEN p.id % 9 = 0 THEN 99 ELSE p.embeddings_count END AS embeddings_count,
       CASE WHEN e.period_id IS NULL THEN CAST(p.error_count AS BIGINT) ELSE e.errors END AS error_count,
       CASE WHEN e.period_id IS NULL THEN CAST(p.warning_count AS BIGINT) ELSE e.warnings END AS warning_count
FROM {periods} p LEFT JOIN (
  SELECT period_id, count(*) FILTER (WHERE severity IN ('critical', 'error')) AS errors,
         count(*) FILTER (WHERE severity = 'warning') AS warnings FROM {errors} GROUP BY period_id) e ON e.period_id = p.id""")
def status_updates(v: Views) -> DataFrame:
    updates = v["periods"].filter("id % 9 = 0").select("id", F.lit("success").alias("status"), F.lit(99).alias("embeddings_count"))
    return stats.apply_status_updates(v["periods"], updates, v["errors"]).select(
        "id", "extraction_status", "embeddings_count", "error_count", "warning_count"
    )


@query("""
SELECT c.name AS company, count(p.id) AS reports, CAST(coalesce(sum(p.tables_count), 0) AS BIGINT) AS tables,
       CAST(coalesce(sum(p.sections_count), 0) AS BIGINT) AS sections, CAST(coalesce(sum(p.charts_count), 0) AS BIGINT) AS charts
FROM {companies} c LEFT JOIN {periods} p ON p.company_id = c.id GROUP BY ROLLUP (c.name)""")
def company_summary(v: Views) -> DataFrame:
    return stats.company_summary(v["companies"], v["periods"])


_BATCH = """
  SELECT batch_id, count(*) AS total_files, count(*) FILTER (WHERE status = 'done') AS completed_files,
         count(*) FILTER (WHERE status = 'failed') AS failed_files,
         coalesce(sum(cost_sek) FILTER (WHERE status = 'done'), 0) AS total_cost_sek FROM {batch_jobs} GROUP BY batch_id"""


@query(f"""
SELECT *, CASE WHEN completed_files = total_files THEN 'done' WHEN failed_files = total_files THEN 'failed'
               WHEN completed_files + failed_files = total_files THEN 'partial_failure'
               WHEN completed_files + failed_files > 0 THEN 'processing' ELSE 'pending' END AS status FROM ({_BATCH})""")
def batch_status(v: Views) -> DataFrame:
    return status.batch_status(v["batch_jobs"])


@query(f"SELECT batch_id, total_files, completed_files, failed_files FROM ({_BATCH})")
def batch_overview(v: Views) -> DataFrame:
    return status.batch_overview(v["batch_jobs"])


_FOLDED = """
  SELECT batch_id, path, outcome, ts, error, total_files FROM (
    SELECT *, row_number() OVER (PARTITION BY batch_id, path, outcome ORDER BY ts, error) AS rn FROM {file_events}) WHERE rn = 1"""


@query(_FOLDED)
def fold_file_events(v: Views) -> DataFrame:
    return status.fold_file_events(v["file_events"])


_PROGRESS = f"""
  SELECT batch_id, count(*) FILTER (WHERE outcome = 'completed') AS completed,
         count(*) FILTER (WHERE outcome = 'failed') AS failed, max(total_files) AS total FROM ({_FOLDED}) GROUP BY batch_id"""


@query(_PROGRESS)
def batch_progress(v: Views) -> DataFrame:
    return status.batch_progress(status.fold_file_events(v["file_events"]))


@query(f"""
SELECT *, total - completed - failed AS remaining FROM ({_PROGRESS}) WHERE total > 0 AND completed + failed < total""")
def resumable_batches(v: Views) -> DataFrame:
    return status.resumable_batches(status.fold_file_events(v["file_events"]))


@query(f"SELECT batch_id, path, error, ts FROM ({_FOLDED}) WHERE outcome = 'failed' AND path IN ('f0.pdf', 'f2.pdf')")
def retry_set(v: Views) -> DataFrame:
    inventory = v["file_events"].select("path").filter(F.col("path").isin("f0.pdf", "f2.pdf")).distinct()
    return status.retry_set(status.fold_file_events(v["file_events"]), inventory).select("batch_id", "path", "error", "ts")


@query("""
SELECT domain, category, title, id, count(*) OVER (PARTITION BY domain, category) AS in_category, count(*) OVER () AS total
FROM {knowledge}""")
def list_knowledge(v: Views) -> DataFrame:
    entries = v["knowledge"].withColumn("tags", F.array("category"))
    return knowledge.list_knowledge(entries).drop("tags")


@query(f"""
SELECT p.company_id, c.name, 'Q' || p.quarter || ' ' || p.year AS period, p.tables_status, p.sections_status, p.charts_status,
       CAST(p.cost_sek AS DOUBLE) AS cost_sek
FROM (SELECT *, tables || '/' || CASE WHEN id % 7 = 0 THEN '?' ELSE CAST(tables_count AS VARCHAR) END AS tables_status,
             sections || '/' || CASE WHEN id % 7 = 0 THEN '?' ELSE CAST(warning_count AS VARCHAR) END AS sections_status,
             charts || '/' || CASE WHEN id % 7 = 0 OR quarter = 2 THEN '?' ELSE CAST(charts_count AS VARCHAR) END AS charts_status
      FROM ({_CHILDREN})) p JOIN {{companies}} c ON c.id = p.company_id""")
def extraction_report(v: Views) -> DataFrame:
    out = sinks.extraction_report(v["companies"], v["meta_periods"], v["report_tables"], v["sections"], v["charts"])
    return out.select("company_id", "name", "period", "tables_status", "sections_status", "charts_status", double("cost_sek"))


@query("""
SELECT report, 'm' || report AS metadata, CAST(sum(((input_tokens * CASE model WHEN 'haiku' THEN 80 ELSE 300 END
         + output_tokens * CASE model WHEN 'haiku' THEN 400 ELSE 1500 END) * 1050 + 5000) // 10000) AS DOUBLE) / 1000000
         AS total_cost_sek
FROM (SELECT id AS report, 'haiku' AS model, CAST(floor(cost_sek) AS BIGINT) AS input_tokens, open_count AS output_tokens FROM {periods}
      UNION ALL SELECT id, 'sonnet', error_count, warning_count FROM {periods}
      UNION ALL SELECT id, 'sonnet', tables_count, charts_count FROM {periods}) GROUP BY report""")
def merge_passes(v: Views) -> DataFrame:
    def one(model: str, tokens_in: str, tokens_out: str, *data: str) -> DataFrame:
        value = F.concat(F.lit("m"), F.col("id").cast("string"))
        return v["periods"].select(
            F.col("id").alias("report"), F.lit(model).alias("model"), F.expr(tokens_in).alias("input_tokens"),
            F.expr(tokens_out).alias("output_tokens"), F.struct(*[value.alias(d) for d in data]).alias("data"),
        )

    merged = stats.merge_passes(
        one("haiku", "cast(floor(cost_sek) as bigint)", "open_count", "metadata"),
        one("sonnet", "error_count", "warning_count", "tables", "charts"),
        one("sonnet", "tables_count", "charts_count", "sections"),
    )
    return merged.select("report", "metadata", double("total_cost_sek"))


@query("""
SELECT id, title, page_number, table_type, CAST(NULL AS VARCHAR) AS section_type FROM {tables}
UNION ALL SELECT id, title, page_number, NULL, section_type FROM {sections}""")
def one_shape(v: Views) -> DataFrame:
    """Rows of two producers under one set of columns."""
    return compare.one_shape([
        v["report_tables"].select("id", "title", "page_number", "table_type"),
        v["sections"].select("id", "title", "page_number", "section_type"),
    ])
