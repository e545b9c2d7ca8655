"""Queries over event time: batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.operators import status
from reportloom.plans.catalog import query
from reportloom.plans.views import Views
from reportloom.streaming import streams


@query("""
SELECT event_id, event_type AS key, in_window, in_window >= 4 AS at_limit FROM (
  SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts
         RANGE BETWEEN INTERVAL '1199.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window FROM {events})""")
def requests_in_window(v: Views) -> DataFrame:
    requests = v["events"].select(F.col("event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.requests_in_window(requests, 4, 1200).select("event_id", "key", "in_window", "at_limit")


@query("""
SELECT job_id, arg_max(status, (ts, event_id)) AS status,
       coalesce(arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL), 0) AS progress,
       arg_max(cost_sek, (ts, event_id)) FILTER (WHERE cost_sek IS NOT NULL) AS cost_sek
FROM (SELECT *, CASE status WHEN 'extracting' THEN 15 WHEN 'pass_1' THEN 25 WHEN 'done' THEN 100 END AS progress FROM {job_events})
GROUP BY job_id""")
def latest_job_state(v: Views) -> DataFrame:
    return status.job_list(status.latest_job_state(v["job_events"]))


@query("SELECT period_id, count(embedding) AS embeddings_count FROM {section_vectors} GROUP BY period_id")
def vector_counts(v: Views) -> DataFrame:
    return streams.vector_counts(v["section_vectors"])


@query("""
SELECT conv_id, turn, substring(text, 1, 2000) AS message FROM {conversations} WHERE role <> 'system'""")
def log_rows(v: Views) -> DataFrame:
    level = F.when(F.col("role") == "system", "DEBUG").when(F.col("role") == "user", "INFO").otherwise("ERROR")
    logs = v["conversations"].select("conv_id", "turn", level.alias("log_level"), F.col("text").alias("message"))
    return streams.log_rows(logs).select("conv_id", "turn", "message")
