"""Job, batch and checkpoint status folded from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.scale import first_per_key
from reportloom.vocabulary import JOB_PROGRESS


def latest_job_state(events: DataFrame) -> DataFrame:
    """Latest state per job from its events.

    Progress is that of the last status with a known progress, cost the last one reported, so an unknown
    status keeps both. Aggregates only: a hot job is reduced on the map side.
    """
    known = F.create_map(*[F.lit(x) for pair in JOB_PROGRESS.items() for x in pair])
    progress = F.try_element_at(known, F.col("status"))
    order = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.coalesce(F.max_by(progress, F.when(progress.isNotNull(), order)), F.lit(0)).alias("progress"),
        F.max_by("cost_sek", F.when(F.col("cost_sek").isNotNull(), order)).alias("cost_sek"),
        F.max("ts").alias("updated_at"),
    )


def _batch_status(total: Column, done: Column, failed: Column) -> Column:
    return (
        F.when(done == total, "done").when(failed == total, "failed").when(done + failed == total, "partial_failure")
        .when(done + failed > 0, "processing").otherwise("pending")
    )


def batch_status(jobs: DataFrame) -> DataFrame:
    """Status, counts and cost of done jobs per batch (jobs: batch_id, job_id, status, cost_sek)."""
    done = F.col("status") == "done"
    counted = jobs.groupBy("batch_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(done).alias("completed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
        F.coalesce(F.sum(F.when(done, F.col("cost_sek"))), F.lit(0)).alias("total_cost_sek"),
    )
    return counted.withColumn(
        "status", _batch_status(F.col("total_files"), F.col("completed_files"), F.col("failed_files"))
    )


def batch_overview(jobs: DataFrame) -> DataFrame:
    return batch_status(jobs).select("batch_id", "total_files", "completed_files", "failed_files")


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "status", "progress", "cost_sek")


def fold_file_events(events: DataFrame) -> DataFrame:
    """One row per batch, file and outcome: the first report of it counts, repeats are ignored."""
    return first_per_key(events, ["batch_id", "path", "outcome"], ["ts", "error"])


def failed_files(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("outcome") == "failed").select("batch_id", "path", "error", "ts")


def completed_files(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("outcome") == "completed").select("batch_id", "path")


def batch_progress(folded: DataFrame) -> DataFrame:
    """Completed, failed and total per batch; the last known total counts."""
    return folded.groupBy("batch_id").agg(
        F.count_if(F.col("outcome") == "completed").alias("completed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.coalesce(F.max_by("total_files", F.when(F.col("total_files") > 0, F.struct("ts", "path"))), F.lit(0))
        .alias("total"),
    )


def resumable_batches(folded: DataFrame) -> DataFrame:
    left = F.col("total") - F.col("completed") - F.col("failed")
    return batch_progress(folded).filter((F.col("total") > 0) & (left > 0)).withColumn("remaining", left)


def retry_set(folded: DataFrame, inventory: DataFrame) -> DataFrame:
    """Failed files that still exist."""
    return failed_files(folded).join(inventory.select("path"), "path", "left_semi")
