"""Streams: new files, job state, logs, request windows, vector counts.

Each has the same meaning as its batch twin in ``operators``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from reportloom.operators.normalise import named_files
from reportloom.operators.status import latest_job_state
from reportloom.sources.store import add_vector_counts
from reportloom.vocabulary import JOB_PROGRESS, REQUEST_LIMIT, REQUEST_WINDOW_SECONDS


def new_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Text of files as they appear below ``path``, each path once (folder, name, text)."""
    # The path comes percent-encoded; a plus sign in it is a plus sign.
    path_text = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    files = (
        spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path)
        .select(F.col("value").alias("text"), path_text.alias("path"))
    )
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "text")


_PLAN = ["folder", "new_name", "name", "canonical", "company", "quarter", "year", "language"]


def planned_files(files: DataFrame) -> DataFrame:
    """Rename plan of a stream of new files (folder, name, text), as ``file_plan`` gives it for each micro-batch.

    The names that files have or are planned to get are keyed state, one flag for a folder and name: a batch meets the
    flags of its own names only, however many files came before. Files that want one name are decided as they pass.
    """
    named = named_files(files)
    there = F.struct(F.lit(True).alias("is_there"), F.col("name").alias("at"), F.col("settled").alias("action"))
    wish = F.struct(F.lit(False).alias("is_there"), F.col("new_name").alias("at"), F.lit(None).cast("string").alias("action"))
    events = F.when(F.col("settled").isNotNull(), F.array(there)).otherwise(F.array(there, wish))
    keyed = named.select(*_PLAN, F.explode(events).alias("e")).select(*_PLAN, "e.*")
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in _PLAN) + ", action string"
    return keyed.groupBy("folder", "at").applyInPandasWithState(_decide_name, schema, "taken boolean", "append", "NoTimeout")


def _decide_name(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Files that have a name or want it. Only one file that may be alone with its wish is held back."""
    taken, several, held = state.exists, False, None
    for frame in frames:
        there = frame["is_there"].astype(bool)
        taken = taken or bool(there.any())
        yield frame[there & frame["action"].notna()][[*_PLAN, "action"]]
        wishes = frame[~there]
        several = several or len(wishes) + (held is not None) > 1
        if len(wishes) and (several or taken):
            yield wishes.assign(action="collision")[[*_PLAN, "action"]]
        elif len(wishes):
            held = wishes
    if held is not None:
        alone = not several and not taken
        yield held.assign(action="rename" if alone else "collision")[[*_PLAN, "action"]]
        taken = taken or alone
    if taken and not state.exists:
        state.update((True,))


def plan_new_files(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Rename plan of every micro-batch of new files, each in its own partition ``batch`` of ``target``.

    A batch that runs again overwrites its own partition, so the plan holds every file once.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    planned = planned_files(files).writeStream.foreachBatch(store).outputMode("append")
    return planned.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_file_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """File events without repeats of a path within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path"])


def job_states(events: DataFrame) -> DataFrame:
    """Current state of each job whenever it changes, in update mode (events: job_id, event_id, status, cost_sek, ts).

    The fold of the batch twin as a streaming aggregate, so the order of events does not matter.
    """
    return latest_job_state(events)


_FINISHED = ("done", "failed")
_JOB = "status string, progress int, cost_sek double"
_JOB_STATE = _JOB + ", at bigint, event bigint, progress_at bigint, progress_event bigint, cost_at bigint, cost_event bigint"


def open_job_states(
    events: DataFrame, delay: str = "10 minutes", keep_seconds: int = 3600, idle_seconds: int = 7 * 86400
) -> DataFrame:
    """``job_states`` whose state ends: job_id, status, progress, cost_sek, updated_at, ``final``.

    A job leaves ``keep_seconds`` after its last event once that says done or failed, and ``idle_seconds`` after it
    otherwise, by the watermark (``delay`` behind the latest event). It leaves with a last row that is ``final``. Events
    older than the watermark are dropped; a later event of a job that left starts it anew, with what that event says.
    """
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = list(state.get) if state.exists else [None, 0, None, -1, -1, -1, -1, -1, -1]
        if state.hasTimedOut:
            state.remove()
            yield _job_row(key[0], job, True)
            return
        for frame in frames:
            for status, cost, at, event in zip(frame["status"], frame["cost_sek"], frame["at"], frame["event_id"]):
                order, known = (int(at), int(event)), JOB_PROGRESS.get(status)
                if order > (job[3], job[4]):
                    job[0], job[3:5] = status, order
                if known is not None and order > (job[5], job[6]):
                    job[1], job[5:7] = known, order
                if cost == cost and cost is not None and order > (job[7], job[8]):
                    job[2], job[7:9] = float(cost), order
        state.update(tuple(job))
        stays = keep_seconds if job[0] in _FINISHED else idle_seconds
        state.setTimeoutTimestamp(max(job[3] // 1000 + stays * 1000, state.getCurrentWatermarkMs() + 1))
        yield _job_row(key[0], job, False)

    job_type = events.schema["job_id"].dataType.simpleString()
    rows = events.withWatermark("ts", delay).select(
        "job_id", "ts", "event_id", "status", F.col("cost_sek").cast("double").alias("cost_sek"), F.unix_micros("ts").alias("at")
    )
    states = rows.groupBy("job_id").applyInPandasWithState(
        fold, f"job_id {job_type}, {_JOB}, at bigint, final boolean", _JOB_STATE, "update", "EventTimeTimeout"
    )
    return states.select("job_id", "status", "progress", "cost_sek", F.timestamp_micros("at").alias("updated_at"), "final")


def _job_row(job_id: object, job: list, final: bool) -> pd.DataFrame:
    return pd.DataFrame({"job_id": [job_id], "status": [job[0]], "progress": [job[1]], "cost_sek": [job[2]], "at": [job[3]], "final": [final]})


def log_rows(logs: DataFrame, limit: int = 2000) -> DataFrame:
    """Log rows as stored: no debug rows, messages cut. Works on streams and tables."""
    kept = logs.filter(F.upper("log_level") != "DEBUG")
    return kept.withColumn("message", F.substring("message", 1, limit))


def append_logs(logs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        log_rows(logs).writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def requests_in_window(
    requests: DataFrame, limit: int = REQUEST_LIMIT, seconds: int = REQUEST_WINDOW_SECONDS
) -> DataFrame:
    """Requests of the last ``seconds`` per key at every request (key, event_id, ts), and whether that is the limit.

    A request exactly ``seconds`` old is out. Requests of a key at the same microsecond are counted first, before any
    shuffle, and only these counts are ordered: time is cut into stretches of that length, each count is also given to the
    next stretch, and the sums are joined to the requests by key and time. However hot a key, a task orders no more
    counts than two stretches have microseconds.
    """
    micros = F.unix_micros("ts")
    span = seconds * 1_000_000
    timed = requests.select("key", "event_id", "ts", micros.alias("_m"))
    counts = timed.groupBy("key", "_m").agg(F.count("*").alias("_n")).withColumn("_own", F.floor(F.col("_m") / span).cast("bigint"))
    spread = counts.select("*", F.explode(F.array(F.col("_own"), F.col("_own") + 1)).alias("_stretch"))
    recent = Window.partitionBy("key", "_stretch").orderBy("_m").rangeBetween(-span + 1, Window.currentRow)
    counted = spread.withColumn("in_window", F.sum("_n").over(recent)).filter("_stretch = _own").select("key", "_m", "in_window")
    # A key without a name counts as one.
    joined = timed.join(
        counted.withColumnsRenamed({"key": "_key", "_m": "_at"}), F.col("key").eqNullSafe(F.col("_key")) & (F.col("_m") == F.col("_at"))
    )
    return joined.select("key", "event_id", "ts", "in_window", (F.col("in_window") >= limit).alias("at_limit"))


def request_windows(requests: DataFrame, delay: str = "1 minute", seconds: int = REQUEST_WINDOW_SECONDS) -> DataFrame:
    """Requests per key in sliding windows, for streams."""
    window = F.window("ts", f"{seconds} seconds", "10 seconds")
    return requests.withWatermark("ts", delay).groupBy("key", window.alias("w")).agg(F.count("*").alias("requests")).select(
        "key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests"
    )


def vector_counts(sections: DataFrame) -> DataFrame:
    """Sections with a vector per period; in update mode only changed periods are sent."""
    return sections.groupBy("period_id").agg(F.count("embedding").alias("embeddings_count"))


def count_new_vectors(sections: DataFrame, root: str, checkpoint: str, stream: str = "sections") -> StreamingQuery:
    """Adds the vectors of a stream of sections (id, period_id, embedding) to ``embeddings_count`` of the stored periods.

    A section counts once, when its vector first arrives, however late and however often it is sent again. A batch that
    runs again changes nothing: every period remembers the last batch of each ``stream`` that it has counted.
    """
    new = sections.filter(F.col("embedding").isNotNull()).select("id", "period_id").dropDuplicates(["id"])

    def add(batch: DataFrame, number: int) -> None:
        add_vector_counts(batch.sparkSession, root, vector_counts(batch.withColumn("embedding", F.lit(1))), stream, number)

    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
