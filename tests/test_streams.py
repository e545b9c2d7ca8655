"""Streams against their batch twins."""

import json
import os
import random

import pandas as pd

from pyspark.sql import functions as F

from reportloom.operators import normalise, status
from reportloom.sources import store
from reportloom.streaming import streams


def feed(spark, folder, batches, schema):
    """Stream over JSON files, one file per micro-batch."""
    for i, rows in enumerate(batches):
        file = folder / f"{i:03d}.json"
        if not file.exists():  # batches follow the times of their files
            file.write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_job_states(spark, tmp_path):
    schema = "job_id string, event_id bigint, status string, cost_sek double, ts timestamp"
    events = [
        [{"job_id": "a", "event_id": 1, "status": "extracting", "ts": "2024-01-01T00:00:01Z"},
         {"job_id": "b", "event_id": 2, "status": "pass_1", "cost_sek": 1.5, "ts": "2024-01-01T00:00:02Z"}],
        [{"job_id": "a", "event_id": 4, "status": "paus", "ts": "2024-01-01T00:00:04Z"},
         {"job_id": "a", "event_id": 3, "status": "pass_2_3", "cost_sek": 2.0, "ts": "2024-01-01T00:00:03Z"}],
        [{"job_id": "b", "event_id": 5, "status": "done", "ts": "2024-01-01T00:00:05Z"}],
    ]
    source = tmp_path / "in"
    source.mkdir()
    stream = feed(spark, source, events, schema)
    finish(streams.job_states(stream).writeStream.format("memory").queryName("jobs").outputMode("update")
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    last = spark.table("jobs").groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "cost_sek"), "updated_at").alias("s"))
    got = {r["job_id"]: tuple(r["s"]) for r in last.collect()}
    batch = status.latest_job_state(spark.read.schema(schema).json(str(source)))
    want = {r["job_id"]: (r["status"], r["progress"], r["cost_sek"]) for r in batch.collect()}
    assert got == want == {"a": ("paus", 50, 2.0), "b": ("done", 100, 1.5)}


def test_vector_counts_and_logs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [[{"period_id": 1, "embedding": [1.0]}, {"period_id": 1}], [{"period_id": 1, "embedding": [2.0]}, {"period_id": 2}]]
    stream = feed(spark, source, rows, "period_id int, embedding array<float>")
    finish(streams.vector_counts(stream).writeStream.format("memory").queryName("counts").outputMode("update")
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    newest = spark.table("counts").groupBy("period_id").agg(F.max("embeddings_count").alias("n"))
    assert {tuple(r) for r in newest.collect()} == {(1, 2), (2, 0)}

    logs = tmp_path / "logs"
    logs.mkdir()
    lines = [[{"log_level": "DEBUG", "message": "x"}, {"log_level": "INFO", "message": "y" * 3000}]]
    finish(streams.append_logs(feed(spark, logs, lines, "log_level string, message string"), str(tmp_path / "out"), str(tmp_path / "cp2")))
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(row["message"]) == 2000


def test_new_files_once(spark, tmp_path):
    source = tmp_path / "in" / "acme"
    source.mkdir(parents=True)
    text = "Delårsrapport, nettoomsättning och styrelsen"
    (source / "Acme 2024 Q3.txt").write_text(text)
    target = str(tmp_path / "plan")

    def run(checkpoint="cp"):
        finish(streams.plan_new_files(streams.new_files(spark, str(tmp_path / "in")), target, str(tmp_path / checkpoint)))

    run("lost")
    run()  # the first batch again
    assert spark.read.parquet(target).count() == 1
    (source / "okänd.txt").write_text("1: 2")
    run()
    run()
    rows = {r["name"]: (r["action"], r["new_name"]) for r in spark.read.parquet(target).collect()}
    assert spark.read.parquet(target).count() == 2
    assert rows["Acme 2024 Q3.txt"] == ("rename", "acme-2024-q3-sv.pdf")
    (source / "Acme Q3 2024.txt").write_text(text)
    run()
    rows = {r["name"]: (r["action"], r["new_name"]) for r in spark.read.parquet(target).collect()}
    assert len(rows) == 3 and rows["Acme Q3 2024.txt"] == ("collision", "acme-2024-q3-sv.pdf")


def test_plan_of_many_batches_matches_the_batch_twin(spark, tmp_path):
    """Every micro-batch against ``file_plan`` with all earlier names as taken; no earlier plan is read."""
    draw = random.Random(6)
    text = "Delårsrapport, nettoomsättning och styrelsen"
    names = [f"{c}{sep}{y}{sep}Q{q}.txt" for c in ("Acme", "Bolaget") for y in (2023, 2024) for q in (1, 2) for sep in (" ", "_", "-")]
    names += ["acme-2023-q1-sv.pdf", "okänd.txt", "acme-2024-q2-sv.pdf"]
    draw.shuffle(names)
    rows = [[{"folder": draw.choice("ab"), "name": n, "text": text if n != "okänd.txt" else "1: 2"} for n in names[i : i + 4]] for i in range(0, len(names), 4)]
    source = tmp_path / "in"
    source.mkdir()
    schema = "folder string, name string, text string"
    target = str(tmp_path / "plan")
    for part in range(1, len(rows) + 1):  # the stream ends and starts again after every batch
        finish(streams.plan_new_files(feed(spark, source, rows[:part], schema), target, str(tmp_path / "cp")))
    got = spark.read.parquet(target)
    assert set(got.columns) == {"folder", "new_name", "name", "canonical", "company", "quarter", "year", "language", "action", "batch"}
    taken, want = [], []
    for number, batch in enumerate(rows):
        others = spark.createDataFrame(taken, "folder string, name string") if taken else None
        plan = normalise.file_plan(spark.createDataFrame([tuple(r.values()) for r in batch], schema), others).collect()
        want += [(r["folder"], r["name"], r["new_name"], r["action"], number) for r in plan]
        taken += [(r["folder"], r["name"]) for r in batch] + [(r["folder"], r["new_name"]) for r in plan if r["action"] == "rename"]
    have = [(r["folder"], r["name"], r["new_name"], r["action"], r["batch"]) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert {"keep", "rename", "collision", "failed"} <= {h[3] for h in have}


def test_many_files_that_want_one_name():
    """Frames of one key pass through; only a file that may be alone is held."""
    class State:
        exists, value = False, None

        def update(self, value):
            self.value = value

    def frame(*marks):
        rows = [(f"n{i}", there, "keep" if there else None) for i, there in enumerate(marks)]
        df = pd.DataFrame(rows, columns=["name", "is_there", "action"])
        return df.assign(folder="a", new_name="x", canonical=False, company="c", quarter=1, year=2024, language="sv")

    def actions(frames, exists=False):
        state = State()
        state.exists = exists
        out = pd.concat(list(streams._decide_name(("a", "x"), iter(frames), state)))
        return sorted(out["action"]), state.value

    assert actions([frame(False)]) == (["rename"], (True,))
    assert actions([frame(False)], exists=True) == (["collision"], None)
    assert actions([frame(False), frame(False, False)]) == (["collision"] * 3, None)
    assert actions([frame(False), frame(True)]) == (["collision", "keep"], (True,))


JOBS = "job_id string, event_id bigint, status string, cost_sek double, ts timestamp"


def at(minutes):
    return f"2024-01-01T{minutes // 60:02d}:{minutes % 60:02d}:00Z"


def test_finished_jobs_leave(spark, tmp_path):
    """A hundred jobs that end keep no state; one that stays open does; what comes after is defined."""
    events, number = [], 0
    for wave in range(10):
        batch = [{"job_id": "open", "event_id": 10_000 + wave, "status": "paus" if wave else "pass_1", "ts": at(wave * 30)}]
        for job in range(10):
            number += 1
            batch += [
                {"job_id": f"{wave}-{job}", "event_id": number * 2 + 1, "status": "done" if job % 2 else "failed", "ts": at(wave * 30 + 2)},
                {"job_id": f"{wave}-{job}", "event_id": number * 2, "status": "pass_2_3", "cost_sek": 1.5, "ts": at(wave * 30 + 1)},
            ]
        events.append(batch)
    events.append([{"job_id": "0-1", "event_id": 1, "status": "done", "ts": at(1)}, {"job_id": "open", "event_id": 20_000, "status": "paus", "ts": at(400)}])
    events.append([{"job_id": "0-3", "event_id": 30_000, "status": "validating", "ts": at(401)}])
    events.append([{"job_id": "open", "event_id": 40_000, "status": "paus", "ts": at(402)}])
    source = tmp_path / "in"
    source.mkdir()
    stream = streams.open_job_states(feed(spark, source, events, JOBS), "1 minute", keep_seconds=600)
    query = finish(stream.writeStream.format("memory").queryName("leaving").outputMode("update")
                   .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    rows = spark.table("leaving").collect()
    finals = {r["job_id"]: (r["status"], r["progress"], r["cost_sek"]) for r in rows if r["final"]}
    assert len(finals) == 100 and finals["0-1"] == ("done", 100, 1.5) and finals["9-2"] == ("failed", 50, 1.5)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 35
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2
    # An event behind the watermark is dropped, one ahead of it starts a job that has left anew.
    assert [r["status"] for r in rows if r["job_id"] == "0-1" and not r["final"]] == ["done"]
    assert [(r["status"], r["progress"], r["cost_sek"]) for r in rows if r["job_id"] == "0-3"][-1] == ("validating", 80, None)
    newest = {r["job_id"]: r for r in rows if not r["final"]}
    assert (newest["open"]["status"], newest["open"]["progress"]) == ("paus", 25)


def test_open_jobs_equal_the_batch_twin(spark, tmp_path):
    draw = random.Random(8)
    statuses = ["extracting", "pass_1", "paus", "validating", "done", "failed", None]
    rows = [{"job_id": f"j{draw.randint(0, 9)}", "event_id": i, "status": draw.choice(statuses), "ts": at(draw.randint(0, 9)),
             **({"cost_sek": draw.random()} if draw.random() < 0.5 else {})} for i in range(300)]
    source = tmp_path / "in"
    source.mkdir()
    stream = streams.open_job_states(feed(spark, source, [rows[i::5] for i in range(5)], JOBS))
    finish(stream.writeStream.format("memory").queryName("twins").outputMode("update")
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    last = {}
    for r in spark.table("twins").collect():  # batches come in order
        last[r["job_id"]] = (r["status"], r["progress"], r["cost_sek"], r["updated_at"])
    batch = status.latest_job_state(spark.read.schema(JOBS).json(str(source)))
    assert last == {r["job_id"]: (r["status"], r["progress"], r["cost_sek"], r["updated_at"]) for r in batch.collect()}


def test_hot_second_of_requests(spark):
    """A third of all requests in one second, many of them at one microsecond; a key without a name."""
    draw = random.Random(2)
    times = [1_000_000 * 60 + draw.choice([0, 0, 7, draw.randint(0, 999_999)]) for _ in range(400)]
    times += [draw.randint(0, 200_000_000) for _ in range(300)] + [0, 60_000_000, 60_000_001, 119_999_999, 120_000_000]
    rows = [(draw.choice(["k", "k", "k", "other", None]), i, t) for i, t in enumerate(times)]
    table = spark.createDataFrame(rows, "key string, event_id bigint, m bigint").select("key", "event_id", F.timestamp_micros("m").alias("ts"))
    got = {r["event_id"]: (r["in_window"], r["at_limit"]) for r in streams.requests_in_window(table, limit=50).collect()}
    assert len(got) == len(rows)
    for key, event, t in rows:
        count = sum(k == key and t - 60_000_000 < u <= t for k, _, u in rows)
        assert got[event] == (count, count >= 50)


def stored_periods(spark, root):
    rows = [(f"p{i}", "c", 1 + i % 4, 2020 + i // 4, i) for i in range(12)]
    periods = spark.createDataFrame(rows, "id string, company_id string, quarter int, year int, embeddings_count int")
    store.replace_periods(spark, root, periods, {})


def counted(spark, root):
    return {r["id"]: r["embeddings_count"] for r in spark.read.parquet(f"{root}/periods").collect()}


def test_vector_counts_are_added_once(spark, tmp_path):
    root = str(tmp_path / "root")
    stored_periods(spark, root)
    source = tmp_path / "in"
    source.mkdir()

    def vectors(*pairs):
        return [{"id": i, "period_id": p, **({"embedding": [1.0]} if v else {})} for i, p, v in pairs]

    batches = [
        vectors((1, "p0", True), (2, "p0", False), (3, "p1", True), (1, "p0", True)),
        vectors((2, "p0", True), (1, "p0", True), (4, "p1", True), (9, "unknown", True)),  # a late vector, and one sent again
        vectors((5, "p11", True), (6, "p11", True)),
    ]
    schema = "id bigint, period_id string, embedding array<float>"
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "root" / "periods" / "year=2021").rglob("*.parquet")}
    for part in (1, 2, 3, 3):  # ends and starts again; the last run has nothing to do
        finish(streams.count_new_vectors(feed(spark, source, batches[:part], schema), root, str(tmp_path / "cp")))
    want = {f"p{i}": i for i in range(12)} | {"p0": 2, "p1": 3, "p11": 13}
    assert counted(spark, root) == want
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "root" / "periods" / "year=2021").rglob("*.parquet")}


def test_a_batch_of_counts_that_runs_again(spark, tmp_path):
    root = str(tmp_path / "root")
    more = spark.createDataFrame([("p2", 5), ("p7", 1)], "period_id string, embeddings_count bigint")
    store.add_vector_counts(spark, root, more, "s", 0)  # nothing is stored yet
    stored_periods(spark, root)
    for number, stream in ((0, "s"), (0, "s"), (0, "other"), (1, "s"), (0, "s")):
        store.add_vector_counts(spark, root, more, stream, number)
    assert counted(spark, root) == {f"p{i}": i for i in range(12)} | {"p2": 17, "p7": 10}
    # Only one of two partitions was published before the end of a run.
    store.add_vector_counts(spark, root, more.filter("period_id = 'p2'"), "s", 2)
    store.add_vector_counts(spark, root, more, "s", 2)
    assert counted(spark, root) == {f"p{i}": i for i in range(12)} | {"p2": 22, "p7": 11}
    # A period that comes again starts its count anew but knows its batches.
    again = spark.createDataFrame([("p2", "c", 3, 2020, 0)], "id string, company_id string, quarter int, year int, embeddings_count int")
    store.replace_periods(spark, root, again, {})
    store.add_vector_counts(spark, root, more, "s", 2)
    assert counted(spark, root)["p2"] == 0 and counted(spark, root)["p7"] == 11
    assert sorted(tuple(sorted(r["vector_batches"].items())) for r in spark.read.parquet(f"{root}/periods").filter("vector_batches is not null").collect()) == [
        (("other", 0), ("s", 2)), (("other", 0), ("s", 2))]


def test_duplicates_and_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [[{"path": "a", "key": "k", "ts": "2024-01-01T00:00:01Z"}], [{"path": "a", "key": "k", "ts": "2024-01-01T00:00:02Z"}],
            [{"path": "b", "key": "k", "ts": "2024-01-01T00:10:00Z"}]]
    stream = feed(spark, source, rows, "path string, key string, ts timestamp")
    finish(streams.first_file_events(stream).writeStream.format("memory").queryName("firsts")
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert sorted(r["path"] for r in spark.table("firsts").collect()) == ["a", "b"]
    finish(streams.request_windows(stream).writeStream.format("memory").queryName("windows").outputMode("append")
           .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    assert spark.table("windows").agg(F.max("requests")).first()[0] == 2
