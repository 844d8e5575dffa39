"""Streams give what their batch twins give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from floeworks.functions.grid import Grid
from floeworks.operators import heatmap
from floeworks.streaming import state, timers

GRID = Grid(8, 8, 70.0, 80.0, 0.0, 10.0)


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_stream_heatmap(spark, tmp_path):
    rows = [(dt.datetime(2024, 7, 1) + dt.timedelta(hours=7 * i % 50), 70.0 + i % 10, i % 7 + 0.5) for i in range(60)]
    first, last = str(tmp_path / "in"), [(dt.datetime(2024, 9, 1), 75.0, 5.0)]
    ais = spark.createDataFrame(rows, "postime timestamp, lat double, lon double")
    ais.coalesce(1).write.parquet(first)
    spark.createDataFrame(last, ais.schema).coalesce(1).write.mode("append").parquet(first)
    stream = spark.readStream.schema(ais.schema).option("maxFilesPerTrigger", 1).parquet(first)
    run(state.stream_heatmap(stream, GRID, 12, 6, 72), "maps", "append")
    key = lambda df: sorted((str(r["center"]), r["row"], r["col"], r["n"]) for r in df.collect())
    want = heatmap.ais_heatmap_counts(ais, GRID, 12, 6)
    assert key(spark.table("maps").where(F.col("center") < "2024-08-01")) == key(want)


def test_stream_source_health(spark, tmp_path):
    rows = [(f"s{i % 3}", dt.datetime(2024, 7, 1) + dt.timedelta(minutes=i), i, (i * 7) % 5 == 0) for i in range(40)]
    events = spark.createDataFrame(rows, "source string, ts timestamp, event_id long, ok boolean")
    path = str(tmp_path / "in")
    events.where("event_id < 20").coalesce(1).write.parquet(path)
    events.where("event_id >= 20").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(state.stream_source_health(stream), "health", "update")
    last = {}
    for r in spark.table("health").collect():
        k = (r["last_failure_at"] or dt.datetime(1, 1, 1), r["last_success_at"] or dt.datetime(1, 1, 1))
        if r["source"] not in last or max(k) >= last[r["source"]][0]:
            last[r["source"]] = (max(k), r["failure_count"], r["last_success_at"])
    want = {r["source"]: (r["failure_count"], r["last_success_at"]) for r in state.source_health(events, F.lit("2024-07-02").cast("timestamp")).collect()}
    assert {s: v[1:] for s, v in last.items()} == want


def test_stream_latest(spark, tmp_path):
    rows = [(i % 4, dt.datetime(2024, 7, 1) + dt.timedelta(minutes=(i * 7) % 40), i, f"a{i}") for i in range(40)]
    events = spark.createDataFrame(rows, "run_id long, ts timestamp, event_id long, action string")
    path = str(tmp_path / "in")
    events.where("event_id < 20").coalesce(1).write.parquet(path)
    events.where("event_id >= 20").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = state.stream_latest(stream, "run_id", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r["run_id"]: r["action"] for r in spark.read.parquet(str(tmp_path / "out" / "1")).collect()}
    assert got == {k: max((t, i, a) for r, t, i, a in rows if r == k)[2] for k in range(4)}


def files_of(spark, rows, schema, path, parts):
    """rows in order as one file for each trigger."""
    df = spark.createDataFrame(rows, schema)
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


T0 = dt.datetime(2024, 7, 1)


@pytest.mark.parametrize("parts", [1, 4])
def test_circuits_close_by_timer(spark, tmp_path, rocksdb, parts):
    """However events are dealt to batches; the last circuit closes without an event, once other sources move the watermark on."""
    minutes = [("a", 0, False), ("b", 1, True), ("a", 2, False), ("a", 5, False), ("b", 30, False), ("a", 40, False), ("a", 45, True), ("b", 50, False), ("b", 55, True), ("a", 60, False), ("a", 61, False), ("b", 300, True)]
    rows = [(s, T0 + dt.timedelta(minutes=m), i, ok) for i, (s, m, ok) in enumerate(minutes)]
    stream = files_of(spark, rows, "source string, ts timestamp, event_id long, ok boolean", str(tmp_path / "in"), parts)
    run(timers.stream_circuits(stream, 2, 1200, 5), f"circuits{parts}", "append")
    got = sorted((r["source"], (r["at"] - T0).total_seconds() / 60, r["change"], r["failure_count"]) for r in spark.table(f"circuits{parts}").collect())
    assert got == sorted([("a", 2, "opened", 2), ("a", 25, "closed by time", 3), ("a", 40, "opened", 4), ("a", 45, "closed by success", 0), ("a", 61, "opened", 2), ("a", 81, "closed by time", 2), ("b", 50, "opened", 2), ("b", 55, "closed by success", 0)])


@pytest.mark.parametrize("parts", [1, 5])
def test_progress_expires(spark, tmp_path, rocksdb, parts):
    hours = [(1, 0, "running", -5), (2, 0, "running", 50), (1, 1, "completed", 3), (2, 3, "failed", 0), (1, 9, "running", 200), (3, 10, "running", 7), (3, 30, "running", 8)]
    rows = [(p, T0 + dt.timedelta(hours=h), i, s, n) for i, (p, h, s, n) in enumerate(hours)]
    stream = files_of(spark, rows, "progress_id long, ts timestamp, event_id long, status string, percent int", str(tmp_path / "in"), parts)
    run(timers.stream_progress(stream, 6, 30), f"progress{parts}", "append")
    got = timers.last_progress(spark.table(f"progress{parts}")).collect()
    at = lambda t: (t - T0).total_seconds() / 3600
    assert sorted((r["progress_id"], at(r["created_at"]), at(r["updated_at"]), r["status"], r["percent"], r["expired"]) for r in got) == [
        (1, 0, 1, "completed", 100, True), (1, 9, 9, "running", 100, True), (2, 0, 3, "failed", 1, True), (3, 10, 10, "running", 7, True), (3, 30, 30, "running", 8, False),
    ]


@pytest.mark.parametrize("parts", [1, 3])
def test_runs_end_by_hard_delete(spark, tmp_path, rocksdb, parts):
    actions = ["create", "delete", "purge", "restore", "touch", "purge", "restore", "create"]
    rows = [(n, T0 + dt.timedelta(minutes=i), 10 * i + n, a) for i, a in enumerate(actions) for n in range(1, 9) if i < n]
    schema = "run_id long, ts timestamp, event_id long, action string"
    stream = files_of(spark, rows, schema, str(tmp_path / "in"), parts)
    run(timers.stream_lifecycle(stream, 5), f"runs{parts}", "append")
    last = {}
    for r in spark.table(f"runs{parts}").collect():
        last[r["run_id"]] = max(last.get(r["run_id"], (T0, 0, "")), (r["since"], r["event_id"], r["state"]))
    want = {r["run_id"]: (r["since"], r["state"]) for r in state.run_states(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (v[0], v[2]) for k, v in last.items()} == want
