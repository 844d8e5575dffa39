"""What one task holds or does stays bounded on larger tables."""

import random
import tracemalloc

from pyspark.sql import Row
from pyspark.sql import types as T

from floeworks.plans import adapters
from floeworks.plans import files as plans
from floeworks.sources import files
from floeworks.streaming import timers


def plan(df):
    return df._jdf.queryExecution().toString()


def test_sections_are_flattened_in_one_pass(spark):
    rows = spark.createDataFrame([(1, ((5,), 2), ["a", "b"]), (2, ((6,), None), []), (3, None, None)], "id int, m struct<t:struct<ms:int>,n:int>, tags array<string>")
    out = files.flatten_report(rows, ["m", "tags"], ["id"])
    assert "Union" not in plan(out)
    want = [(1, "m", "n", "2"), (1, "m", "t.ms", "5"), (1, "tags", "[0]", "a"), (1, "tags", "[1]", "b"), (2, "m", "n", None), (2, "m", "t.ms", "6"), (2, "tags", "", "[]"), (3, "m", "n", None), (3, "m", "t.ms", None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_orders_are_dealt_by_lines(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, adapters.adapt(spark, sf_dir, "bench").select("run_id", "mode", "replan_count").collect()))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(adapters, "LINES", 1000)
    out = adapters.adapt(spark, sf_dir, "bench").select("run_id", "mode", "replan_count")
    assert out.rdd.getNumPartitions() == -(-lines // 1000)
    assert sorted(map(tuple, out.collect())) == whole


def test_a_file_for_each_run(spark, sf_dir, tmp_path, monkeypatch):
    """Files lie in one folder, a text each, and more than one task has written them."""
    monkeypatch.setattr(plans, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    got = plans.records(spark, sf_dir).collect()
    names = [p.name for p in (tmp_path / "runs").iterdir()]
    assert len(names) > len(got) > 100 and sum(int(n.removesuffix(".txt")) % 10 != 0 for n in names) == len(got)
    broken = (tmp_path / "runs" / "10.txt").read_text()
    assert len(broken) == 12


def test_runs_are_read_once_with_a_schema(spark, tmp_path):
    texts = spark.createDataFrame([(f"{i}.json", f'{{"rows": [{{"run_id": {i}, "runtime_ms": {i}}}]}}') for i in range(20)], "name string, value string")
    files.write_texts(texts, f"file://{tmp_path}/b", 4)
    kind = T._parse_datatype_string("run_id long, runtime_ms double")
    out = files.read_bench(spark, f"file://{tmp_path}/b", kind)
    assert out.schema == kind
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, files.read_bench(spark, f"file://{tmp_path}/b").collect())) == [(i, float(i)) for i in range(20)]


def test_rows_of_a_key_wait_as_numbers():
    """Order is that of sorted(), over several portions, and memory a fraction of that of the rows."""
    rng = random.Random(3)
    data = [Row(source="s", ts=None, us=rng.randrange(5_000), event_id=None if i == 7 else rng.randrange(10**6), ok=rng.random() < 0.5, status=rng.choice(["a", None])) for i in range(40_000)]
    want = sorted(((r.us, -1 if r.event_id is None else r.event_id, r.ok, r.status, r.source) for r in data), key=lambda r: r[:2])
    got = [(r["us"], -1 if r["event_id"] is None else r["event_id"], r["ok"], r["status"], r["source"]) for r in timers.ordered(iter(data))]
    assert got == want and list(timers.ordered(iter([]))) == []
    tracemalloc.start()
    for _ in timers.ordered(Row(us=i, event_id=i, ok=True) for i in range(40_000)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000 * 150
