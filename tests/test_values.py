"""Exact values on tiny tables."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from floeworks.functions.grid import Grid, to_cell, wrap_longitude
from floeworks.functions.scalars import normalize_timestamp, root_cause_tags
from floeworks.operators import bench, catalog, heatmap, labels, raster, routes
from floeworks.sources import files, rasters
from floeworks.streaming import state


def hours(spark, *hs):
    return spark.createDataFrame([(dt.datetime(2024, 7, 1, h),) for h in hs], "ts timestamp")


def test_to_cell(spark):
    g = Grid(10, 20, 60.0, 80.0, 0.0, 40.0)
    row, col = to_cell(F.col("lat"), F.col("lon"), g)
    got = spark.createDataFrame([(70.0, 20.0), (59.9, 20.0), (70.0, 40.1), (60.0, 40.0), (80.0, 0.0)], "lat double, lon double").select(row, col).collect()
    assert [tuple(r) for r in got] == [(5, 10), (None, None), (None, None), (9, 19), (0, 0)]


def test_month_axis(spark):
    c = heatmap.centers(spark, ["202407"], 6)
    assert c.count() == 124 and c.agg(F.max("center")).first()[0] == dt.datetime(2024, 7, 31, 18)


@pytest.mark.parametrize("step", [6, 5])
def test_heatmap_window_is_half_open(spark, step):
    rows = [(dt.datetime(2024, 7, 1, h), 75.0, 1.0) for h in (12, 0, 6)]
    ais = spark.createDataFrame(rows, "postime timestamp, lat double, lon double")
    got = {r["center"]: r["n"] for r in heatmap.ais_heatmap_counts(ais, Grid(8, 8, 70.0, 80.0, 0.0, 10.0), 10 if step == 5 else 12, step).collect()}
    if step == 6:
        assert got[dt.datetime(2024, 7, 1, 6)] == 1 and got[dt.datetime(2024, 7, 1, 12)] == 2 and got[dt.datetime(2024, 7, 1, 18)] == 2
    assert max(got.values()) == 2


def test_timestamp_index(spark):
    r = catalog.timestamp_index(hours(spark, 0, 1, 3), 1).first()
    assert (r["expected_count"], r["available_count"], r["coverage"], r["status"]) == (4, 3, 0.75, "warn")
    axis = catalog.expected_axis(hours(spark, 0, 6), 3)
    assert axis.count() == 3
    gap = catalog.gap_segments(catalog.missing_timestamps(catalog.expected_axis(hours(spark, 0, 1, 3), 1), hours(spark, 0, 1, 3))).first()
    assert gap["first"] == gap["last"] == dt.datetime(2024, 7, 1, 2) and gap["missing_count"] == 1
    assert catalog.timestamp_index(hours(spark), 1).count() == 1


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "2"), ("c", "1")], "path string, hash string")
    assert {r["path"]: r["change"] for r in catalog.manifest_diff(old, new).collect()} == {"a": "changed", "b": "removed", "c": "added"}


def test_risk_constraints(spark):
    df = lambda v: spark.createDataFrame([(1, x) for x in v], "route_id long, risk double")
    a = routes.risk_constraint(df([0.95, 0.2, 0.91, 0.1]), "chance", 0.4, 0.9).first()
    assert (a["metric"], round(a["usage"], 6), a["tail_count"], a["satisfied"]) == (0.5, 1.25, 2, False)
    b = routes.risk_constraint(df([0.1, 0.2, 0.8, 0.9, 1.0]), "cvar", 0.9, 0.6).first()
    assert (round(b["metric"], 6), b["tail_count"], b["satisfied"]) == (0.95, 2, False)
    with pytest.raises(ValueError):
        routes.risk_constraint(df([0.1]), "other", 1.0, 0.9)


def test_risk_stages(spark):
    rows = [(1, 0, 0.9), (1, 1, 0.4), (1, 2, 0.0)]
    got = state.risk_budget_modes(spark.createDataFrame(rows, "sequence_id long, step_index int, risk_extra_km double"), 1.0).orderBy("step_index").collect()
    assert [(r["stage"], r["mode"]) for r in got] == [("normal", "balanced"), ("warn", "conservative"), ("hard", "aggressive")]


def test_sampling(spark):
    cells = spark.createDataFrame([(1, r, c, v) for r, c, v in ((0, 0, 0.0), (0, 1, 10.0), (1, 0, 20.0), (1, 1, 30.0))], "sample_id long, row int, col int, v double")
    t = spark.createDataFrame([(1, 1, 0.5, 0.5)], "sample_id long, target_id int, y double, x double")
    assert raster.resample(cells, t, "v").first()["value"] == 15.0
    n = spark.createDataFrame([(1, 1, 0.1, 0.9)], "sample_id long, target_id int, y double, x double")
    assert raster.resample(cells, n, "v", "nearest").first()["value"] == 10.0
    hole = cells.withColumn("v", F.when(F.col("v") == 30, float("nan")).otherwise(F.col("v")))
    assert raster.resample(hole, t, "v").first()["value"] == 10.0


def test_majority_smooth(spark):
    on = {(0, 0), (3, 3), (3, 4)}
    cells = spark.createDataFrame([(1, r, c, int((r, c) in on)) for r in range(6) for c in range(6)], "sample_id long, row int, col int, m int")
    got = {(r["row"], r["col"]) for r in raster.majority_smooth(cells, "m", 2).where("smooth = 1").collect()}
    assert got == {(3, 3), (3, 4)}


def test_anchor_window(spark):
    ts = spark.createDataFrame([(dt.datetime(2024, 7, 1, 0) + dt.timedelta(hours=6 * i),) for i in range(5)], "ts timestamp")
    got = sorted(r["ts"] for r in catalog.anchor_window(ts, F.lit("2024-07-01 12:00:00").cast("timestamp"), 4).collect())
    assert got == [dt.datetime(2024, 7, 1, 6), dt.datetime(2024, 7, 1, 12), dt.datetime(2024, 7, 1, 18), dt.datetime(2024, 7, 2, 0)]


def runs(spark, *rows):
    return spark.createDataFrame([("dynamic", "a", "ok", *map(float, r), 0) for r in rows], "mode string, planner string, status string, runtime_ms double, distance_km double, caution_len_km double, risk_exposure double, route_cost_effective_km double, replan_count int")


def test_regression(spark):
    base = bench.bench_summary(runs(spark, (100, 100, 0, 1, 1)))
    worse = bench.regression_check(bench.bench_summary(runs(spark, (160, 120, 0, 1.5, 1))), base)
    assert {r["metric"] for r in worse.where("violation").collect()} == {"avg_runtime_ms", "avg_distance_km", "avg_risk_exposure"}
    assert not bench.regression_check(bench.bench_summary(runs(spark, (105, 101, 0, 1.01, 1))), base).where("violation").count()


def test_tags(spark):
    row = spark.range(1).select(root_cause_tags(F.lit("risk budget threshold exceeded near boundary"), F.lit(1.2), F.lit(False), F.lit(0.3), F.lit(True)).alias("t")).first()
    assert row["t"] == ["threshold", "boundary", "model_uncertainty", "planner_degradation"]


def test_circuit(spark):
    events = lambda *oks: spark.createDataFrame([("s", dt.datetime(2024, 7, 1, 0, 0, i), i, ok) for i, ok in enumerate(oks)], "source string, ts timestamp, event_id long, ok boolean")
    at = F.lit("2024-07-01 00:00:05").cast("timestamp")
    got = lambda *oks: state.source_health(events(*oks), at, 2, 10).first()
    assert not got(False)["circuit_open"]
    opened = got(False, False)
    assert opened["circuit_open"] and opened["failure_count"] == 2 and opened["retry_after_sec"] == 6
    assert (got(False, False, True)["failure_count"], got(False, False, True)["circuit_open"]) == (0, False)
    late = state.source_health(events(False, False), F.lit("2024-07-01 01:00:00").cast("timestamp"), 2, 10).first()
    assert (late["failure_count"], late["circuit_open"]) == (2, False)


def test_calibration_improves(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0.01, 0.99, 2000)
    y = (rng.uniform(size=2000) < 0.5 + (p - 0.5) * 0.4).astype(int)
    pairs = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "confidence double, outcome int")
    t = labels.fit_temperature(pairs).first()["temperature"]
    assert t > 1
    after = pairs.withColumn("confidence", labels.calibrate(F.col("confidence"), t))
    a, b = labels.calibration_metrics(pairs).first(), labels.calibration_metrics(after).first()
    assert b["brier"] <= a["brier"] and b["ece"] <= a["ece"]
    w = labels.uncertainty_thresholds(pairs.withColumn("uncertainty", 1 - F.col("confidence")), (0.1, 0.3, 0.5)).orderBy("target").collect()
    assert [r["coverage"] for r in w] == sorted(r["coverage"] for r in w)


def test_weights_sum_to_one(spark):
    scores = spark.createDataFrame([(i, i / 10) for i in range(10)], "sample_id long, score double")
    for target, cap, share in ((0.0, 0.8, None), (0.5, 0.8, 0.5), (0.9, 0.6, 0.6)):
        w = labels.hard_sample_weights(scores, target=target, cap=cap)
        assert abs(w.agg(F.sum("weight")).first()[0] - 1) < 1e-9
        if share:
            assert abs(w.where("hard").agg(F.sum("weight")).first()[0] - share) < 1e-9


def test_trace_covers_corners(spark):
    got = routes.trace_cells(spark.createDataFrame([(0, 0, 2, 2)], "r0 int, c0 int, r1 int, c1 int")).collect()
    assert {(r["row"], r["col"]) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)}
    one = routes.trace_cells(spark.createDataFrame([(3, 4, 3, 4)], "r0 int, c0 int, r1 int, c1 int")).collect()
    assert [(r["row"], r["col"]) for r in one] == [(3, 4)]


def test_sums_of_a_segment_keep_their_order(spark):
    """Cells reach a segment in the order of one join or another; its sums are those from its last cell to its first."""
    rng = np.random.default_rng(4)
    cells = [(r, c, *map(float, rng.integers(0, 100, 5) / 100)) for r in range(8) for c in range(8)]
    names = ("row", "col", "caution", "near_blocked", "corridor", "uncertainty", "risk")
    segments = {k: [cells[i] for i in rng.choice(64, 25, replace=False)] for k in range(40)}
    want = {}
    for k, found in segments.items():
        sums = [0.0] * 5
        for cell in sorted(found, reverse=True):
            sums = [a + b for a, b in zip(sums, cell[2:], strict=True)]
        want[k] = (25, *(s / 25 for s in sums))
    for backwards in (False, True):
        rows = [("r", k, 1.0, *cell) for k, found in segments.items() for cell in sorted(found, reverse=backwards)]
        looked = spark.createDataFrame(rows, "route_id string, seq int, km double, " + ", ".join(f"{n} {'int' if n in ('row', 'col') else 'double'}" for n in names))
        got = routes._by_segment(looked, 0.22, 0.02).select("seq", "samples", *names[2:]).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want


def test_pareto(spark):
    rows = [("q", 1, 1.0, 5.0), ("q", 2, 2.0, 4.0), ("q", 3, 2.0, 6.0), ("q", 4, 3.0, 4.0), ("q", 5, 1.0, 5.0), ("q", 6, 4.0, 7.0)]
    c = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "request string, id int, distance_km double, risk_exposure double, caution_len_km double, corridor_score double")
    ranks = {r["id"]: r["pareto_rank"] for r in routes.pareto_rank(c, "request").collect()}
    assert ranks == {1: 1, 2: 1, 5: 1, 3: 2, 4: 2, 6: 3}
    assert {r["id"] for r in routes.pareto_frontier(c, "request").where("frontier").collect()} == {1, 2, 5}


def test_timestamps_and_longitudes(spark):
    df = spark.createDataFrame([("2024-07-01_06",), (" 2024-07-01-06:30 ",), ("x",)], "t string")
    assert [r[0] for r in df.select(normalize_timestamp(F.col("t"))).collect()] == ["2024-07-01_06", "2024-07-01_06", None]
    lon = lambda *v: [r[0] for r in wrap_longitude(spark.createDataFrame([(x,) for x in v], "lon double"), "lon").collect()]
    assert lon(0.0, 180.0, 270.0) == [0.0, -180.0, -90.0] and lon(0.0, 180.0) == [0.0, 180.0]


def test_triggers_count_skipped_steps(spark):
    rows = [(1, i, 0.0, 0, 1.0, 0.0) for i in range(8)]
    got = state.replan_triggers(spark.createDataFrame(rows, "sequence_id long, step_index int, blocked_change double, path_blocked int, corridor double, risk double")).orderBy("step_index").collect()
    assert [r["step_index"] for r in got if r["replan"]] == [0, 3, 6]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,postime,lon,lat,status,eta,dest,draught,cog,hdg,sog,rot\n1,2024-07-01 00:00:00,10,70,,,,,,,,\n2,2024-07-01 00:00:00,x,70,,,,,,,,\n")
    assert files.read_ais_csv(spark, str(tmp_path / "a.csv")).count() == 1
    (tmp_path / "bad.csv").write_text("mmsi,postime,lon,lat,status,eta,dest,draught,cog,hdg,sog,rot\n1,yesterday,10,70,,,,,,,,\n")
    with pytest.raises(Exception, match="bad postime"):
        files.read_ais_csv(spark, str(tmp_path / "bad.csv")).collect()
    pack = tmp_path / "packs" / "2024-07-15_00"
    pack.mkdir(parents=True)
    np.save(pack / "x_stack.npy", np.arange(8, dtype=np.float32).reshape(2, 2, 2))
    (pack / "meta.json").write_text(json.dumps({"channel_names": ["ice_conc"]}))
    cells = files.name_channels(rasters.read_rasters(spark, str(tmp_path / "packs")), files.read_meta(spark, str(tmp_path / "packs")))
    got = {(r["channel"], r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert got["ice_conc", 1, 1] == 3.0 and got["env_1", 0, 0] == 4.0 and len(got) == 8
    (tmp_path / "m.jsonl").write_text('{"path": "a\\\\b", "size": 1}\n\n{"size": 2}\n{"path": "a/b", "size": 3}\n')
    m = files.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()
    assert [(r["path"], r["size"]) for r in m] == [("a/b", 3)]
    files.write_manifest(spark.createDataFrame([tuple(m[0])], files.read_manifest(spark, str(tmp_path / "m.jsonl")).schema), str(tmp_path / "out"))
    assert files.read_manifest(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "bench.json").write_text(json.dumps({"rows": [{"planner": "a", "runtime_ms": 1.5}, {"planner": "b", "runtime_ms": 2.5}]}))
    assert files.read_bench(spark, str(tmp_path / "bench.json")).count() == 2
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "1.json").write_text('{"id": "r1", "explain": {"distance_km": 3.5}}')
    (tmp_path / "runs" / "2.json").write_text('{"id": ')
    assert [r["id"] for r in files.read_run_records(spark, str(tmp_path / "runs"), "id string, explain struct<distance_km: double>").collect()] == ["r1"]
    maps = spark.createDataFrame([(dt.datetime(2024, 7, 1), 1, 2, 0.5)], "center timestamp, row int, col int, heat double")
    files.write_heatmaps(maps, str(tmp_path / "maps"), "7d")
    assert spark.read.parquet(str(tmp_path / "maps")).where("tag = '7d' AND month = '2024-07'").count() == 1


def test_flatten_report(spark):
    df = spark.createDataFrame([(1, (2.0, ["x", "y"], (3,)), [])], "id int, a struct<p: double, q: array<string>, r: struct<s: int>>, b array<int>")
    got = {(r["section"], r["field"]): r["value"] for r in files.flatten_report(df, ["a", "b"], ["id"]).collect()}
    assert got == {("a", "p"): "2.0", ("a", "q[0]"): "x", ("a", "q[1]"): "y", ("a", "r.s"): "3", ("b", ""): "[]"}
