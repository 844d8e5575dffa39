"""Scans, selections, merges and rasters against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floeworks.operators import automaton, catalog, labels, selection, shapes
from floeworks.streaming import state


@pytest.mark.parametrize("block", [2, 5, 128])
def test_automaton(spark, block):
    rng = random.Random(1)
    table = [[rng.randrange(5) for _ in range(5)] for _ in range(3)]
    rows = [(k, i, rng.randrange(3)) for k in range(4) for i in range((1, 40, 7, 130)[k])]
    df = spark.createDataFrame([*rows, (None, 0, 1)], "k int, i int, s int")
    got = {(r["k"], r["i"]): r["state"] for r in automaton.scan(df, "k", "i", F.col("s"), table, 2, block).collect()}
    for k in range(4):
        now = 2
        for _, i, s in (r for r in rows if r[0] == k):
            assert got[k, i] == now
            now = table[s][now]
    assert got[None, 0] is None


def test_modes_and_triggers_by_hand(spark):
    """A mode changes no sooner than the interval after the last change; a change and a spent budget are reasons to plan anew."""
    risk = [0.8, 0.3, -0.9, 0.0, 0.9, 0.0, 0.0]
    steps = spark.createDataFrame([(1, i, float(r)) for i, r in enumerate(risk)], "sequence_id int, step_index int, risk_extra_km double")
    for interval, modes in ((1, ["b", "w", "h", "b", "b", "h", "h"]), (3, ["b", "w", "w", "w", "b", "b", "b"])):
        got = state.risk_budget_modes(steps, 1.0, modes=("b", "w", "h"), min_interval=interval).orderBy("step_index").collect()
        assert [r["mode"] for r in got] == modes
        assert [r["switched"] for r in got] == [a != b for a, b in zip(["b", *modes], modes)]
    made = state.risk_budget_modes(steps, 1.0, modes=("b", "w", "h"))
    assert [(r["step_index"], r["from_mode"], r["to_mode"]) for r in state.risk_switch_events(made).orderBy("step_index").collect()] == [(1, "b", "w"), (2, "w", "h"), (3, "h", "b"), (5, "b", "h")]
    more = made.select("sequence_id", "step_index", "stage", "switched", F.lit(0.0).alias("blocked_change"), F.lit(1).alias("path_blocked"), F.lit(1.0).alias("corridor"), F.lit(0.0).alias("risk"), (F.col("step_index") % 2 * 2).alias("cached_cells"))
    got = [r["reasons"] for r in state.replan_triggers(more).orderBy("step_index").collect()]
    assert got[0] == ["initial_step"] and got[1] == ["path_blocked", "risk_mode_switch"] and got[2] == ["no_cached_path", "risk_mode_switch", "risk_budget_pressure"] and got[4] == ["no_cached_path"]
    assert [r["reasons"][0] for r in state.replan_triggers(more, always=True).orderBy("step_index").collect()] == ["initial_step"] + ["always_mode"] * 6


def test_run_states(spark):
    actions = ["create", "delete", "purge", "restore", "touch", "purge", "restore", "create", "create"]
    states = ["active", "recycled", "recycled", "active", "active", "purged", "purged", "active", "active"]
    since = [0, 1, 1, 3, 3, 5, 5, 7, 7]
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, a) for n in range(1, 10) for i, a in enumerate(actions[:n])] + [(99, dt.datetime(2024, 1, 1), 0, "delete")]
    got = {r["run_id"]: (r["state"], r["since"].hour) for r in state.run_states(spark.createDataFrame(rows, "run_id int, ts timestamp, event_id int, action string")).collect()}
    assert got == {n: (states[n - 1], since[n - 1]) for n in range(1, 10)}


@pytest.mark.parametrize(("bins", "small"), [(4, 1), (64, 3), (4096, 1000)])
def test_order_statistics(spark, bins, small):
    rng = random.Random(2)
    make = (lambda: rng.gauss(0, 1), lambda: rng.choice([1.5, 2.5]), lambda: rng.choice([-1, 1]) * 2.0 ** rng.randrange(-1074, 1023), lambda: float(rng.randrange(9)), lambda: 7.0)
    values = {k: [f() for _ in range((200, 50, 60, 1, 30)[k])] for k, f in enumerate(make)}
    values[2] += [float("inf"), float("-inf"), 0.0, -0.0]
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(0, None), (5, None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = selection.quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}, bins, small).collect()
    assert {r["k"] for r in got} == {0, 1, 2, 3, 4, None}
    for r in got:
        have = sorted(values[r["k"]] if r["k"] is not None else [3.0, 4.0])
        for name, q in (("a", 0.0), ("b", 0.37), ("c", 0.5), ("d", 1.0)):
            at = (len(have) - 1) * q
            low, high = have[math.floor(at)], have[math.ceil(at)]
            want = low if low == high else low * (math.ceil(at) - at) + high * (at - math.floor(at))
            assert r[name] == want or math.isclose(r[name], want, rel_tol=1e-12)
    assert selection.quantiles(df.where("k = 0"), [], "v", {"m": 0.5}, bins, small).first()["m"] == pytest.approx(np.median(values[0]))
    assert selection.quantiles(df.where("k = 9"), ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 64])
@pytest.mark.parametrize("by", [None, "k"])
def test_nearest_timestamp(spark, ranges, by):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    time = lambda: start + dt.timedelta(minutes=rng.randrange(3000))
    have = [(rng.randrange(3), time()) for _ in range(25)] + [(0, None)]
    asked = [(rng.randrange(4), time()) for _ in range(60)] + [(1, None), (1, start), (1, start)]
    frame = lambda rows: spark.createDataFrame(rows, "k int, ts timestamp")
    got = catalog.nearest_timestamp(frame(asked), frame(have), by, ranges).collect()
    want = []
    for k, t in asked:
        near = [h for n, h in have if h is not None and t is not None and (by is None or n == k)]
        want.append((*([k] if by else []), t, min(near, key=lambda h: (abs(h - t), h), default=None)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert "SinglePartition" not in catalog.nearest_timestamp(frame(asked), frame(have), by, ranges)._jdf.queryExecution().toString()


def plain_cells(shape, points, radius, h, w):
    """A cell at a time: centres inside by the even-odd rule and points along the edges; discs along a line; boxes; discs."""
    x, y = [p[0] for p in points], [p[1] for p in points]

    def along(a, b):
        n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]))) + 1
        return [(round(r), round(c)) for r, c in zip(np.linspace(a[1], b[1], n).tolist(), np.linspace(a[0], b[0], n).tolist())]

    out = set()
    if shape == "polygon":
        edges = list(zip([points[-1], *points[:-1]], points))
        for r in range(h):
            for c in range(w):
                inside = False
                for (x0, y0), (x1, y1) in edges:
                    if (y1 > r + 0.5) != (y0 > r + 0.5) and c + 0.5 < (x0 - x1) * (r + 0.5 - y1) / (y0 - y1 + 1e-9) + x1:
                        inside = not inside
                if inside:
                    out.add((r, c))
        low, high = (lambda v, n: max(0, min(n - 1, math.floor(min(v)) - 1))), (lambda v, n: max(0, min(n - 1, math.ceil(max(v)) + 1)))
        for e in edges:
            out |= {(max(low(y, h), min(high(y, h), r)), max(low(x, w), min(high(x, w), c))) for r, c in along(*e)}
    elif shape == "stroke":
        n = max(1, int(radius))
        for e in zip(points, points[1:]):
            out |= {(r + a, c + b) for r, c in along(*e) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= n * n}
    elif shape == "rectangle":
        out = {(r, c) for r in range(h) for c in range(w) if min(x) <= c <= max(x) and min(y) <= r <= max(y)}
    else:
        out = {(r, c) for r in range(h) for c in range(w) if (r - y[0]) ** 2 + (c - x[0]) ** 2 <= math.hypot(x[1] - x[0], y[1] - y[0]) ** 2 * (1 + 1e-12)}
    return {(r, c) for r, c in out if 0 <= r < h and 0 <= c < w}


def test_rasterize(spark):
    rng = random.Random(4)
    ops = []
    for i in range(60):
        shape = ["polygon", "stroke", "rectangle", "circle"][i % 4]
        n = 2 if i % 4 > 1 else rng.randrange(3, 8) if i % 4 == 0 else rng.randrange(2, 6)
        step = rng.choice([1, 0.25])
        ops.append((i % 3, i, "add", shape, float(rng.randrange(0, 4)), [(rng.randrange(-20, 140) * step / 2, rng.randrange(-20, 100) * step / 2) for _ in range(n)]))
    df = spark.createDataFrame([*ops, (0, 99, "add", "polygon", 1.0, [(1.0, 1.0)]), (0, 98, "add", "stroke", 1.0, None)], "sample_id int, op_idx int, mode string, shape string, radius double, points array<struct<col: double, row: double>>")
    got = {}
    rows = shapes.rasterize(df, 40, 60).collect()
    for r in rows:
        got.setdefault(r["op_idx"], set()).add((r["row"], r["col"]))
    assert len(rows) == sum(map(len, got.values()))
    for _, i, _, shape, radius, points in ops:
        assert got.get(i, set()) == plain_cells(shape, points, radius, 40, 60), (i, shape, points, radius)
    plan = shapes.rasterize(df, 40, 60)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_scores_equal_to_the_cut_are_hard(spark):
    """A quantile between equal neighbours is their value, so that ties at the cut stay on its upper side."""
    for v in (0.1, 0.3, 0.7, 1 / 3):
        values = [0.01 * i for i in range(3)] + [v] * 8 + [0.9]
        scores = spark.createDataFrame(list(enumerate(values)), "sample_id long, score double")
        for q in (0.35, 0.8, 0.77):
            assert selection.quantiles(scores, [], "score", {"cut": q}).first()["cut"] == v
            out = {r["sample_id"]: r for r in labels.hard_sample_weights(scores, q).collect()}
            assert [i for i in out if not out[i]["hard"]] == [i for i in out if values[i] < v]
            assert abs(sum(r["weight"] for r in out.values()) - 1) < 1e-9
    nothing = spark.createDataFrame([], "sample_id long, score double")
    assert labels.hard_sample_weights(nothing).collect() == []
