"""What holds on larger tables: copies, crowds and missing layers."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from floeworks.functions.scalars import uniform
from floeworks.operators import catalog, raster, reports, routes, tiles
from floeworks.plans.all import ORACLES, QUERIES
from floeworks.plans.voyages import SEGMENTS
from floeworks.sources import rasters

from .test_oracles import duck, plain  # noqa: F401

LAST_MAP = ["blocked_from_bathy", "merge_labels", "numeric_quality", "sample_quality", "reason_counts", "risk_hint"]


def test_equal_routes_are_one_class(spark, monkeypatch):
    """Each route beyond the first of a class is one row, and pairs of classes agree with all pairs of routes, over several blocks."""
    monkeypatch.setattr(routes, "ROUTES", 4)
    rng = random.Random(5)
    shapes = [frozenset((0, rng.randrange(30)) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    sets = {(g, r): shapes[r % len(shapes)] for g in (0, 1) for r in range(100)}
    rows = spark.createDataFrame([(g, r, *c) for (g, r), cs in sets.items() for c in cs], "request long, route_id long, row int, col int")
    for least in (0.0, 0.3):
        got = routes.route_overlap(rows, "request", 0.82, least).collect()
        assert len(got) < 2 * (len(shapes) ** 2 + 100)  # all pairs of routes are 2 * 4950
        first = {(r["request"], r["route_b"]): r["route_a"] for r in got if r["copy"]}
        ratios = {(r["request"], r["route_a"], r["route_b"]): r["ratio"] for r in got if not r["copy"]}
        assert len(ratios) + len(first) == len(got)
        for g in (0, 1):
            for a in range(100):
                for b in range(a + 1, 100):
                    x, y = sorted(first.get((g, r), r) for r in (a, b))
                    found = 1.0 if x == y else ratios.get((g, x, y))
                    s, t = sets[g, a], sets[g, b]
                    want = len(s & t) / min(len(s), len(t))
                    assert found == (want if want > 0 and want >= least else None)


@pytest.mark.parametrize("name, least", [("route_overlap", 0.0), ("similar_routes", 0.3), ("route_overlap_limit", 0.3)])
def test_all_pairs_of_copies(spark, duck, tmp_path, name, least):
    """A query of pairs gives each pair of routes, also where routes have the same cells."""
    some = "SELECT * REPLACE (event_id + k * 10000000 AS event_id, user_id + k * 1000 AS user_id) FROM events, range(3) t(k) WHERE user_id < 30"
    duck.sql(f"SELECT * EXCLUDE (k) FROM ({some})").write_parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    sets = {}
    for route, *cell in con.sql(SEGMENTS + "SELECT DISTINCT route_id, row, col FROM traced").fetchall():
        sets.setdefault(route, set()).add(tuple(cell))
    want = {}
    for a in sets:
        for b in sets:
            shared, smaller = len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))
            if a < b and a % 10 == b % 10 and shared and shared / smaller >= least:
                x, y = sorted((a, b), key=lambda r: (len(sets[r]), r)) if name == "similar_routes" else (a, b)
                want[x, y] = round(shared / smaller, 5)
    assert sum(r == 1.0 for r in want.values()) >= 90  # three copies of each of 30 routes
    got = [(r["route_a"], r["route_b"], r["ratio"]) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((*k, pytest.approx(r, abs=1.1e-5)) for k, r in want.items())


def test_unknown_depth_is_blocked(spark):
    rows = spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.0), (3, -1.0)], "i int, bathy double")
    assert [r[1] for r in rows.select("i", raster.blocked_from_bathy(F.col("bathy"))).orderBy("i").collect()] == [1, 1, 1, 0]


def compared(spark, duck, names, vectors, folder):
    """Rows of the queries and of their SQL on tables with so many embeddings; the last map lacks layers."""
    folder.mkdir()
    for t in ("embeddings", "events"):
        rows = duck.sql(f"SELECT * FROM {t}" + (f" WHERE vec_id < {vectors}" if t == "embeddings" else " LIMIT 100"))
        rows.write_parquet(str(folder / f"{t}.parquet"))
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in names:
        df = QUERIES[name](spark, str(folder))
        found = con.sql(ORACLES[name])
        rows = [tuple(r[c] for c in found.columns) for r in df.collect()]
        yield name, sorted(tuple(map(plain, r)) for r in rows), sorted(tuple(map(plain, r)) for r in found.fetchall())


@pytest.mark.parametrize("vectors", [11, 12, 13, 14])
def test_last_map_without_layers(spark, duck, tmp_path, vectors):
    for name, got, want in compared(spark, duck, LAST_MAP, vectors, tmp_path / "t"):
        assert got == want, name


def test_tags_at_the_limit(spark, tmp_path):
    rows = spark.createDataFrame([(i, k, v) for i in (1, 4) for k in ("purchase", "view", "error") for v in (199.99, 200.0, 200.01, 250.0)], "event_id long, event_type string, value double")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["root_cause_tags"](spark, str(tmp_path)).select("event_id", "tags").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLES["root_cause_tags"]).fetchall())


@pytest.mark.parametrize("task", [32 << 20, 200, 64])
def test_small_files_share_a_partition(tmp_path, monkeypatch, task):
    """Files are packed into partitions, large ones cut, and each row is read once."""
    monkeypatch.setattr(rasters, "TASK", task)
    want = {}
    for i in range(40):
        (tmp_path / f"m{i}").mkdir()
        a = np.random.default_rng(i).standard_normal((2, 3, 4))
        np.save(tmp_path / f"m{i}" / "x_stack.npy", a)
        want.update({(f"m{i}", *at): v for at, v in np.ndenumerate(a)})
    reader = rasters.RasterReader({"path": str(tmp_path), "partbytes": "64"})
    parts = reader.partitions()
    assert len(parts) == 1 if task > 1000 else len(parts) >= 40
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == len(want) and {r[:4]: r[4] for r in got} == want


def test_tiles_are_streamed(spark):
    """Many small maps pass a few rows at a time, and one call of Python has many tiles."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    cells = spark.range(40 * 36).selectExpr("nullif(id div 36, 7) AS sample_id", "CAST(id % 36 div 6 AS int) AS row", "CAST(id % 6 AS int) AS col", "CAST(id * 7 % 11 AS double) AS v")
    want = {}
    for r in cells.collect():
        want.setdefault(r["sample_id"], np.zeros((6, 6)))[r["row"], r["col"]] = r["v"]
    try:
        for rows in (1, 5, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            out = tiles.box_blur(cells, "v", 1, tile=4)
            assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
            got = out.collect()
            assert len(got) == 40 * 36
            for r in got:
                p = np.pad(want[r["sample_id"]], 1, mode="edge")
                assert abs(r["blurred"] - p[r["row"] : r["row"] + 3, r["col"] : r["col"] + 3].mean()) < 1e-9
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_replicates_are_summed_in_tasks(spark, monkeypatch):
    """Numbers agree with uniform(), samples are not repeated for each replicate, and sums that are given early add up."""
    ids = [0, 1, 77, 2**40 + 3, -5]
    rows = spark.createDataFrame([(i, k) for i in ids for k in range(50)], "id long, k int")
    want = {(r[0], r[1]): r[2] for r in rows.select("id", "k", uniform(F.col("id"), F.col("k"), seed=9)).collect()}
    made = reports._numbers(np.array(ids), 50, 9)
    assert all(made[n, k] == want[i, k] for n, i in enumerate(ids) for k in range(50))
    samples = spark.range(600).selectExpr("id", "CAST(id % 7 AS string) AS key", "CAST(id % 11 AS double) AS value")
    assert "explode" not in reports.bootstrap_ci(samples)._jdf.queryExecution().toString()
    whole = sorted(map(tuple, reports.bootstrap_ci(samples, 200).collect()))
    monkeypatch.setattr(reports, "AT_ONCE", 13)
    monkeypatch.setattr(reports, "KEYS_HELD", 2)
    for a, b in zip(whole, sorted(map(tuple, reports.bootstrap_ci(samples, 200).collect())), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_nearest_in_a_crowded_range(spark):
    """No frame over the rows of a range or column ends at its far end, which would be read again for every row."""
    have = np.unique(np.random.default_rng(1).integers(0, 10**9, 2_000)) * 1_000
    asked = np.unique(np.random.default_rng(2).integers(-(10**8), 11 * 10**8, 20_000)) * 1_000
    frame = lambda at: spark.createDataFrame([(int(v),) for v in at], "v long").select(F.timestamp_micros("v").alias("ts"))
    out = catalog.nearest_timestamp(frame(asked), frame(have), None, 1)
    right = np.searchsorted(have, asked)
    a, b = have[np.maximum(right - 1, 0)], have[np.minimum(right, len(have) - 1)]
    want = np.where(np.abs(asked - a) <= np.abs(b - asked), a, b)
    got = dict(map(tuple, out.select(F.unix_micros("ts"), F.unix_micros("nearest")).collect()))
    assert got == dict(zip(asked.tolist(), want.tolist(), strict=True))
    points, cells = spark.createDataFrame([(0, 5, 5)], "id int, row int, col int"), spark.createDataFrame([(9, 9, 0)], "row int, col int, blocked int")
    for df in (out, routes.nearest_free_cell(points, cells)):
        assert "RangeFrame, currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().toString()
