"""Queries over reports, statistics, annotation and the rest of curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bench as B
from ..operators import catalog as C
from ..operators import labels as L
from ..operators import raster as R
from ..operators import reports as P
from ..operators import shapes as S
from ..functions.scalars import PRIME, uniform_sql
from ..sources.files import flatten_report
from .adapters import adapt, ctes
from .basics import LAYERS, registry
from .experiments import BENCH, rounded
from .rasters import CELLS, PAIRS, cells_of, normal
from .registry import ORACLES, query


@query(
    "normalize_versions",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('s', CAST(user_id AS VARCHAR)) WHEN event_type = 'view' THEN 'none' ELSE event_type END AS dataset, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'm2' ELSE 'v1' END AS model FROM events",
)
def versions(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("dataset"), "user_id")
    snapshot = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("dataset"), F.concat(F.lit("s"), F.col("user_id").cast("string")), F.lit("model"), F.when(F.col("event_id") % 2 == 0, "m2").otherwise(" ")))
    return P.normalize_versions(e.withColumn("version_snapshot", snapshot), {"dataset": "none", "model": "v1"}).select("event_id", "dataset", "model")




@query(
    "risk_reports",
    """WITH c AS (SELECT o_custkey AS cust, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'fail' ELSE 'ok' END AS status, o_totalprice AS km, o_orderkey % 17 / 10e0 AS risk FROM orders),
    w AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY k) AS i FROM c WHERE status = 'ok'),
    s AS (SELECT cust, arg_min(k, i) AS sk, arg_min(km, i) AS skm, arg_min(risk, i) AS sr FROM w GROUP BY 1), x AS (SELECT cust, k AS wk, km AS wkm, risk AS wr FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY risk DESC, k) AS j FROM w) WHERE j = 1),
    t AS (SELECT cust, count(*) AS n, sum(km) AS d, count(*) FILTER (WHERE status = 'ok') AS n_ok FROM c GROUP BY 1)
    SELECT cust AS id, 0.25e0 AS caution_ratio, CAST(n AS INTEGER) AS n_candidates, CAST(n_ok AS INTEGER) AS n_ok, CAST(sk AS VARCHAR) AS selected_id, CAST(wk AS VARCHAR) AS worst_id, round(coalesce(wr - sr, 0e0), 5) AS risk_reduction, round(coalesce(skm - wkm, 0e0), 3) AS distance_tradeoff_km,
    CASE WHEN cust % 3 = 0 THEN 'cvar' ELSE 'none' END AS mode, 'none' AS metric_name, 0e0 AS metric, 0.5e0 AS budget, round(cust % 7 / 5e0, 6) AS usage, cust % 7 <= 5 AS satisfied, 0e0 AS confidence_level
    FROM t LEFT JOIN s USING (cust) LEFT JOIN x USING (cust)""",
)
def risk(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    one = F.struct(F.col("o_orderkey").alias("k"), F.struct(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "fail").otherwise("ok").alias("status"), F.col("o_totalprice").alias("distance_km"), (F.col("o_orderkey") % 17 / 10).alias("risk_exposure")).alias("c"))
    runs = o.groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("distance_km"), (F.sum("o_totalprice") / 4).alias("caution_len_km"), F.array_sort(F.collect_list(one)).alias("a"))
    runs = runs.select("id", "distance_km", "caution_len_km", F.transform("a", lambda x: x.c).alias("candidates"), F.when(F.col("id") % 3 == 0, "cvar").alias("risk_constraint_mode"), F.lit(0.5).alias("risk_budget"), (F.col("id") % 7 / 5).alias("risk_budget_usage"), (F.col("id") % 7 <= 5).alias("risk_constraint_satisfied"))
    reports = P.risk_reports(runs).select("*", "constraint.*").drop("constraint")
    return rounded(rounded(reports, "risk_reduction", "caution_ratio"), "distance_tradeoff_km", digits=3)


DERIVED = (
    BENCH
    + """, v AS (SELECT *, CASE WHEN run_id % 4 = 0 THEN run_id % 8 = 0 ELSE risk_exposure / 3 > 1 END AS bad FROM bench),
    m AS (SELECT planner, avg(CAST(status = 'ok' AS INT)) AS success_rate, avg(CAST(bad AS INT)) FILTER (WHERE status = 'ok') AS violation_rate, avg(route_cost_effective_km) FILTER (WHERE status = 'ok' AND mode = 'static') AS static_cost, avg(route_cost_effective_km) FILTER (WHERE status = 'ok' AND mode = 'dynamic') AS dynamic_cost,
    avg(CASE WHEN run_id % 10 = 0 OR run_id % 10 = 1 THEN 0 ELSE 1 END) FILTER (WHERE status = 'ok') AS explain_consistency FROM v GROUP BY 1)\n"""
)


def derived_of(spark: SparkSession, d: str) -> DataFrame:
    b = adapt(spark, d, "bench").withColumn("risk_constraint_satisfied", F.when(F.col("run_id") % 4 == 0, F.col("run_id") % 8 != 0)).withColumn("risk_budget_usage", F.col("risk_exposure") / 3)
    alignment = F.when(F.col("run_id") % 10 == 1, float("nan")).when(F.col("run_id") % 10 != 0, 0.5)  # some are missing, some no numbers
    return P.derived_metrics(b.withColumn("corridor_alignment", alignment))


@query("derived_metrics", DERIVED + "SELECT planner, round(success_rate, 5) AS success_rate, round(violation_rate, 5) AS violation_rate, round(static_cost, 4) AS static_cost, round(dynamic_cost, 4) AS dynamic_cost, round((static_cost - dynamic_cost) / static_cost, 5) AS dynamic_gain, round(explain_consistency, 5) AS explain_consistency FROM m")
def derived(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(derived_of(spark, d), "success_rate", "violation_rate", "dynamic_gain", "explain_consistency"), "static_cost", "dynamic_cost", digits=4)


@query("metric_validation", DERIVED + " UNION ALL ".join(f"SELECT planner, '{m}' AS metric, {m} IS NOT NULL AS present, {m} BETWEEN 0 AND 1 AS in_range FROM m" for m in ("success_rate", "violation_rate", "static_cost", "explain_consistency")))
def validated(spark: SparkSession, d: str) -> DataFrame:
    return P.metric_validation(derived_of(spark, d), ["success_rate", "violation_rate", "static_cost", "explain_consistency"])


@query(
    "closed_loop_delta",
    BENCH
    + """, a AS (SELECT avg(distance_km) AS k, avg(runtime_ms) AS m FROM bench WHERE status = 'ok' AND repeat_idx = 0), b AS (SELECT avg(distance_km) AS k, avg(runtime_ms) AS m FROM bench WHERE status = 'ok' AND repeat_idx = 1)
    SELECT (SELECT max(value) / 500 FROM events) AS best_iou, (SELECT arg_max(value, event_id) / 500 FROM events) AS final_iou, round(b.k - a.k, 4) AS distance_delta_km, round(b.m - a.m, 4) AS runtime_delta_ms FROM a, b""",
)
def loop(spark: SparkSession, d: str) -> DataFrame:
    b = adapt(spark, d, "bench")
    train = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("epoch"), (F.col("value") / 500).alias("iou"))
    return rounded(P.closed_loop_delta(train, b.where("repeat_idx = 0"), b.where("repeat_idx = 1")), "distance_delta_km", "runtime_delta_ms", digits=4)


def samples(spark: SparkSession, d: str) -> DataFrame:
    return adapt(spark, d, "bench").where("status = 'ok'").select(F.col("planner").alias("key"), F.col("run_id").alias("id"), F.col("runtime_ms").alias("value"))


RESAMPLED = BENCH + ", x AS (SELECT planner AS key, run_id AS id, runtime_ms AS value FROM bench WHERE status = 'ok')\n"
WEIGHT = " + ".join(f"CASE WHEN u > {c!r}e0 THEN 1 ELSE 0 END" for c in P.POISSON)


@query(
    "bootstrap_ci",
    RESAMPLED
    + f""", r AS (SELECT key, replicate, value, {uniform_sql("id", "replicate")} AS u FROM x, range(0, 200) t(replicate)), w AS (SELECT *, {WEIGHT} AS w FROM r),
    m AS (SELECT key, replicate, sum(w * value) / sum(w) AS m FROM w GROUP BY 1, 2), c AS (SELECT key, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
    SELECT key, round(avg(value), 4) AS mean, count(*) AS n, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high FROM x JOIN c USING (key) GROUP BY 1""",
)
def intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.bootstrap_ci(samples(spark, d), 200), "mean", "low", "high", digits=4)


@query(
    "permutation_test",
    RESAMPLED
    + f""", y AS (SELECT * FROM x WHERE key IN ('1-URGENT', '5-LOW')), t AS (SELECT avg(value) FILTER (WHERE key = '1-URGENT') AS ma, avg(value) FILTER (WHERE key = '5-LOW') AS mb, avg(CASE WHEN key = '1-URGENT' THEN 1e0 ELSE 0e0 END) AS share FROM y),
    r AS (SELECT replicate, value, {uniform_sql("id", "replicate")} < share AS l FROM y, t, range(0, 1000) n(replicate)), d AS (SELECT avg(value) FILTER (WHERE l) - avg(value) FILTER (WHERE NOT l) AS d FROM r GROUP BY replicate)
    SELECT round(any_value(ma - mb), 4) AS difference, round((count(*) FILTER (WHERE abs(d) >= abs(ma - mb)) + 1) / (count(*) + 1), 6) AS p_value FROM d, t""",
)
def permutation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(P.permutation_test(samples(spark, d), "1-URGENT", "5-LOW", 1000), "difference", digits=4), "p_value", digits=6)


MEASURED = (
    BENCH
    + """, o AS (SELECT planner, run_id AS id, status = 'ok' AS ok, route_cost_effective_km AS cost, risk_exposure AS risk, greatest(0e0, 1 - caution_len_km / greatest(distance_km, 1e-9)) AS safety FROM (SELECT * REPLACE (lower(trim(planner)) AS planner) FROM bench) WHERE mode = 'dynamic'),
    ms AS (SELECT planner, id, 'completion_rate' AS metric, CASE WHEN ok THEN 1e0 ELSE 0e0 END AS value FROM o UNION ALL SELECT planner, id, 'total_cost_km', cost FROM o WHERE ok UNION ALL SELECT planner, id, 'replan_latency_ms', 0e0 FROM o WHERE ok
      UNION ALL SELECT planner, id, 'risk_exposure', risk FROM o WHERE ok UNION ALL SELECT planner, id, 'route_safety', safety FROM o WHERE ok)\n"""
)


@query("metric_samples", MEASURED + "SELECT planner, id, metric, round(value + 1e-9, 4) AS value FROM ms")
def measured(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.metric_samples(adapt(spark, d, "bench")).withColumn("value", F.col("value") + 1e-9), "value", digits=4)


@query(
    "significance",
    MEASURED
    + f""", g AS (SELECT metric, planner, count(*) AS n, avg(value) AS mean, coalesce(var_samp(value), 0e0) AS v FROM ms GROUP BY 1, 2),
    p AS (SELECT a.metric, a.planner AS planner_a, b.planner AS planner_b, a.n AS n_a, b.n AS n_b, a.mean - b.mean AS diff, a.n / (a.n + b.n) AS share, (a.mean - b.mean) / sqrt(greatest(1e-12, ((a.n - 1) * a.v + (b.n - 1) * b.v) / greatest(1, a.n + b.n - 2))) AS effect_size FROM g a JOIN g b ON a.metric = b.metric AND a.planner < b.planner),
    r AS (SELECT metric, planner, value, replicate, {uniform_sql("id", "replicate")} AS u FROM ms, range(0, 200) t(replicate)),
    d AS (SELECT p.metric, planner_a, planner_b, any_value(diff) AS diff, avg(value) FILTER (WHERE u < share) - avg(value) FILTER (WHERE NOT u < share) AS d FROM p JOIN r ON r.metric = p.metric AND r.planner IN (planner_a, planner_b) GROUP BY p.metric, planner_a, planner_b, replicate),
    e AS (SELECT metric, planner_a, planner_b, (count(*) FILTER (WHERE abs(d) >= abs(diff)) + 1) / (count(*) + 1) AS p_value FROM d GROUP BY 1, 2, 3),
    w AS (SELECT *, {WEIGHT} AS w FROM r), m AS (SELECT metric, planner, replicate, sum(w * value) / sum(w) AS m FROM w GROUP BY 1, 2, 3), c AS (SELECT metric, planner, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1, 2),
    q AS (SELECT p.*, p_value, a.low - b.high AS low, a.high - b.low AS high FROM p JOIN e USING (metric, planner_a, planner_b) JOIN c a ON a.metric = p.metric AND a.planner = planner_a JOIN c b ON b.metric = p.metric AND b.planner = planner_b)
    SELECT metric, planner_a, planner_b, n_a, n_b, round(diff, 5) AS mean_diff, round(p_value, 6) AS p_value, round(effect_size, 5) AS effect_size, CASE WHEN p_value >= 0.05 THEN 'tie' WHEN (diff > 0) = (metric IN ('completion_rate', 'route_safety')) THEN planner_a ELSE planner_b END AS winner,
    CASE WHEN p_value < 0.01 AND (low > 0 AND high > 0 OR low < 0 AND high < 0) THEN 'high' WHEN p_value < 0.05 AND (low > 0 AND high > 0 OR low < 0 AND high < 0) THEN 'medium' ELSE 'low' END AS confidence FROM q""",
)
def significant(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(P.significance(P.metric_samples(adapt(spark, d, "bench")), 200), "mean_diff", "effect_size"), "p_value", digits=6)


U53 = f"{uniform_sql('draw')} + {uniform_sql('draw', seed=1)} / {PRIME}e0"


@query(
    "weighted_draws",
    f"""WITH k AS (SELECT o_orderkey AS sample_id, o_totalprice AS weight, floor({uniform_sql("o_orderkey")} * 4096) AS slice FROM orders), s AS (SELECT slice, sum(weight) AS w FROM k GROUP BY 1), h AS (SELECT slice, w, sum(w) OVER (ORDER BY slice) AS high, sum(w) OVER () AS total FROM s),
    d AS (SELECT draw, {U53} AS u FROM range(0, (SELECT count(*) FROM orders)) t(draw)), p AS (SELECT draw, slice, u * total - high + w AS x FROM d JOIN h ON u * total >= high - w AND u * total < high),
    i AS (SELECT slice, sample_id, weight, sum(weight) OVER (PARTITION BY slice ORDER BY sample_id) AS upto FROM k)
    SELECT draw, sample_id FROM p JOIN i USING (slice) WHERE x >= upto - weight AND x < upto""",
)
def draws(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("weight"))
    return P.weighted_draws(weights, weights.count())


@query("derive_layers", CELLS + f", t AS (SELECT sample_id, max(abs(ice_conc)) AS top FROM cells GROUP BY 1) SELECT c.sample_id, c.row, c.col, round(sqrt(wind_u10 * wind_u10 + wind_v10 * wind_v10), 5) AS wind_speed, round(least(greatest(CASE WHEN top > 2 THEN ice_conc / 100 ELSE ice_conc END, 0e0), 1e0), 5) AS ice_fraction, round(1 - x, 5) AS ais_inverse FROM cells c JOIN t USING (sample_id) JOIN {normal('ais_heatmap', 'x').replace('CASE WHEN blocked = 0 THEN ais_heatmap END', 'ais_heatmap')} USING (sample_id, row, col)")
def derived_layers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.derive_layers(cells_of(spark, d)).select("sample_id", "row", "col", "wind_speed", "ice_fraction", "ais_inverse"), "wind_speed", "ice_fraction", "ais_inverse")


HINTS = {"ice_conc": 0.42, "wave_hs": 0.28, "speed": 0.20, "ais_heatmap": 0.10}


@query(
    "risk_hint",
    CELLS
    + ", w AS (SELECT *, sqrt(wind_u10 * wind_u10 + wind_v10 * wind_v10) AS speed FROM cells), q AS (SELECT sample_id, "
    + ", ".join(f"quantile_cont({c}, 0.02) AS lo_{c}, quantile_cont({c}, 0.98) AS hi_{c}" for c in HINTS)
    + " FROM w GROUP BY 1) SELECT sample_id, row, col, round(CASE WHEN blocked = 1 THEN 0e0 ELSE "
    + " + ".join(f"{v}e0 * least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c}), 0e0), 1e0)" for c, v in HINTS.items())
    + " END, 5) AS hint FROM w JOIN q USING (sample_id)",
)
def hint(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.risk_hint(cells_of(spark, d)).select("sample_id", "row", "col", "hint"), "hint")


FACTORS = {"ice_conc": "ice", "wave_hs": "wave", "speed": "wind", "ais_heatmap": "traffic"}


@query(
    "explain_samples",
    CELLS
    + ", w AS (SELECT *, sqrt(wind_u10 * wind_u10 + wind_v10 * wind_v10) AS speed FROM cells), q AS (SELECT sample_id, "
    + ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in FACTORS)
    + " FROM w GROUP BY 1), m AS (SELECT sample_id, "
    + ", ".join(f"avg(least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c}), 0e0), 1e0)) AS {n}" for c, n in FACTORS.items())
    + ", avg(unc) AS unc FROM w JOIN q USING (sample_id) GROUP BY 1), s AS (SELECT *, ice + wave + wind + traffic + unc AS t, greatest(ice, wave, wind, traffic, unc) AS g FROM m) SELECT sample_id, "
    + ", ".join(f"round({n} / t, 4) AS {n}" for n in (*FACTORS.values(), "unc"))
    + ", CASE g WHEN ice THEN 'ice' WHEN wave THEN 'wave' WHEN wind THEN 'wind' WHEN traffic THEN 'traffic' ELSE 'unc' END AS dominant FROM s",
)
def explained(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.explain_samples(cells_of(spark, d)), *FACTORS.values(), "unc", digits=4)


@query(
    "heuristic_classes",
    CELLS
    + f""", w AS (SELECT *, sqrt(wind_u10 * wind_u10 + wind_v10 * wind_v10) AS speed FROM cells),
    r AS (SELECT w.sample_id, w.row, w.col, blocked, 0.5e0 * a + 0.3e0 * b + 0.2e0 * c AS risk FROM w JOIN {normal('ice_conc', 'a')} x USING (sample_id, row, col) JOIN {normal('wave_hs', 'b')} y USING (sample_id, row, col) JOIN {normal('speed', 'c', 'w')} z USING (sample_id, row, col)),
    q AS (SELECT sample_id, quantile_cont(risk, 0.82) AS cut FROM r WHERE blocked = 0 GROUP BY 1)
    SELECT sample_id, row, col, round(risk, 5) AS risk, CASE WHEN blocked = 1 THEN 2 WHEN risk >= cut THEN 1 ELSE 0 END AS cls, round(CASE WHEN blocked = 0 THEN greatest(0e0, 1 - abs(risk - cut) / 0.25e0) ELSE 0e0 END, 4) AS unc FROM r LEFT JOIN q USING (sample_id)""",
)
def heuristic(spark: SparkSession, d: str) -> DataFrame:
    out = P.heuristic_classes(cells_of(spark, d)).select("sample_id", "row", "col", "risk", "cls", "unc")
    return rounded(rounded(out, "risk"), "unc", digits=4)


@query(
    "annotation_quality",
    CELLS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, on_ AS (SELECT sample_id, row, col, row * 8 + col AS id FROM cells WHERE caution > 0), reach AS (SELECT sample_id, row, col, id AS root FROM on_ UNION SELECT o.sample_id, o.row, o.col, r.root FROM reach r JOIN on_ o ON o.sample_id = r.sample_id AND abs(o.row - r.row) <= 1 AND abs(o.col - r.col) <= 1),
    m AS (SELECT sample_id, row, col, min(root) AS root FROM reach GROUP BY 1, 2, 3), c AS (SELECT sample_id, root, count(*) AS n FROM m GROUP BY 1, 2), p AS (SELECT sample_id, count(*) AS components, count(*) FILTER (WHERE n <= 2) AS tiny FROM c GROUP BY 1),
    s AS (SELECT sample_id, count(*) FILTER (WHERE caution > 0 AND blocked > 0) / greatest(count(*) FILTER (WHERE caution > 0), 1) AS overlap_ratio FROM cells GROUP BY 1)
    SELECT sample_id, round(overlap_ratio, 6) AS overlap_ratio, coalesce(components, 0) AS components, coalesce(tiny, 0) AS tiny, overlap_ratio <= 0.5 AND coalesce(tiny, 0) <= 0.5 * coalesce(components, 0) AS ok FROM s LEFT JOIN p USING (sample_id)""",
)
def annotated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.annotation_quality(cells_of(spark, d)), "overlap_ratio", digits=6)


#: A box and a line that differ from sample to sample.
BOX = {"x0": "sample_id % 3", "x1": "sample_id % 3 + 3 + sample_id % 2", "y0": "sample_id % 4", "y1": "sample_id % 4 + 3", "line": "sample_id % 8"}


def ops(spark: SparkSession, d: str) -> DataFrame:
    ids = cells_of(spark, d).select("sample_id").distinct().select("sample_id", *(F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in BOX.items()))
    at = lambda x, y: f"named_struct('col', {x}, 'row', {y})"
    box = f"array({at('x0', 'y0')}, {at('x1', 'y0')}, {at('x1', 'y1')}, {at('x0', 'y1')})"
    line = f"array({at('0D', 'line')}, {at('7D', 'line')})"
    return ids.select("sample_id", F.expr(f"inline(array(named_struct('op_idx', 0, 'mode', 'add', 'shape', 'polygon', 'radius', 0.0D, 'points', {box}), named_struct('op_idx', 1, 'mode', 'erase', 'shape', 'stroke', 'radius', 1.0D, 'points', {line})))"))


@query(
    "apply_annotation_ops",
    CELLS
    + f", o AS (SELECT *, CASE WHEN blocked = 1 THEN 0 WHEN abs(row - {BOX['line']}) <= 1 THEN 0 WHEN row BETWEEN {BOX['y0']} AND {BOX['y1']} AND col BETWEEN {BOX['x0']} AND {BOX['x1']} THEN 1 ELSE caution END AS c FROM cells) SELECT sample_id, row, col, c AS caution, CASE WHEN blocked = 1 THEN 2 WHEN c = 1 THEN 1 ELSE 0 END AS y_class FROM o",
)
def annotate(spark: SparkSession, d: str) -> DataFrame:
    return S.apply_annotation_ops(cells_of(spark, d), ops(spark, d), 8, 8).select("sample_id", "row", "col", "caution", "y_class")


@query(
    "import_label_shapes",
    CELLS
    + f", k AS (SELECT DISTINCT sample_id FROM cells WHERE sample_id % 2 = 0) SELECT concat('t', CAST(sample_id AS VARCHAR)) AS timestamp, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM k, range(0, 8) a(r), range(0, 8) b(c) WHERE r BETWEEN {BOX['y0']} AND {BOX['y1']} AND c BETWEEN {BOX['x0']} AND {BOX['x1']}",
)
def imported(spark: SparkSession, d: str) -> DataFrame:
    mapping = cells_of(spark, d).select("sample_id").distinct().select(F.concat(F.lit("f"), F.col("sample_id").cast("string")).alias("file"), F.concat(F.lit("t"), F.col("sample_id").cast("string")).alias("timestamp"))
    shapes = ops(spark, d).where("op_idx = 0 AND sample_id % 2 = 0").select(F.concat(F.lit("f"), F.col("sample_id").cast("string")).alias("file"), F.lit("rectangle").alias("shape"), "radius", "points")
    return S.import_label_shapes(mapping, shapes, 8, 8)[0]


#: Four series of maps, a slice every seven hours; uneven latitudes, even longitudes.
REGRID = (
    CELLS
    + """, g AS (SELECT sample_id % 4 AS series, TIMESTAMP '2024-01-01' + INTERVAL 7 HOUR * (sample_id // 4) AS ts, row, col, ice_conc AS value FROM cells), slices AS (SELECT DISTINCT series, ts FROM g),
    t AS (SELECT event_id AS target_id, event_id % 4 AS series, ts, 60e0 + user_id % 40 AS lat, -10e0 + value / 10 AS lon FROM events),
    n AS (SELECT t.*, s.ts AS slice_ts, row_number() OVER (PARTITION BY target_id ORDER BY abs(epoch_us(s.ts) - epoch_us(t.ts)), s.ts) AS i FROM t JOIN slices s USING (series)),
    r AS (SELECT *, CAST(least(greatest(floor(sqrt(greatest(lat - 62, 0e0))), 0), 6) AS INTEGER) AS y, CAST(least(greatest(floor(lon / 5), 0), 6) AS INTEGER) AS x FROM n WHERE i = 1),
    w AS (SELECT *, (lat - 62 - y * y) / (2 * y + 1) AS dy, lon / 5 - x AS dx FROM r)\n"""
)


@query(
    "regrid",
    REGRID
    + "SELECT w.series, target_id, slice_ts, round((1 - dy) * ((1 - dx) * a.value + dx * b.value) + dy * ((1 - dx) * c.value + dx * e.value), 4) AS value FROM w "
    + " ".join(f"JOIN g {k} ON {k}.series = w.series AND {k}.ts = slice_ts AND {k}.row = y + {i} AND {k}.col = x + {j}" for k, i, j in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("e", 1, 1))),
)
def regridded_slices(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(7 * F.floor(F.col("sample_id") / 4)).cast("int"))
    field = cells_of(spark, d).select((F.col("sample_id") % 4).alias("series"), ts.alias("ts"), "row", "col", F.col("ice_conc").alias("value"))
    axes = spark.range(8).select(F.explode(F.expr("array(struct('lat' AS axis, 62D + id * id AS value), struct('lon' AS axis, 5D * id AS value))")).alias("a"), F.col("id").cast("int").alias("idx")).select("a.axis", "idx", "a.value")
    targets = e.select(F.col("event_id").alias("target_id"), (F.col("event_id") % 4).alias("series"), F.col("ts").cast("timestamp").alias("ts"), (60.0 + F.col("user_id") % 40).alias("lat"), (-10 + F.col("value") / 10).alias("lon"))
    return rounded(P.regrid(field, axes, targets, "series"), "value", digits=4)


@query("bbox_targets", "SELECT sample_id, i AS target_id, round(86 - (i // 4) * 26e0 / 2, 6) AS lat, round(-180 + (i % 4) * 360e0 / 3, 6) AS lon FROM (SELECT DISTINCT vec_id // 5 AS sample_id FROM embeddings), range(0, 12) r(i)")
def boxed(spark: SparkSession, d: str) -> DataFrame:
    targets = F.broadcast(R.bbox_targets(spark, "-180,60,180,86", 4, 3))  # 12 rows
    return rounded(cells_of(spark, d).select("sample_id").distinct().crossJoin(targets), "lat", "lon", digits=6)


@query(
    "tile_targets",
    """WITH t AS (SELECT DISTINCT 3 AS z, user_id % 8 AS x, CAST(floor(value / 100) AS BIGINT) % 8 AS y FROM events)
    SELECT z, x, y, CAST(i AS INTEGER) AS target_id, round(degrees(atan(sinh(pi() * (1 - 2 * (y + (i // 4 + 0.5e0) / 4) / 8)))), 6) AS lat, round((x + (i % 4 + 0.5e0) / 4) / 8 * 360 - 180, 6) AS lon FROM t, range(0, 16) r(i)""",
)
def tiled(spark: SparkSession, d: str) -> DataFrame:
    tiles = spark.read.parquet(f"{d}/events.parquet").select(F.lit(3).alias("z"), (F.col("user_id") % 8).alias("x"), (F.floor(F.col("value") / 100) % 8).alias("y")).distinct()
    return rounded(R.tile_targets(tiles, 4), "lat", "lon", digits=6)


@query("blocked_from_bathy", CELLS + "SELECT sample_id, row, col, CASE WHEN bathy IS NULL OR isnan(bathy) OR bathy >= 0 THEN 1 ELSE 0 END AS blocked FROM cells")
def shallow(spark: SparkSession, d: str) -> DataFrame:
    return cells_of(spark, d).select("sample_id", "row", "col", R.blocked_from_bathy(F.col("bathy"), 0.0).cast("int").alias("blocked"))


@query("calibrate", "SELECT event_id, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.7e0)), 6) AS confidence FROM (SELECT event_id, least(greatest(1 - value / 500, 1e-6), 1 - 1e-6) AS p FROM events)")
def calibrated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.read.parquet(f"{d}/events.parquet").select("event_id", L.calibrate(1 - F.col("value") / 500, 1.7).alias("confidence")), "confidence", digits=6)


@query(
    "calibration_profile",
    PAIRS
    + """, t AS (SELECT k, exp(ln(0.2e0) + (ln(8e0) - ln(0.2e0)) * k / 120) AS t FROM range(0, 121) r(k)), q AS (SELECT k, t, outcome, least(greatest(1 / (1 + exp(-ln(p / (1 - p)) / t)), 1e-6), 1 - 1e-6) AS q FROM p, t),
    l AS (SELECT k, t, avg(-ln(CASE WHEN outcome = 1 THEN q ELSE 1 - q END)) AS nll FROM q GROUP BY 1, 2), f AS (SELECT t FROM l ORDER BY nll, k LIMIT 1),
    a AS (SELECT least(greatest(1 / (1 + exp(-ln(p / (1 - p)) / (SELECT t FROM f))), 1e-6), 1 - 1e-6) AS p, outcome FROM p),
    u AS (SELECT 0.02e0 + (0.98e0 - 0.02e0) * k / 96 AS tau FROM range(0, 97) r(k)), s AS (SELECT tau, count(*) AS n, 1 - avg(outcome) AS error, count(*) / (SELECT count(*) FROM a) AS coverage FROM u JOIN a ON 1 - p <= tau GROUP BY 1),
    c AS (SELECT * FROM (SELECT 0.1e0 AS target) LEFT JOIN s ON error <= target ORDER BY coverage DESC NULLS LAST, tau DESC LIMIT 1),
    e AS (SELECT n, sum(gap) / sum(k) AS ece, sum(b) / sum(k) AS brier FROM (SELECT n, bin, count(*) AS k, abs(sum(p) - sum(outcome)) AS gap, sum(pow(p - outcome, 2)) AS b FROM (SELECT *, """
    + " + ".join(f"CASE WHEN p >= {k} / 15e0 THEN 1 ELSE 0 END" for k in range(1, 15))
    + """ AS bin FROM (SELECT 'before' AS n, p, outcome FROM p UNION ALL SELECT 'after', p, outcome FROM a)) GROUP BY 1, 2) GROUP BY 1)
    SELECT 'v1' AS model_version, round(t, 5) AS temperature, round(least(greatest(coalesce(tau, 1e0), 0.05e0), 0.98e0), 5) AS uncertainty_threshold, 0.35e0 AS uplift_scale, target AS target_error_rate, round(coalesce(coverage, 0e0), 5) AS coverage, round(coalesce(error, 1e0), 5) AS expected_error,
    round(x.ece, 5) AS ece_before, round(y.ece, 5) AS ece_after, round(x.brier, 5) AS brier_before, round(y.brier, 5) AS brier_after FROM f, c, e x, e y WHERE x.n = 'before' AND y.n = 'after'""",
)
def profiled(spark: SparkSession, d: str) -> DataFrame:
    out = L.calibration_profile(adapt(spark, d, "calibration_pairs"), model_version="v1")
    return rounded(out, "temperature", "uncertainty_threshold", "coverage", "expected_error", "ece_before", "ece_after", "brier_before", "brier_after")


@query(
    "regrid_linear",
    CELLS
    + """, m AS (SELECT max(sample_id) + 1 AS maps FROM cells), g AS (SELECT sample_id, row, col, ice_conc AS value FROM cells), t AS (SELECT event_id % maps AS sample_id, event_id AS target_id, user_id * 0.11e0 / 2 AS y, (value / 40 - 1) / 2 AS x FROM events, m),
    r AS (SELECT *, CAST(least(greatest(floor(y), 0), 6) AS INTEGER) AS r, CAST(least(greatest(floor(x), 0), 6) AS INTEGER) AS c FROM t)
    SELECT r.sample_id, target_id, round((1 - y + r.r) * ((1 - x + r.c) * a.value + (x - r.c) * b.value) + (y - r.r) * ((1 - x + r.c) * e.value + (x - r.c) * f.value), 4) AS value FROM r """
    + " ".join(f"JOIN g {k} ON {k}.sample_id = r.sample_id AND {k}.row = r.r + {i} AND {k}.col = r.c + {j}" for k, i, j in (("a", 0, 0), ("b", 0, 1), ("e", 1, 0), ("f", 1, 1))),
)
def regridded(spark: SparkSession, d: str) -> DataFrame:
    """Targets are dealt to the maps by their number, so every map has its part."""
    grid = cells_of(spark, d).select("sample_id", "row", "col", F.col("ice_conc").alias("value"))
    maps = grid.agg((F.max("sample_id") + 1).alias("maps"))
    targets = spark.read.parquet(f"{d}/events.parquet").crossJoin(F.broadcast(maps))  # one row
    targets = targets.select((F.col("event_id") % F.col("maps")).alias("sample_id"), F.col("event_id").alias("target_id"), (F.col("user_id") * 0.11).alias("y"), (F.col("value") / 40 - 1).alias("x"))
    return rounded(P.regrid_linear(grid, 2.0, targets, "sample_id"), "value", digits=4)


def simplified_sql(max_turn: float | None) -> str:
    """Greedy simplification by a recursive CTE: all pairs of points that see each other, then for each step (the point before, the point now) the last one that may follow."""
    angle = "0e0" if max_turn is None else "CASE WHEN (a.row = b.row AND a.col = b.col) OR (b.row = c.row AND b.col = c.col) THEN 0e0 ELSE degrees(acos(greatest(-1e0, least(1e0, ((b.row - a.row) * (c.row - b.row) + (b.col - a.col) * (c.col - b.col)) / (sqrt(pow(b.row - a.row, 2) + pow(b.col - a.col, 2)) * sqrt(pow(c.row - b.row, 2) + pow(c.col - b.col, 2))))))) END"
    return (
        CELLS.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", r AS (SELECT user_id % 50 AS ts, user_id AS route_id, event_id AS seq, CAST(event_id % 8 AS INTEGER) AS row, CAST(floor(value) AS INTEGER) % 8 AS col, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        blocked_ AS (SELECT sample_id AS ts, row, col FROM cells WHERE blocked = 1),
        hit AS (SELECT DISTINCT a.route_id, a.i, c.i AS j FROM r a JOIN r c ON a.route_id = c.route_id AND c.i > a.i JOIN blocked_ b ON b.ts = a.ts AND b.row BETWEEN least(a.row, c.row) AND greatest(a.row, c.row) AND b.col BETWEEN least(a.col, c.col) AND greatest(a.col, c.col)
          AND 2 * abs((c.col - a.col) * (b.row - a.row) - (c.row - a.row) * (b.col - a.col)) <= abs(c.col - a.col) + abs(c.row - a.row)),
        pairs AS (SELECT a.route_id, a.i, c.i AS j, hit.i IS NULL AS clear FROM r a JOIN r c ON a.route_id = c.route_id AND c.i > a.i LEFT JOIN hit ON hit.route_id = a.route_id AND hit.i = a.i AND hit.j = c.i),
        turns AS (SELECT b.route_id, a.i AS before, b.i, c.i AS j FROM r b JOIN pairs p ON p.route_id = b.route_id AND p.i = b.i AND p.clear JOIN r c ON c.route_id = b.route_id AND c.i = p.j JOIN r a ON a.route_id = b.route_id AND a.i < b.i WHERE {angle} <= {max_turn or 360}
          UNION ALL SELECT route_id, 0, i, j FROM pairs WHERE i = 1 AND clear),
        next_ AS (SELECT route_id, before, i, max(j) AS j FROM turns GROUP BY 1, 2, 3),
        walk AS (SELECT route_id, n, CAST(0 AS BIGINT) AS before, CAST(1 AS BIGINT) AS i FROM r WHERE i = 1 UNION ALL SELECT w.route_id, w.n, w.i, greatest(coalesce(x.j, 0), w.i + 1) FROM walk w LEFT JOIN next_ x ON x.route_id = w.route_id AND x.before = w.before AND x.i = w.i WHERE w.i < w.n),
        bad AS (SELECT DISTINCT w.route_id FROM walk w JOIN pairs p ON p.route_id = w.route_id AND p.i = w.before AND p.j = w.i AND NOT p.clear)
        SELECT ts, r.route_id, seq, row, col, bad.route_id IS NOT NULL AS fallback FROM r LEFT JOIN bad ON bad.route_id = r.route_id WHERE bad.route_id IS NOT NULL OR EXISTS (SELECT 1 FROM walk w WHERE w.route_id = r.route_id AND w.i = r.i)"""
    )


def simplified_of(spark: SparkSession, d: str, max_turn: float | None) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    routes = e.select((F.col("user_id") % 50).alias("ts"), F.col("user_id").alias("route_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 8).cast("int").alias("row"), (F.floor("value") % 8).cast("int").alias("col"))
    return P.simplify_routes(routes, cells_of(spark, d).where("blocked = 1").select(F.col("sample_id").alias("ts"), "row", "col"), max_turn=max_turn)


@query("simplify_routes", simplified_sql(None))
def simplified(spark: SparkSession, d: str) -> DataFrame:
    return simplified_of(spark, d, None)


@query("simplify_routes_turn", simplified_sql(110.0))
def simplified_by_turn(spark: SparkSession, d: str) -> DataFrame:
    return simplified_of(spark, d, 110.0)


@query("flatten_report", BENCH + " UNION ALL ".join(f"SELECT run_id, 'metrics' AS section, '{f}' AS field, CAST(CAST({c} AS BIGINT) AS VARCHAR) AS value FROM bench" for f, c in (("time.ms", "floor(runtime_ms)"), ("count", "replan_count"))) + " UNION ALL SELECT run_id, 'tags', '[0]', mode FROM bench UNION ALL SELECT run_id, 'tags', '[1]', planner FROM bench")
def flattened(spark: SparkSession, d: str) -> DataFrame:
    b = adapt(spark, d, "bench").select("run_id", F.struct(F.struct(F.floor("runtime_ms").alias("ms")).alias("time"), F.col("replan_count").alias("count")).alias("metrics"), F.array("mode", "planner").alias("tags"))
    return flatten_report(b, ["metrics", "tags"], ["run_id"])


HASHED = "concat('ds-', count(*), '-', left(sha1(CAST(sum(CAST(concat('0x', left(sha1(line), 12)) AS BIGINT)) AS VARCHAR)), 12))"


@query("dataset_version", f"WITH r AS ({ORACLES['dataset_registry']}) SELECT {HASHED} AS version FROM (SELECT concat_ws('|', CAST(sample_id AS VARCHAR), CAST(completeness_score AS VARCHAR), CAST(is_complete AS VARCHAR)) AS line FROM r)")
def version(spark: SparkSession, d: str) -> DataFrame:
    return C.dataset_version(registry(spark, d), ["sample_id", "completeness_score", "is_complete"])


REGISTERED = "SELECT concat('2024-0', CAST(doc_id % 9 + 1 AS VARCHAR(2)), '-0', CAST(doc_id % 8 + 1 AS VARCHAR(2)), '_00') AS timestamp, source, lang AS product_id, n_chars > 500 AS is_complete FROM {documents}"


@query(
    "registry_summary",
    f"""WITH r AS ({REGISTERED.format(documents="documents")}), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_complete) AS k, {HASHED} AS v FROM (SELECT *, concat_ws('|', timestamp, source, product_id, CASE WHEN is_complete THEN '1' ELSE '0' END) AS line FROM r)),
    c AS (SELECT 'month' AS dimension, left(timestamp, 7) AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'product_id', coalesce(product_id, 'unknown'), count(*) FROM r GROUP BY 2)
    SELECT dimension, value, c.n, round(c.n / t.n, 6) AS rate, t.n AS total_samples, t.k AS complete_samples, round(t.k / t.n, 6) AS complete_rate, v AS data_version FROM c, t""",
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    return C.registry_summary(spark.sql(REGISTERED, documents=spark.read.parquet(f"{d}/documents.parquet")))


@query("worst_status", LAYERS + "SELECT CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM layer_files WHERE w = 16")
def worst(spark: SparkSession, d: str) -> DataFrame:
    return B.worst_status(adapt(spark, d, "layer_files").select(F.when(F.col("w") == 16, "FAIL").otherwise("PASS").alias("status")))


@query("moments", ctes("bench") + "SELECT planner, count(runtime_ms) AS n, round(avg(runtime_ms), 4) AS mean, round(var_samp(runtime_ms), 2) AS variance FROM bench WHERE status = 'ok' GROUP BY 1")
def moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(B.moments(adapt(spark, d, "bench"), "runtime_ms"), "mean", digits=4), "variance", digits=2)


@query("uncertainty_penalty", "SELECT event_id, round(CASE WHEN value / 500 > 0.4e0 THEN 0.5e0 * (value / 500 - 0.4e0) / 0.6e0 ELSE 0e0 END, 7) AS penalty FROM events")
def penalty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.read.parquet(f"{d}/events.parquet").select("event_id", L.uncertainty_penalty(F.col("value") / 500, 0.4, 0.5).alias("penalty")), "penalty", digits=7)
