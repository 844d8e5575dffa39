"""Queries over gridded layers and label curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import raster as R
from .adapters import adapt, ctes
from .experiments import rounded
from .registry import query

CELLS = ctes("cells")


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    return adapt(spark, d, "cells")


@query("explode_raster", "SELECT vec_id, CAST(floor(p / 8) AS INTEGER) AS row, CAST(p % 8 AS INTEGER) AS col, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS v FROM embeddings)")
def exploded(spark: SparkSession, d: str) -> DataFrame:
    return R.explode_raster(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("values")), 8)


@query("pack_raster", "SELECT vec_id, sha256(string_agg(CAST(CAST(round(CAST(v AS DOUBLE) * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY p)) AS packed FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def packed(spark: SparkSession, d: str) -> DataFrame:
    out = R.pack_raster(exploded(spark, d), ["vec_id"])
    return out.select("vec_id", F.sha2(F.array_join(F.transform("values", lambda v: F.round(v * 100000).cast("long").cast("string")), ","), 256).alias("packed"))


@query("merge_labels", CELLS + "SELECT sample_id, row, col, blocked, CASE WHEN blocked = 1 THEN 2 WHEN caution = 1 THEN 1 ELSE 0 END AS y FROM cells")
def merged(spark: SparkSession, d: str) -> DataFrame:
    return cells_of(spark, d).select("sample_id", "row", "col", "blocked", R.merge_labels(F.col("blocked"), F.col("caution")).alias("y"))


@query(
    "feature_stack",
    CELLS
    + """, heat AS (SELECT sample_id, row, col, ais_heatmap FROM cells WHERE sample_id % 3 <> 0), b AS (SELECT sample_id, row, col, bathy FROM cells WHERE sample_id % 2 = 0)
    SELECT sample_id, row, col, round(ice_conc, 6) AS ice_conc, round(heat.ais_heatmap, 6) AS ais_heatmap, round(coalesce(b.bathy, 0e0), 6) AS bathy, b.bathy IS NOT NULL AS has_bathy FROM cells JOIN heat USING (sample_id, row, col) LEFT JOIN b USING (sample_id, row, col)""",
)
def stacked(spark: SparkSession, d: str) -> DataFrame:
    c = cells_of(spark, d)
    k = ["sample_id", "row", "col"]
    out = R.feature_stack(c.select(*k, "ice_conc"), c.where("sample_id % 2 = 0").select(*k, "bathy"), c.where("sample_id % 3 <> 0").select(*k, "ais_heatmap"))
    return rounded(out, "ice_conc", "ais_heatmap", "bathy", digits=6)




def normal(column: str, into: str, source: str = "cells") -> str:
    v = f"(CASE WHEN blocked = 0 THEN {column} END)"
    q = f"SELECT sample_id, quantile_cont({v}, 0.05) AS lo, quantile_cont({v}, 0.95) AS hi FROM {source} GROUP BY 1"
    return f"(SELECT c.sample_id, row, col, coalesce(CASE WHEN hi - lo >= 1e-6 THEN least(greatest(({column} - lo) / (hi - lo), 0e0), 1e0) ELSE 0e0 END, 0e0) AS {into} FROM {source} c JOIN ({q}) q USING (sample_id))"


@query("quantile_normalize", CELLS + f"SELECT sample_id, row, col, round(x, 5) AS wave FROM {normal('wave_hs', 'x')}")
def scaled(spark: SparkSession, d: str) -> DataFrame:
    return R.quantile_normalize(cells_of(spark, d), "wave_hs", mask=F.col("blocked") == 0, into="wave").select("sample_id", "row", "col", F.round("wave", 5).alias("wave"))


RISK = (
    CELLS
    + f""", winds AS (SELECT *, sqrt(wind_u10 * wind_u10 + wind_v10 * wind_v10) AS speed FROM cells), tops AS (SELECT sample_id, max(abs(ice_conc)) AS top FROM cells GROUP BY 1),
    comp AS (SELECT c.sample_id, row, col, blocked, CASE pred WHEN 2 THEN 1e0 WHEN 1 THEN 0.65e0 ELSE 0e0 END AS unet_pred, least(greatest(unc, 0e0), 1e0) AS uncertainty,
      least(greatest(CASE WHEN top > 2 THEN ice_conc / 100 ELSE ice_conc END, 0e0), 1e0) AS ice, wave, wind, 1 - ais AS ais_inverse
      FROM cells c JOIN tops USING (sample_id) JOIN {normal('wave_hs', 'wave')} USING (sample_id, row, col) JOIN {normal('speed', 'wind', 'winds')} USING (sample_id, row, col) JOIN {normal('ais_heatmap', 'ais')} USING (sample_id, row, col))\n"""
)
NAMES = list(R.RISK_WEIGHTS)


@query("risk_components", RISK + "SELECT sample_id, row, col, " + ", ".join(f"round({n}, 5) AS {n}" for n in NAMES) + " FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.risk_components(cells_of(spark, d)).select("sample_id", "row", "col", *NAMES), *NAMES)


@query(
    "fuse_risk",
    RISK
    + ", f AS (SELECT *, "
    + " + ".join(f"{n} * {w}e0" for n, w in R.RISK_WEIGHTS.items())
    + " AS m, ("
    + " + ".join(NAMES)
    + ") / 6 AS p FROM comp), g AS (SELECT *, sqrt(("
    + " + ".join(f"pow({n} - p, 2)" for n in NAMES)
    + """) / 6) AS s FROM f)
    SELECT sample_id, row, col, round(s, 5) AS risk_std, round(CASE WHEN blocked = 1 THEN 1e0 ELSE least(greatest(m, 0e0), 1e0) END, 5) AS risk_mean, round(CASE WHEN blocked = 1 THEN 1e0 ELSE least(greatest(m + 1.28155e0 * s, 0e0), 1e0) END, 5) AS risk_p90 FROM g""",
)
def fused(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.fuse_risk(R.risk_components(cells_of(spark, d))).select("sample_id", "row", "col", "risk_std", "risk_mean", "risk_p90"), "risk_std", "risk_mean", "risk_p90")


@query(
    "layer_stats",
    CELLS
    + " UNION ALL ".join(f"SELECT sample_id, '{c}' AS layer, round(min({c}), 5) AS min, round(max({c}), 5) AS max, round(avg({c}), 5) AS mean, round(quantile_cont({c}, 0.5), 5) AS p50, round(quantile_cont({c}, 0.9), 5) AS p90 FROM cells GROUP BY 1" for c in ("wave_hs", "ice_conc")),
)
def stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.layer_stats(cells_of(spark, d), ["wave_hs", "ice_conc"]), "min", "max", "mean", "p50", "p90")


@query(
    "class_histogram",
    CELLS
    + "SELECT sample_id, "
    + ", ".join(f"count(*) FILTER (WHERE pred = {k}) AS n{k}, round(count(*) FILTER (WHERE pred = {k}) / count(*), 5) AS ratio{k}" for k in range(3))
    + ", round(avg(unc), 5) AS unc_mean, round(quantile_cont(unc, 0.9), 5) AS unc_p90 FROM cells GROUP BY 1",
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.class_histogram(cells_of(spark, d)), "ratio0", "ratio1", "ratio2", "unc_mean", "unc_p90")


@query("channel_stats", CELLS + " UNION ALL ".join(f"SELECT '{c}' AS channel, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std FROM cells WHERE row % 2 = 0 AND col % 2 = 0" for c in ("wave_hs", "ice_conc", "wind_u10")))
def channels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.channel_stats(cells_of(spark, d), ["wave_hs", "ice_conc", "wind_u10"], 2), "mean", "std")


@query("class_weights", CELLS + ", c AS (SELECT pred AS cls, count(*) AS n FROM cells WHERE row % 4 = 0 AND col % 4 = 0 GROUP BY 1), i AS (SELECT cls, (SELECT sum(n) FROM c) / n AS v FROM c) SELECT cls, round(v / (SELECT avg(v) FROM i), 5) AS weight FROM i")
def weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.class_weights(cells_of(spark, d), "pred", 4), "weight")


TRUTH = CELLS + ", t AS (SELECT *, CASE WHEN blocked = 1 THEN 2 WHEN caution = 1 THEN 1 ELSE 0 END AS y FROM cells)\n"


def with_truth(spark: SparkSession, d: str) -> DataFrame:
    return cells_of(spark, d).withColumn("y", R.merge_labels(F.col("blocked"), F.col("caution")))


@query(
    "segmentation_scores",
    TRUTH
    + ", s AS (SELECT sample_id, "
    + ", ".join(f"CASE WHEN count(*) FILTER (WHERE y = {k} OR pred = {k}) > 0 THEN count(*) FILTER (WHERE y = {k} AND pred = {k}) / count(*) FILTER (WHERE y = {k} OR pred = {k}) END AS iou{k}" for k in range(3))
    + """, count(*) FILTER (WHERE y = pred) / count(*) AS accuracy FROM t GROUP BY 1)
    SELECT sample_id, round(iou0, 5) AS iou0, round(iou1, 5) AS iou1, round(iou2, 5) AS iou2, round((coalesce(iou0, 0e0) + coalesce(iou1, 0e0) + coalesce(iou2, 0e0)) / (CAST(iou0 IS NOT NULL AS INT) + CAST(iou1 IS NOT NULL AS INT) + CAST(iou2 IS NOT NULL AS INT)), 5) AS miou, round(accuracy, 5) AS accuracy FROM s""",
)
def segmentation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.segmentation_scores(with_truth(spark, d)), "iou0", "iou1", "iou2", "miou", "accuracy")


AROUND = "SELECT a.sample_id, a.row, a.col, {0} FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3"


@query("stencil3", CELLS + AROUND.format("round(avg(b.unc), 5) AS unc_avg"))
def blurred(spark: SparkSession, d: str) -> DataFrame:
    return R.stencil3(cells_of(spark, d), "unc", "avg").select("sample_id", "row", "col", F.round("unc_avg", 5).alias("unc_avg"))


@query("near_blocked", CELLS + AROUND.format("CASE WHEN max(b.blocked) = 1 AND max(CASE WHEN a.row = b.row AND a.col = b.col THEN a.blocked END) = 0 THEN 1 ELSE 0 END AS near_blocked"))
def beside_blocked(spark: SparkSession, d: str) -> DataFrame:
    return R.near_blocked(cells_of(spark, d)).select("sample_id", "row", "col", "near_blocked")


@query("class_edges", CELLS + "SELECT a.sample_id, a.row, a.col, CAST(max(CASE WHEN abs(a.row - b.row) + abs(a.col - b.col) = 1 AND a.pred <> b.pred THEN 1 ELSE 0 END) AS INTEGER) AS edge FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3")
def edges(spark: SparkSession, d: str) -> DataFrame:
    return R.class_edges(cells_of(spark, d)).select("sample_id", "row", "col", "edge")


@query("majority_smooth", CELLS + AROUND.format("CASE WHEN sum(b.caution) >= 2 AND max(CASE WHEN a.row = b.row AND a.col = b.col THEN a.caution END) = 1 THEN 1 ELSE 0 END AS smooth"))
def smoothed(spark: SparkSession, d: str) -> DataFrame:
    return R.majority_smooth(cells_of(spark, d), "caution", 2).select("sample_id", "row", "col", "smooth")


CHANGES = CELLS + """, x AS (SELECT *, lag(sample_id) OVER w AS p, abs(blocked - lag(blocked) OVER w) > 1e-6 AS b, abs(unc - lag(unc) OVER w) > 1e-6 AS u FROM cells WINDOW w AS (PARTITION BY row, col ORDER BY sample_id)),
    y AS (SELECT sample_id, row, col, coalesce(b, true) AS b, coalesce(u, true) AS u FROM x WHERE p IS NOT NULL)\n"""


@query("cell_changes", CHANGES + "SELECT sample_id, count(*) FILTER (WHERE b) AS blocked_changed, count(*) FILTER (WHERE u) AS unc_changed, count(*) FILTER (WHERE b OR u) AS any_changed FROM y GROUP BY 1")
def changes(spark: SparkSession, d: str) -> DataFrame:
    return R.cell_changes(cells_of(spark, d), ["blocked", "unc"])


@query(
    "changed_edges",
    CELLS
    + """, c AS (SELECT sample_id, row, col FROM cells WHERE blocked = 1), o AS (SELECT a.v AS dr, b.v AS dc FROM (SELECT unnest([-1, 0, 1]) AS v) a, (SELECT unnest([-1, 0, 1]) AS v) b WHERE a.v <> 0 OR b.v <> 0),
    e AS (SELECT sample_id, row AS r1, col AS c1, row + dr AS r2, col + dc AS c2 FROM c, o WHERE row + dr BETWEEN 0 AND 7 AND col + dc BETWEEN 0 AND 7)
    SELECT sample_id, count(*) AS changed_edges FROM (SELECT * FROM e UNION SELECT sample_id, r2, c2, r1, c1 FROM e) GROUP BY 1""",
)
def touched_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.changed_edges(cells_of(spark, d).where("blocked = 1"), 8, 8)


TARGETS = ", t AS (SELECT DISTINCT sample_id, k AS target_id, k * 0.7e0 AS y, k * 0.3e0 + 1 AS x FROM cells, range(0, 10) r(k))\n"


def targets(spark: SparkSession, d: str) -> DataFrame:
    return cells_of(spark, d).select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("target_id")).select("sample_id", "target_id", (F.col("target_id") * 0.7).alias("y"), (F.col("target_id") * 0.3 + 1).alias("x"))


@query(
    "resample_bilinear",
    CELLS
    + TARGETS
    + """, w AS (SELECT t.sample_id, target_id, greatest(0e0, 1 - abs(c.row - y)) * greatest(0e0, 1 - abs(c.col - x)) AS w, wave_hs FROM t JOIN cells c ON c.sample_id = t.sample_id AND abs(c.row - y) < 1 AND abs(c.col - x) < 1)
    SELECT sample_id, target_id, round(sum(w * wave_hs) / sum(w), 5) AS value FROM w WHERE w > 0 GROUP BY 1, 2""",
)
def bilinear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.resample(cells_of(spark, d), targets(spark, d), "wave_hs"), "value")


@query("resample_nearest", CELLS + TARGETS + "SELECT t.sample_id, target_id, round(wave_hs, 5) AS value FROM t JOIN cells c ON c.sample_id = t.sample_id AND c.row = floor(y + 0.5) AND c.col = floor(x + 0.5)")
def nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.resample(cells_of(spark, d), targets(spark, d), "wave_hs", "nearest"), "value")


@query("merge_masks", CELLS + "SELECT sample_id, row, col, CASE WHEN sample_id % 3 = 0 THEN caution WHEN sample_id % 3 = 1 THEN blocked ELSE greatest(caution, blocked) END AS mask, CASE sample_id % 3 WHEN 0 THEN 'human_only' WHEN 1 THEN 'suggest_only' ELSE 'merged' END AS origin FROM cells")
def masks(spark: SparkSession, d: str) -> DataFrame:
    c = cells_of(spark, d)
    k = ["sample_id", "row", "col"]
    return R.merge_masks(c.where("sample_id % 3 <> 1").select(*k, F.col("caution").alias("mask")), c.where("sample_id % 3 <> 0").select(*k, F.col("blocked").alias("mask")))


@query(
    "overlay_channels",
    CELLS
    + """, l AS (SELECT sample_id, row, col, 'ice' AS channel, ice_conc AS v FROM cells UNION ALL SELECT sample_id, row, col, 'wave', wave_hs FROM cells)
    SELECT sample_id, row, col, channel, round(CASE WHEN channel = 'wave' AND sample_id % 2 = 0 THEN v + 1 ELSE v END, 5) AS value FROM l""",
)
def overlaid(spark: SparkSession, d: str) -> DataFrame:
    long = cells_of(spark, d).select("sample_id", "row", "col", F.col("ice_conc").alias("ice"), F.col("wave_hs").alias("wave")).unpivot(["sample_id", "row", "col"], ["ice", "wave"], "channel", "value")
    return rounded(R.overlay_channels(long, long.where("channel = 'wave' AND sample_id % 2 = 0").withColumn("value", F.col("value") + 1)), "value")


QUALITY = (
    TRUTH
    + ", q AS (SELECT sample_id, count(*) FILTER (WHERE y = 1) / count(*) AS caution_ratio, count(*) FILTER (WHERE y = 2) / count(*) AS blocked_ratio FROM t GROUP BY 1), r AS (SELECT *, CASE WHEN caution_ratio + blocked_ratio < 0.25e0 THEN 'foreground_ratio<0.25' ELSE '' END AS reasons FROM q)\n"
)


def quality_of(spark: SparkSession, d: str) -> DataFrame:
    return L.sample_quality(with_truth(spark, d), ["ice_conc", "wave_hs"], min_foreground=0.25)


@query("sample_quality", QUALITY + "SELECT sample_id, round(caution_ratio, 5) AS caution_ratio, round(blocked_ratio, 5) AS blocked_ratio, reasons, reasons = '' AS keep FROM r")
def quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality_of(spark, d).select("sample_id", "caution_ratio", "blocked_ratio", F.array_join("reasons", ",").alias("reasons"), "keep"), "caution_ratio", "blocked_ratio")


@query("reason_counts", QUALITY + "SELECT reasons AS reason, count(*) AS n FROM r WHERE reasons <> '' GROUP BY 1")
def reasons(spark: SparkSession, d: str) -> DataFrame:
    return L.reason_counts(quality_of(spark, d))


HARD = (
    TRUTH
    + """, e AS (SELECT sample_id, y, CAST(lead(y) OVER (PARTITION BY sample_id, row ORDER BY col) <> y AS INT) AS h, CAST(lead(y) OVER (PARTITION BY sample_id, col ORDER BY row) <> y AS INT) AS v FROM t),
    p AS (SELECT sample_id, avg(CAST(y = 0 AS INT)) AS p0, avg(CAST(y = 1 AS INT)) AS p1, avg(CAST(y = 2 AS INT)) AS p2, avg(h) AS eh, avg(v) AS ev FROM e GROUP BY 1),
    hard AS (SELECT sample_id, 0.45e0 * (CASE WHEN p0 > 0 THEN -p0 * ln(p0) ELSE 0 END + CASE WHEN p1 > 0 THEN -p1 * ln(p1) ELSE 0 END + CASE WHEN p2 > 0 THEN -p2 * ln(p2) ELSE 0 END) / ln(3e0) + 0.35e0 * (eh + ev) / 2 + 0.2e0 * least(1e0, 3 * (p1 + p2)) AS score FROM p)\n"""
)


@query("hard_sample_scores", HARD + "SELECT sample_id, round(score, 5) AS score FROM hard")
def hard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.hard_sample_scores(with_truth(spark, d)), "score")


@query(
    "hard_sample_weights",
    HARD
    + """, m AS (SELECT sample_id, score, score >= (SELECT quantile_cont(score, 0.8) FROM hard) AS hard FROM hard), n AS (SELECT count(*) FILTER (WHERE hard) AS nh, count(*) FILTER (WHERE NOT hard) AS ne FROM m)
    SELECT sample_id, round(score, 5) AS score, hard, round(CASE WHEN hard THEN 0.5e0 / nh ELSE 0.5e0 / ne END, 6) AS weight FROM m, n""",
)
def hard_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(L.hard_sample_weights(L.hard_sample_scores(with_truth(spark, d)), target=0.5), "score"), "weight", digits=6)


PAIRS = ctes("calibration_pairs") + ", p AS (SELECT least(greatest(confidence, 1e-6), 1 - 1e-6) AS p, outcome, 1 - confidence AS u FROM calibration_pairs)\n"
BINS = PAIRS + ", b AS (SELECT *, " + " + ".join(f"CASE WHEN p >= {k} / 15e0 THEN 1 ELSE 0 END" for k in range(1, 15)) + " AS bin FROM p)\n"


@query(
    "reliability_bins",
    BINS
    + """, g AS (SELECT bin, count(*) AS n, avg(p) AS c, avg(outcome) AS a FROM b GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(c, 0e0), 5) AS confidence_mean, round(coalesce(a, 0e0), 5) AS accuracy_mean, round(coalesce(abs(c - a), 0e0), 5) AS gap FROM range(0, 15) r(k) LEFT JOIN g ON g.bin = k""",
)
def reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.reliability_bins(adapt(spark, d, "calibration_pairs")), "confidence_mean", "accuracy_mean", "gap")


@query(
    "calibration_metrics",
    BINS
    + """, g AS (SELECT bin, count(*) AS n, abs(sum(p) - sum(outcome)) AS gap FROM b GROUP BY 1)
    SELECT count(*) AS n, round(avg(pow(p - outcome, 2)), 5) AS brier, round(avg(-(outcome * ln(p) + (1 - outcome) * ln(1 - p))), 5) AS nll, round((SELECT sum(gap) / sum(n) FROM g), 5) AS ece FROM b""",
)
def metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.calibration_metrics(adapt(spark, d, "calibration_pairs")), "brier", "nll", "ece")


@query(
    "fit_temperature",
    PAIRS
    + """, t AS (SELECT k, exp(ln(0.2e0) + (ln(8e0) - ln(0.2e0)) * k / 120) AS t FROM range(0, 121) r(k)),
    q AS (SELECT k, t, outcome, least(greatest(1 / (1 + exp(-ln(p / (1 - p)) / t)), 1e-6), 1 - 1e-6) AS q FROM p, t),
    l AS (SELECT k, t, avg(-ln(CASE WHEN outcome = 1 THEN q ELSE 1 - q END)) AS nll FROM q GROUP BY 1, 2)
    SELECT round(t, 5) AS temperature, round(nll, 5) AS nll FROM l ORDER BY l.nll, k LIMIT 1""",
)
def temperature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.fit_temperature(adapt(spark, d, "calibration_pairs")), "temperature", "nll")


@query(
    "uncertainty_thresholds",
    PAIRS
    + """, t AS (SELECT 0.02e0 + (0.98e0 - 0.02e0) * k / 96 AS tau FROM range(0, 97) r(k)), s AS (SELECT tau, count(*) AS n, 1 - avg(outcome) AS error, count(*) / (SELECT count(*) FROM p) AS coverage FROM t JOIN p ON u <= tau GROUP BY 1),
    g AS (SELECT unnest([0.05e0, 0.1e0, 0.15e0]) AS target), r AS (SELECT target, tau, coverage, error, row_number() OVER (PARTITION BY target ORDER BY coverage DESC NULLS LAST, tau DESC) AS i FROM g LEFT JOIN s ON error <= target)
    SELECT target, round(coalesce(tau, 1e0), 5) AS tau, round(coalesce(coverage, 0e0), 5) AS coverage, round(coalesce(error, 1e0), 5) AS error FROM r WHERE i = 1""",
)
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    pairs = adapt(spark, d, "calibration_pairs").select((1 - F.col("confidence")).alias("uncertainty"), "outcome")
    return rounded(L.uncertainty_thresholds(pairs), "tau", "coverage", "error")


@query("calibration_pairs", TRUTH + "SELECT sample_id, row, col, round(1 - unc, 6) AS confidence, CAST(pred = y AS INTEGER) AS outcome FROM t WHERE row % 2 = 0 AND col % 2 = 0")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    t = with_truth(spark, d)
    return rounded(L.calibration_pairs(t.select("sample_id", "row", "col", "y"), t.select("sample_id", "row", "col", "pred", "unc")), "confidence", digits=6)


@query(
    "suggest_mask",
    CELLS
    + """, q AS (SELECT sample_id, greatest(quantile_cont(unc, 0.9), 0.3e0) AS cut FROM cells WHERE blocked = 0 GROUP BY 1)
    SELECT sample_id, row, col, CASE WHEN blocked = 0 AND unc >= cut THEN 1 ELSE 0 END AS mask FROM cells LEFT JOIN q USING (sample_id)""",
)
def suggested(spark: SparkSession, d: str) -> DataFrame:
    return L.suggest_mask(cells_of(spark, d), 0.3, 0.1)


#: Every second sample is unlabelled; class probabilities from the uncertainty layer.
ACTIVE = (
    CELLS
    + """, u AS (SELECT sample_id, row, col, blocked, CASE WHEN sample_id % 2 = 0 THEN 0 ELSE caution END AS caution, ais_heatmap, 0.02e0 + 0.96e0 * unc AS p1 FROM cells),
    q AS (SELECT *, 0.7e0 * (1 - p1) AS p0, 0.3e0 * (1 - p1) AS p2 FROM u),
    g AS (SELECT *, CASE WHEN coalesce(lag(blocked) OVER a <> blocked, false) OR coalesce(lead(blocked) OVER a <> blocked, false) OR coalesce(lag(blocked) OVER b <> blocked, false) OR coalesce(lead(blocked) OVER b <> blocked, false) THEN 1 ELSE 0 END AS edge
      FROM q WHERE sample_id NOT IN (SELECT sample_id FROM q WHERE caution > 0) WINDOW a AS (PARTITION BY sample_id, row ORDER BY col), b AS (PARTITION BY sample_id, col ORDER BY row)),
    n AS (SELECT DISTINCT x.sample_id, x.row, x.col FROM g x JOIN g y ON x.sample_id = y.sample_id AND abs(x.row - y.row) + abs(x.col - y.col) <= 2 AND y.edge = 1),
    h AS (SELECT sample_id, quantile_cont(ais_heatmap, 0.05) AS lo, quantile_cont(ais_heatmap, 0.95) AS hi FROM g WHERE blocked = 0 GROUP BY 1),
    e AS (SELECT g.*, n.row IS NOT NULL AS near, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) AS entropy, CASE WHEN hi - lo >= 1e-6 THEN least(greatest((ais_heatmap - lo) / (hi - lo), 0e0), 1e0) ELSE 0e0 END AS traffic
      FROM g JOIN h USING (sample_id) LEFT JOIN n ON n.sample_id = g.sample_id AND n.row = g.row AND n.col = g.col WHERE blocked = 0),
    s AS (SELECT sample_id, avg(entropy) AS entropy_mean, quantile_cont(entropy, 0.95) AS entropy_p95, avg(1 - abs(p1 - 0.5e0) * 2) AS margin_mean, coalesce(avg(entropy) FILTER (WHERE near), avg(entropy)) AS near_unc,
      avg(CASE WHEN p1 > 0.6e0 THEN 1e0 ELSE 0e0 END) AS pred_ratio, avg(p1 * traffic) AS corridor_caution FROM e GROUP BY 1),
    r AS (SELECT *, 0.55e0 * entropy_p95 + 0.3e0 * entropy_mean + 0.15e0 * margin_mean AS unc, 0.6e0 * near_unc + 0.4e0 * corridor_caution AS imp FROM s),
    l AS (SELECT sample_id, avg(CASE WHEN caution > 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE blocked = 0) AS ratio FROM q GROUP BY 1 HAVING max(caution) > 0),
    m AS (SELECT quantile_cont(unc, 0.05) AS a1, quantile_cont(unc, 0.95) AS b1, quantile_cont(imp, 0.05) AS a2, quantile_cont(imp, 0.95) AS b2, (SELECT least(greatest(coalesce(median(ratio), 0.03e0), 0.005e0), 0.2e0) FROM l) AS target FROM r),
    scores AS (SELECT r.*, 0.55e0 * least(greatest((unc - a1) / (b1 - a1), 0e0), 1e0) + 0.3e0 * least(greatest((imp - a2) / (b2 - a2), 0e0), 1e0) + 0.15e0 * exp(-0.5e0 * pow((pred_ratio - target) / 0.025e0, 2)) AS score FROM r, m)\n"""
)
ACTIVE_COLUMNS = ("entropy_mean", "entropy_p95", "margin_mean", "near_unc", "pred_ratio", "corridor_caution", "score")


def with_probabilities(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_of(spark, d).withColumn("caution", F.expr("CASE WHEN sample_id % 2 = 0 THEN 0 ELSE caution END")).withColumn("p1", 0.02 + 0.96 * F.col("unc"))
    return cells.withColumn("p0", 0.7 * (1 - F.col("p1"))).withColumn("p2", 0.3 * (1 - F.col("p1")))


@query("active_learning_scores", ACTIVE + "SELECT sample_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ACTIVE_COLUMNS) + " FROM scores")
def active(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.active_learning_scores(with_probabilities(spark, d)), *ACTIVE_COLUMNS, digits=6)


@query("top_candidates", ACTIVE + "SELECT sample_id, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, sample_id LIMIT 10")
def top(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.top_candidates(L.active_learning_scores(with_probabilities(spark, d)), 10).select("sample_id", "score"), "score", digits=6)


@query(
    "drop_hard_train",
    """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'val' ELSE 'train' END AS split, o_totalprice / 1000 AS loss, (o_custkey % 100) / 100e0 AS iou FROM orders),
    m AS (SELECT avg(loss) AS a, stddev_pop(loss) AS b, avg(1 - iou) AS c, stddev_pop(1 - iou) AS e FROM s WHERE split = 'train'),
    w AS (SELECT id FROM s, m WHERE split = 'train' ORDER BY 0.65e0 * (loss - a) / b + 0.35e0 * (1 - iou - c) / e DESC, id LIMIT 100)
    SELECT id, split FROM s WHERE id NOT IN (SELECT id FROM w)""",
)
def without_hard(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "val").otherwise("train").alias("split"), (F.col("o_totalprice") / 1000).alias("loss"), ((F.col("o_custkey") % 100) / 100).alias("iou"))
    return L.drop_hard_train(s, 100, "id").select("id", "split")


@query("label_batches", "WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id, i // 25 AS batch, i % 25 AS place FROM l")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return L.label_batches(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet"), 25, "doc_id")


@query("assign_split", "SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y%m') IN ('199601', '199707') THEN 'val' ELSE 'train' END AS split FROM orders")
def split(spark: SparkSession, d: str) -> DataFrame:
    return L.assign_split(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate"), F.date_format("o_orderdate", "yyyyMM"), ["199601", "199707"], "o_orderkey").select("o_orderkey", "split")




@query(
    "review_runs",
    """WITH m AS (SELECT DISTINCT user_id % 7 AS run, user_id AS item FROM events), l AS (SELECT user_id AS item, arg_max(CASE event_type WHEN 'view' THEN 'accepted' ELSE 'needs_revision' END, event_id) AS decision FROM events WHERE event_type IN ('view', 'error') AND user_id % 5 <> 0 GROUP BY 1)
    SELECT run, count(*) AS items, count(*) FILTER (WHERE decision = 'accepted') AS accepted, count(*) FILTER (WHERE decision = 'needs_revision') AS needs_revision, count(*) FILTER (WHERE decision IS NULL) AS pending FROM m LEFT JOIN l USING (item) GROUP BY 1""",
)
def reviews(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    decisions = e.where("event_type IN ('view', 'error') AND user_id % 5 <> 0").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "accepted").otherwise("needs_revision").alias("decision"))
    return L.review_runs(e.select((F.col("user_id") % 7).alias("run"), F.col("user_id").alias("item")).distinct(), decisions)


@query(
    "review_queue",
    """WITH l AS (SELECT user_id AS item, arg_max(event_type, event_id) AS decision FROM events WHERE user_id % 3 = 0 GROUP BY 1), r AS (SELECT user_id AS item, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS rank FROM events GROUP BY 1)
    SELECT item, rank, coalesce(decision, 'pending') AS decision FROM (SELECT * FROM r ORDER BY rank, item LIMIT 60) LEFT JOIN l USING (item)""",
)
def queue(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    ranking = e.groupBy(F.col("user_id").alias("item")).agg(F.count(F.lit(1)).alias("n")).selectExpr("item", "CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS rank")
    return L.review_queue(ranking, e.where("user_id % 3 = 0").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("event_type").alias("decision")), 60)
