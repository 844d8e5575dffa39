"""Planner experiments: summaries, ranking, regression, strata, casebook, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import root_cause_tags, route_safety
from .selection import quantiles


def _ok() -> Column:
    return F.col("status") == "ok"


def bench_summary(bench: DataFrame) -> DataFrame:
    """Per mode and planner: runs, success, means and population deviations of the ok runs, stability, speed-up."""
    ok = lambda c: F.when(_ok(), c)
    signature = F.col("route_signature") if "route_signature" in bench.columns else F.lit(None).cast("string")
    by = bench.groupBy("mode", "planner").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(ok(F.lit(1))).alias("success"),
        *(F.avg(ok(F.col(c))).alias(f"avg_{n}") for c, n in (("runtime_ms", "runtime_ms"), ("distance_km", "distance_km"), ("caution_len_km", "caution_len_km"), ("risk_exposure", "risk_exposure"), ("route_cost_effective_km", "effective_cost_km"))),
        F.avg(ok(route_safety(F.col("distance_km"), F.col("caution_len_km")))).alias("avg_route_safety"),
        *(F.stddev_pop(ok(F.col(c))).alias(n) for c, n in (("distance_km", "distance_std_km"), ("risk_exposure", "risk_std"), ("runtime_ms", "runtime_std_ms"))),
        F.count_distinct(ok(F.nullif(signature, F.lit("")))).alias("route_signature_unique"),
    )
    out = by.withColumn("fail", F.col("runs") - F.col("success")).withColumn("success_rate", F.col("success") / F.col("runs"))
    return out.withColumn("stability_consistency", F.when(F.col("success") > 0, 1 / F.greatest(F.col("route_signature_unique"), F.lit(1))))


def speed_up(summary: DataFrame, slow: str, fast: str) -> DataFrame:
    """One row: mean dynamic run times of two planners and their ratio; none if either is missing."""
    dynamic = summary.where("mode = 'dynamic'").agg(F.max(F.when(F.col("planner") == slow, F.col("avg_runtime_ms"))).alias("slow_ms"), F.max(F.when(F.col("planner") == fast, F.col("avg_runtime_ms"))).alias("fast_ms"))
    return dynamic.where("slow_ms > 0 AND fast_ms > 0").withColumn("speedup_x", F.col("slow_ms") / F.col("fast_ms")).withColumn("reduction_pct", (1 - F.col("fast_ms") / F.col("slow_ms")) * 100)


def rank_planners(summary: DataFrame) -> DataFrame:
    """planner, score, rank of the dynamic groups by a fixed weighting (ties by name)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    latency = z("avg_replan_latency_ms") if "avg_replan_latency_ms" in summary.columns else F.lit(0.0)
    score = 2.0 * z("success_rate") + 1.2 * z("stability_consistency") - 0.0005 * latency - 0.001 * z("avg_effective_cost_km") - 0.002 * z("avg_risk_exposure") + 0.8 * z("avg_route_safety")
    made = summary.where("mode = 'dynamic'").select("planner", score.alias("score"))
    return made.selectExpr("planner", "score", "row_number() OVER (ORDER BY score DESC, planner) AS rank")


#: Metric, kind of change and the largest allowed one.
REGRESSION_RULES = (("avg_runtime_ms", "increase", 0.35), ("avg_distance_km", "increase", 0.15), ("avg_risk_exposure", "increase", 0.20), ("success_rate", "drop", 0.05), ("stability_consistency", "drop", 0.10))


def regression_check(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """mode, planner, metric, baseline, current, change, threshold, violation for groups in both summaries."""
    keys = ["mode", "planner"]
    metrics = [m for m, _, _ in REGRESSION_RULES]
    long = lambda df, n: df.where("success_rate > 0").unpivot(keys, metrics, "metric", n)
    both = long(current, "current").join(long(baseline, "baseline"), [*keys, "metric"])
    rules = F.broadcast(current.sparkSession.createDataFrame([*REGRESSION_RULES], "metric string, kind string, threshold double"))
    c, b = F.coalesce("current", F.lit(0.0)), F.coalesce("baseline", F.lit(0.0))
    grown = F.when(F.abs(b) <= 1e-9, F.when(F.abs(c) <= 1e-9, 0.0).otherwise(1.0)).otherwise((c - b) / F.abs(b))
    change = F.when(F.col("kind") == "increase", grown).otherwise(b - c)
    return both.join(rules, "metric").select(*keys, "metric", b.alias("baseline"), c.alias("current"), change.alias("change"), "threshold", (change > F.col("threshold")).alias("violation"))


def with_bands(bench: DataFrame, risk_quantile: float = 0.5, distance_quantile: float = 0.5) -> DataFrame:
    """bench with volatility_band, risk_band, distance_band; thresholds are exact quantiles of the ok runs."""
    long = bench.where(_ok()).select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("risk_exposure", "distance_km")))).alias("x")).select("x.*")
    cuts = quantiles(long, ["metric"], "value", {"risk_exposure": risk_quantile, "distance_km": distance_quantile})
    cuts = cuts.agg(*(F.max(F.when(F.col("metric") == c, F.col(c))).alias(n) for c, n in (("risk_exposure", "risk_cut"), ("distance_km", "distance_cut"))))
    out = bench.crossJoin(F.broadcast(cuts.select(F.coalesce("risk_cut", F.lit(0.0)).alias("risk_cut"), F.coalesce("distance_cut", F.lit(0.0)).alias("distance_cut"))))  # one row
    volatile = (F.col("mode") == "dynamic") & (F.col("replan_count") > 0)
    return (
        out.withColumn("volatility_band", F.when(volatile, "volatile").otherwise("stable"))
        .withColumn("risk_band", F.when(F.col("risk_exposure") > F.col("risk_cut"), "high_risk").otherwise("low_risk"))
        .withColumn("distance_band", F.when(F.col("distance_km") > F.col("distance_cut"), "long_range").otherwise("short_range"))
    )


def stratified_eval(bench: DataFrame, risk_quantile: float = 0.5, distance_quantile: float = 0.5) -> DataFrame:
    """Counts and means per stratum and per stratum and planner (planner null: the stratum), in one pass."""
    banded = with_bands(bench, risk_quantile, distance_quantile)
    key = F.concat_ws("|", "volatility_band", "risk_band", "distance_band").alias("strata_key")
    ok = lambda c: F.when(_ok(), c)
    rows = banded.select(key, "planner", "status", "distance_km", "route_cost_effective_km", "risk_exposure", route_safety(F.col("distance_km"), F.col("caution_len_km")).alias("safety"))
    out = rows.groupingSets([[F.col("strata_key")], [F.col("strata_key"), F.col("planner")]], F.col("strata_key"), F.col("planner")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count(ok(F.lit(1))).alias("success_count"),
        F.avg(ok(F.col("distance_km"))).alias("avg_distance_km"),
        F.avg(ok(F.col("route_cost_effective_km"))).alias("avg_total_cost_km"),
        F.avg(ok(F.col("risk_exposure"))).alias("avg_risk_exposure"),
        F.avg(ok(F.col("safety"))).alias("avg_route_safety"),
    )
    return out.withColumn("success_rate", F.col("success_count") / F.col("sample_count"))


def dimension_coverage(banded: DataFrame) -> DataFrame:
    """One row: does each band occur; PASS if all do, WARN if not, FAIL without rows."""
    names = (("volatility_band", "stable", "volatile"), ("risk_band", "low_risk", "high_risk"), ("distance_band", "short_range", "long_range"))
    out = banded.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(c) for c, _, _ in names))
    full = (F.col("volatility_band") == 2) & (F.col("risk_band") == 2) & (F.col("distance_band") == 2)
    return out.select("n", *(c for c, _, _ in names), F.when(F.col("n") == 0, "FAIL").when(full, "PASS").otherwise("WARN").alias("status"))


def failure_casebook(bench: DataFrame, runtime_pct: float = 0.5, cost_pct: float = 0.15, risk_pct: float = 0.2) -> DataFrame:
    """run_id, planner, scenario_key, case_type, reasons, tags: failed runs, and ok runs that fall behind the best of their scenario.

    The best values of a scenario are a sum by key joined back, so a scenario of very many runs is no single task.
    """
    key = F.concat_ws(":", "mode", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.col("repeat_idx").cast("string"))
    rows = bench.withColumn("scenario_key", key)
    none = F.lit(None).cast("string")
    get = lambda c: F.col(c) if c in bench.columns else none
    tags = lambda degraded: root_cause_tags(get("detail"), get("risk_budget_usage"), get("start_adjusted").cast("boolean"), get("uncertainty_penalty_mean"), degraded)
    metrics = (("runtime_ms", "runtime_ms", runtime_pct), ("route_cost_effective_km", "total_cost_km", cost_pct), ("risk_exposure", "risk_exposure", risk_pct))
    best = rows.where(_ok()).groupBy("scenario_key").agg(F.count(F.lit(1)).alias("n_ok"), *(F.min(c).alias(f"best_{c}") for c, _, _ in metrics)).where("n_ok >= 2")
    worse = F.array_compact(F.array(*[F.when((F.col(f"best_{c}") > 1e-9) & ((F.col(c) - F.col(f"best_{c}")) / F.col(f"best_{c}") >= pct), F.lit(name)) for c, name, pct in metrics]))
    out = rows.join(best, "scenario_key", "left").withColumn("__ok", _ok()).withColumn("reasons", F.when(F.col("__ok"), worse).otherwise(F.array().cast("array<string>")))
    out = out.where("NOT __ok OR size(reasons) > 0")
    return out.select("run_id", "planner", "scenario_key", F.when(F.col("__ok"), "degraded").otherwise("failed").alias("case_type"), "reasons", tags(F.col("__ok")).alias("tags"))


def numbered_cases(cases: DataFrame) -> DataFrame:
    """cases with case_id in order of failed first, then run_id: F0001.., D0002..; ranks come from counts of id ranges, not from one sorted partition."""
    kind = F.when(F.col("case_type") == "failed", 0).otherwise(1)
    part = cases.withColumn("k", kind).withColumn("bucket", F.floor(F.col("run_id") / 4096))
    sums = part.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("n")).selectExpr("k", "bucket", "sum(n) OVER (ORDER BY k, bucket) - n AS before")
    ranked = part.join(sums, ["k", "bucket"]).selectExpr("*", "before + row_number() OVER (PARTITION BY k, bucket ORDER BY run_id) AS i")
    return ranked.withColumn("case_id", F.concat(F.when(F.col("k") == 0, "F").otherwise("D"), F.lpad(F.col("i").cast("string"), 4, "0"))).drop("k", "bucket", "before", "i")


def casebook_counts(cases: DataFrame) -> DataFrame:
    """kind (tag, planner, case_type), value, n."""
    rows = cases.select(F.explode(F.concat(F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))), F.array(F.struct(F.lit("planner").alias("kind"), F.col("planner").alias("value")), F.struct(F.lit("case_type").alias("kind"), F.col("case_type").alias("value"))))).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def casebook_index(cases: DataFrame) -> DataFrame:
    """kind (tag, planner), value, position (from 1), case_id: the cases of each tag and planner in order; as rows, since a tag may have a third of all cases.

    cases come from numbered_cases(); positions are counts of ranges of run_id and places within a range.
    """
    rows = cases.select("case_id", "run_id", F.when(F.col("case_type") == "failed", 0).otherwise(1).alias("k"), F.explode(F.concat(F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))), F.array(F.struct(F.lit("planner").alias("kind"), F.col("planner").alias("value"))))).alias("x")).select("case_id", "run_id", "k", "x.*")
    part = rows.withColumn("bucket", F.floor(F.col("run_id") / 4096))
    sums = part.groupBy("kind", "value", "k", "bucket").agg(F.count(F.lit(1)).alias("n")).selectExpr("kind", "value", "k", "bucket", "sum(n) OVER (PARTITION BY kind, value ORDER BY k, bucket) - n AS before")
    ranked = part.join(sums, ["kind", "value", "k", "bucket"]).selectExpr("*", "before + row_number() OVER (PARTITION BY kind, value, k, bucket ORDER BY run_id) AS position")
    return ranked.select("kind", "value", "position", "case_id")


def failure_index(banded: DataFrame) -> DataFrame:
    """The runs that are not ok with their stratum: strata_key, the three bands, run_id, planner, mode, status."""
    key = F.concat_ws("|", "volatility_band", "risk_band", "distance_band")
    return banded.where(~_ok() | F.col("status").isNull()).select(key.alias("strata_key"), "volatility_band", "risk_band", "distance_band", "run_id", "planner", "mode", "status")


def union_bench(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    return static.unionByName(dynamic, allowMissingColumns=True)


def repeat_check(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], abs_tol: float = 1e-6, rel_tol: float = 0.05) -> DataFrame:
    """Per key and metric: values, differences, ok if either tolerance holds."""
    both = a.unpivot(keys, metrics, "metric", "value_a").join(b.unpivot(keys, metrics, "metric", "value_b"), [*keys, "metric"])
    d = F.abs(F.col("value_a") - F.col("value_b"))
    rel = d / F.greatest(F.abs("value_a"), F.lit(1e-9))
    return both.withColumn("abs_diff", d).withColumn("rel_diff", rel).withColumn("ok", (d <= abs_tol) | (rel <= rel_tol))


def replay_drift(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str], abs_tol: float, rel_tol: float) -> DataFrame:
    """Per key and metric: PASS within both tolerances, WARN within twice both, else FAIL; a missing replay fails."""
    both = old.unpivot(keys, metrics, "metric", "value_old").join(new.unpivot(keys, metrics, "metric", "value_new"), [*keys, "metric"], "left")
    d = F.abs(F.col("value_new") - F.col("value_old"))
    rel = d / F.greatest(F.abs("value_old"), F.lit(1e-9))
    status = F.when(d.isNull(), "FAIL").when((d <= abs_tol) & (rel <= rel_tol), "PASS").when((d <= 2 * abs_tol) & (rel <= 2 * rel_tol), "WARN").otherwise("FAIL")
    return both.select(*keys, "metric", "value_old", "value_new", status.alias("status"))


def runtime_profile(steps: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: total, mean, p90 (exact, by counts) and max."""
    p90 = quantiles(steps, [key], value, {"p90": 0.9}).withColumnRenamed(key, "__key")
    by = steps.groupBy(key).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return by.join(p90, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, "total", "mean", "p90", "max")


def release_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics (metric, value) against thresholds (metric, op <= or >=, warn, fail): status per metric; a missing metric fails."""
    v = F.col("value")
    low = F.when(v <= F.col("warn"), "PASS").when(v <= F.col("fail"), "WARN").otherwise("FAIL")
    high = F.when(v >= F.col("warn"), "PASS").when(v >= F.col("fail"), "WARN").otherwise("FAIL")
    status = F.when(v.isNull(), "FAIL").when(F.col("op") == "<=", low).otherwise(high)
    return thresholds.join(metrics, "metric", "left").select("metric", "value", "op", "warn", "fail", status.alias("status"))


def worst_status(checks: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return checks.agg(F.coalesce(F.max(rank), F.lit(2)).alias("r")).select(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("r") + 1).alias("status"))


def moments(bench: DataFrame, metric: str) -> DataFrame:
    """Per planner: n, mean, sample variance of the ok runs: what significance needs in closed form."""
    return bench.where(_ok()).groupBy("planner").agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.var_samp(metric).alias("variance"))


def effect_sizes(moments_: DataFrame) -> DataFrame:
    """planner_a < planner_b, difference and pooled effect size; one row a pair of planners."""
    a = moments_.select(*(F.col(c).alias(f"{c}_a") for c in moments_.columns))
    b = moments_.select(*(F.col(c).alias(f"{c}_b") for c in moments_.columns))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("variance_a") + (F.col("n_b") - 1) * F.col("variance_b")) / F.greatest(F.col("n_a") + F.col("n_b") - 2, F.lit(1)))
    diff = F.col("mean_a") - F.col("mean_b")
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  a dimension of planners meets itself
    return one(a).join(F.broadcast(one(b)), "__one").where("planner_a < planner_b").select("planner_a", "planner_b", diff.alias("difference"), F.when(pooled > 1e-12, diff / pooled).otherwise(0.0).alias("effect_size"))
