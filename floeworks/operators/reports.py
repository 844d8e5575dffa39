"""Run reports, versions, derived metrics, resampling statistics, annotation, and the rest of curation."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.scalars import PRIME, route_safety, uniform
from ..sources.scratch import kept
from .catalog import nearest_timestamp
from .graph import component_sizes
from .raster import KEY, quantile_normalize, quantiles_normalize


def normalize_versions(df: DataFrame, keys: dict[str, str], snapshot: str = "version_snapshot") -> DataFrame:
    """df with each key as a column: the snapshot map's value, else the row's own column, else the default; blanks count as missing."""
    out = df
    for k, default in keys.items():
        own = [F.nullif(F.trim(F.col(k)), F.lit(""))] if k in df.columns else []
        out = out.withColumn(k, F.coalesce(F.nullif(F.trim(F.element_at(snapshot, F.lit(k))), F.lit("")), *own, F.lit(default)))
    return out


#: The fields of a report's constraint block, and what stands where the run explains nothing.
CONSTRAINT = {"risk_constraint_mode": "none", "risk_constraint_metric_name": "none", "risk_constraint_metric": 0.0, "risk_budget": 0.0, "risk_budget_usage": 0.0, "risk_constraint_satisfied": True, "risk_confidence_level": 0.0}


def risk_reports(runs: DataFrame) -> DataFrame:
    """Per run (id, distance_km, caution_len_km, candidates array<struct<id, status, distance_km, risk_exposure>>): caution ratio, and what the selected candidate gains over the riskiest one.

    The selected one is `requested`, else the first that is ok. constraint is a struct of mode, metric_name, metric, budget, usage, satisfied and
    confidence_level from the columns named in CONSTRAINT, as far as runs has them. All of it stays in the row.
    """
    ok = F.filter("candidates", lambda c: c.status == "ok")
    asked = F.filter(ok, lambda c: c.id == "requested")
    out = runs.withColumn("__ok", ok).withColumn("selected", F.coalesce(F.get(asked, F.lit(0)), F.get(ok, F.lit(0))))
    worst = F.aggregate("__ok", F.get("__ok", F.lit(0)), lambda a, c: F.when(c.risk_exposure > a.risk_exposure, c).otherwise(a))
    out = out.withColumn("worst", worst)
    field = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in runs.columns else F.lit(v)
    block = [(F.round(field(c, v).cast("double"), 6) if isinstance(v, float) else field(c, v)).alias(c.removeprefix("risk_constraint_").removeprefix("risk_").removeprefix("budget_")) for c, v in CONSTRAINT.items()]
    return out.select(
        "id",
        F.when(F.col("distance_km") > 1e-9, F.col("caution_len_km") / F.col("distance_km")).otherwise(0.0).alias("caution_ratio"),
        F.size("candidates").alias("n_candidates"),
        F.size("__ok").alias("n_ok"),
        F.col("selected.id").alias("selected_id"),
        F.col("worst.id").alias("worst_id"),
        F.coalesce(F.col("worst.risk_exposure") - F.col("selected.risk_exposure"), F.lit(0.0)).alias("risk_reduction"),
        F.coalesce(F.col("selected.distance_km") - F.col("worst.distance_km"), F.lit(0.0)).alias("distance_tradeoff_km"),
        F.struct(*block).alias("constraint"),
    )


#: The figures that explain a run.
EXPLAINED = ("distance_km", "caution_len_km", "risk_exposure", "route_cost_effective_km", "corridor_alignment")


def _explained(bench: DataFrame) -> Column:
    """Is every figure there, and a finite number."""
    out = F.lit(all(c in bench.columns for c in EXPLAINED))
    for c in EXPLAINED:
        if c in bench.columns:
            v = F.col(c).cast("double")
            out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out


def derived_metrics(bench: DataFrame) -> DataFrame:
    """Per planner: success_rate, violation_rate (the constraint flag wins over the budget usage), volatility gain of dynamic over static runs, explain_consistency.

    explain_consistency is the share of the ok runs whose explained figures (EXPLAINED) are all finite numbers.
    """
    violated = F.when(F.col("risk_constraint_satisfied").isNotNull(), ~F.col("risk_constraint_satisfied")).otherwise(F.coalesce(F.col("risk_budget_usage") > 1, F.lit(False)))
    ok = F.col("status") == "ok"
    cost = lambda m: F.avg(F.when(ok & (F.col("mode") == m), F.col("route_cost_effective_km")))
    out = bench.groupBy("planner").agg(F.avg(ok.cast("double")).alias("success_rate"), F.avg(F.when(ok, violated.cast("double"))).alias("violation_rate"), cost("static").alias("static_cost"), cost("dynamic").alias("dynamic_cost"), F.coalesce(F.avg(F.when(ok, _explained(bench).cast("double"))), F.lit(0.0)).alias("explain_consistency"))
    return out.withColumn("dynamic_gain", F.when(F.col("static_cost") > 1e-9, (F.col("static_cost") - F.col("dynamic_cost")) / F.col("static_cost")).otherwise(0.0))


def metric_validation(metrics: DataFrame, unit: list[str]) -> DataFrame:
    """planner, metric, present, in_range (0 to 1) for the given metrics."""
    long = metrics.unpivot(["planner"], unit, "metric", "value")
    return long.select("planner", "metric", F.col("value").isNotNull().alias("present"), F.coalesce(F.col("value").between(0, 1), F.lit(False)).alias("in_range"))


def closed_loop_delta(train: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: best and final IoU of a training log (epoch, iou), and the change of mean length and run time between two benchmarks."""
    log = train.agg(F.max("iou").alias("best_iou"), F.max_by("iou", "epoch").alias("final_iou"))
    mean = lambda b, s: b.where("status = 'ok'").agg(F.avg("distance_km").alias(f"km_{s}"), F.avg("runtime_ms").alias(f"ms_{s}"))
    both = log.crossJoin(mean(before, "a")).crossJoin(mean(after, "b"))  # one row each
    return both.select("best_iou", "final_iou", (F.col("km_b") - F.col("km_a")).alias("distance_delta_km"), (F.col("ms_b") - F.col("ms_a")).alias("runtime_delta_ms"))


#: Bounds of a Poisson(1) number: its weight is how many of them a uniform number exceeds.
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)]).tolist()


#: Samples whose numbers are made at a time, and keys whose sums a task holds.
AT_ONCE, KEYS_HELD = 2048, 1024


def _numbers(ids: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """uniform(id, replicate) for all replicates of each id."""
    x = (seed % PRIME * 48271 + ids % PRIME) % PRIME
    x = x * (x + 69621) % PRIME
    x = (x[:, None] * 48271 + np.arange(rounds)) % PRIME
    x = x * (x + 69621) % PRIME
    return x * (x + 48271) % PRIME / float(PRIME)


def _replicated(samples: DataFrame, keys: Sequence[str], rounds: int, seed: int, sums: Callable[[tuple, np.ndarray, np.ndarray], Iterator[tuple[tuple, np.ndarray]]], schema: T.StructType) -> DataFrame:
    """Sums by replicate: `sums` makes from a key, its samples' values and numbers (a row a sample) output keys with columns (a row a replicate), which are summed.

    samples are keys, id, value; values are not null. A task gives partial sums of its keys, so the rows that move are keys times replicates.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def given() -> Iterator[pd.DataFrame]:
            for key, a in held.items():
                yield pd.DataFrame({f.name: [v] * rounds for f, v in zip(schema.fields, key)} | {"replicate": range(rounds)} | {f.name: a[:, i] for i, f in enumerate(schema.fields[len(key) + 1 :])})
            held.clear()

        for whole in parts:
            for i in range(0, len(whole), AT_ONCE):
                part = whole.iloc[i : i + AT_ONCE]
                ids, place = np.unique(part["id"].to_numpy(np.int64), return_inverse=True)
                numbers, values = _numbers(ids, rounds, seed), part["value"].to_numpy(float)
                for key, rows in part.groupby(list(keys), dropna=False).indices.items():
                    for out, a in sums(key if isinstance(key, tuple) else (key,), values[rows], numbers[place[rows]]):
                        held[out] = held[out] + a if out in held else a
                if len(held) > KEYS_HELD:
                    yield from given()
        yield from given()

    names = [f.name for f in schema.fields]
    at = names.index("replicate") + 1
    found = samples.select(*keys, F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value")).mapInPandas(run, schema)
    return found.groupBy(*names[:at]).agg(*(F.sum(n).alias(n) for n in names[at:]))


def bootstrap_ci(samples: DataFrame, rounds: int = 500, alpha: float = 0.05, seed: int = 0, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Per keys: mean, n and the percentile interval of resampled means.

    Each sample's weight in a replicate is a Poisson(1) number made from its id (a whole number) and the replicate, so a
    replicate is a weighted sum by key: nothing is gathered, and any number of samples is spread over tasks.
    """
    rounds = max(200, rounds)

    def sums(key: tuple, values: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        weights = sum((numbers > c).astype(float) for c in POISSON)
        yield key, np.stack([values @ weights, weights.sum(0)], axis=1)

    fields = [*(samples.schema[k] for k in keys), T.StructField("replicate", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("s", "w"))]
    known = samples.withColumn("value", F.coalesce("value", F.lit(0.0)))  # an unknown value adds its weight only
    means = _replicated(known, keys, rounds, seed, sums, T.StructType(fields)).withColumn("m", F.col("s") / F.nullif("w", F.lit(0.0)))
    ci = means.groupBy(*keys).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return samples.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).join(ci, list(keys))


def permutation_test(samples: DataFrame, a: str, b: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """One row: difference of means of two keys and its two-sided p value.

    A replicate deals samples to the two sides by a number made from id and replicate, each with its side's share; sums by
    replicate give the differences.
    """
    two = samples.where(F.col("key").isin(a, b))
    totals = two.agg(F.avg(F.when(F.col("key") == a, F.col("value"))).alias("ma"), F.avg(F.when(F.col("key") == b, F.col("value"))).alias("mb"), F.avg((F.col("key") == a).cast("double")).alias("share"))
    spread = two.crossJoin(F.broadcast(totals)).select("id", "value", "share", F.explode(F.sequence(F.lit(0), F.lit(max(200, rounds) - 1))).alias("replicate"))  # one row
    dealt = spread.select("replicate", "value", (uniform(F.col("id"), F.col("replicate"), seed=seed) < F.col("share")).alias("left"))
    means = dealt.groupBy("replicate").agg((F.avg(F.when(F.col("left"), F.col("value"))) - F.avg(F.when(~F.col("left"), F.col("value")))).alias("d"))
    both = means.crossJoin(F.broadcast(totals))  # one row
    return both.agg(F.first(F.col("ma") - F.col("mb")).alias("difference"), ((F.count_if(F.abs("d") >= F.abs(F.col("ma") - F.col("mb"))) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


#: The compared metrics, and whether a higher value is better.
METRICS = {"completion_rate": True, "total_cost_km": False, "replan_latency_ms": False, "risk_exposure": False, "route_safety": True}


def metric_samples(bench: DataFrame, mode: str = "dynamic") -> DataFrame:
    """planner, metric, id, value of the runs of one mode: completion of all runs, the other metrics of the ok ones."""
    ok = F.col("status") == "ok"
    latency = F.col("avg_replan_ms") if "avg_replan_ms" in bench.columns else F.lit(0.0)
    safety = F.col("route_safety") if "route_safety" in bench.columns else route_safety(F.col("distance_km"), F.col("caution_len_km"))
    values = {"completion_rate": ok.cast("double"), "total_cost_km": F.col("route_cost_effective_km"), "replan_latency_ms": latency, "risk_exposure": F.col("risk_exposure"), "route_safety": safety}
    runs = bench.where((F.lower("mode") == mode) & (F.trim("planner") != "")).select(F.lower(F.trim("planner")).alias("planner"), F.col("run_id").alias("id"), ok.alias("ok"), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(m) for m, v in values.items()))
    return runs.unpivot(["planner", "id", "ok"], list(METRICS), "metric", "value").where("ok OR metric = 'completion_rate'").drop("ok")


def significance(samples: DataFrame, rounds: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Per metric and pair of planners a < b: mean_diff, p_value, effect_size, winner, confidence, n_a, n_b.

    A sample is dealt in each replicate to one side of each pair that its planner is in. A task sums its own samples by pair and
    replicate in arrays, so samples are never gathered or repeated. Planners are a small dimension; pairs are made from their sums.
    """
    samples = kept(samples.select("metric", "planner", "id", "value"), "samples")
    by = samples.groupBy("metric", "planner").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))
    side = lambda x: by.select("metric", *(F.col(c).alias(f"{c}_{x}") for c in ("planner", "n", "mean", "variance")))
    pairs = side("a").join(side("b"), "metric").where("planner_a < planner_b").withColumn("diff", F.col("mean_a") - F.col("mean_b"))
    pooled = F.sqrt(F.greatest(F.lit(1e-12), ((F.col("n_a") - 1) * F.col("variance_a") + (F.col("n_b") - 1) * F.col("variance_b")) / F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - 2)))
    pairs = pairs.withColumn("effect_size", F.col("diff") / pooled)
    mine = pairs.select("metric", "planner_a", "planner_b", (F.col("n_a") / (F.col("n_a") + F.col("n_b"))).alias("share"), F.explode(F.array("planner_a", "planner_b")).alias("planner"))
    shares: dict[tuple, list[tuple]] = {}
    for r in mine.collect():  # planners squared
        shares.setdefault((r["metric"], r["planner"]), []).append((r["planner_a"], r["planner_b"], r["share"]))

    def sums(key: tuple, values: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        for a, b, share in shares.get(key, ()):
            left = (numbers < share).astype(float)
            n, s = left.sum(0), values @ left
            yield (key[0], a, b), np.stack([n, s, len(values) - n, values @ (1 - left)], axis=1)

    fields = [samples.schema["metric"], *(T.StructField(c, samples.schema["planner"].dataType) for c in ("planner_a", "planner_b")), T.StructField("replicate", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("left_n", "left_s", "right_n", "right_s"))]
    dealt = _replicated(samples.where("value IS NOT NULL"), ("metric", "planner"), max(200, rounds), seed, sums, T.StructType(fields))
    side_mean = lambda x: F.col(f"{x}_s") / F.nullif(f"{x}_n", F.lit(0.0))
    dealt = dealt.withColumn("d", side_mean("left") - side_mean("right"))
    extreme = dealt.join(pairs.select("metric", "planner_a", "planner_b", "diff"), ["metric", "planner_a", "planner_b"]).groupBy("metric", "planner_a", "planner_b").agg(((F.count_if(F.abs("d") >= F.abs("diff")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    ci = bootstrap_ci(samples, rounds, alpha, seed, ("metric", "planner"))
    ends = lambda x: ci.select("metric", F.col("planner").alias(f"planner_{x}"), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
    out = pairs.join(extreme, ["metric", "planner_a", "planner_b"]).join(ends("a"), ["metric", "planner_a"]).join(ends("b"), ["metric", "planner_b"])
    low, high, p = F.col("low_a") - F.col("high_b"), F.col("high_a") - F.col("low_b"), F.col("p_value")
    apart = ((low > 0) & (high > 0)) | ((low < 0) & (high < 0))
    better = F.col("metric").isin([m for m, higher in METRICS.items() if higher])
    winner = F.when(p >= alpha, "tie").when((F.col("diff") > 0) == better, F.col("planner_a")).otherwise(F.col("planner_b"))
    confidence = F.when((p < 0.01) & apart, "high").when((p < 0.05) & apart, "medium").otherwise("low")
    return out.select("metric", "planner_a", "planner_b", F.col("diff").alias("mean_diff"), "p_value", "effect_size", winner.alias("winner"), confidence.alias("confidence"), "n_a", "n_b")


SLICES = 4096


def weighted_draws(weights: DataFrame, n: int, seed: int = 0, key: str = KEY) -> DataFrame:
    """draw, key: n draws with replacement by weight; key is a whole number.

    Weights become intervals of a running sum (slices of keys by a number made from them are summed first, so only SLICES sums
    are ordered whole). Draws find their interval by bucketed search, first among slices, then among the keys of a slice: the line
    is cut into as many equal cells as there are intervals, each interval is listed under the cells it touches (twice their number
    at most), and a draw meets those of its own cell by an equi-join.
    """
    parts = weights.where("weight > 0").select(key, "weight", F.floor(uniform(F.col(key)) * SLICES).alias("slice"))
    sums = parts.groupBy("slice").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("keys")).selectExpr("slice", "w", "keys", "sum(w) OVER (ORDER BY slice) AS high", "sum(w) OVER () AS total")
    cell = lambda x, size, cells: F.least(F.greatest(F.floor(x / size * cells), F.lit(0)), cells - 1).cast("long")
    touched = lambda low, high, size, cells: F.explode(F.sequence(cell(low, size, cells), cell(high, size, cells)))
    index = sums.withColumn("cell", touched(F.col("high") - F.col("w"), F.col("high"), F.col("total"), F.lit(SLICES)))
    u = uniform(F.col("id"), seed=seed) + uniform(F.col("id"), seed=seed + 1) / float(PRIME)
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("u")).withColumn("cell", cell(F.col("u"), F.lit(1.0), F.lit(SLICES)))
    placed = draws.join(F.broadcast(index), "cell").where("u * total >= high - w AND u * total < high")  # 2 * SLICES rows at most
    placed = placed.select("draw", "slice", (F.col("u") * F.col("total") - F.col("high") + F.col("w")).alias("x"), cell(F.col("u") * F.col("total") - F.col("high") + F.col("w"), F.col("w"), F.col("keys")).alias("cell"))
    inner = parts.selectExpr(key, "slice", "weight", f"sum(weight) OVER (PARTITION BY slice ORDER BY {key}) AS upto").join(F.broadcast(sums.select("slice", "w", "keys")), "slice")  # SLICES rows
    inner = inner.withColumn("cell", touched(F.col("upto") - F.col("weight"), F.col("upto"), F.col("w"), F.col("keys")))
    return placed.join(inner.select("slice", "cell", key, "weight", "upto"), ["slice", "cell"]).where("x >= upto - weight AND x < upto").select("draw", key)


def derive_layers(cells: DataFrame, key: str = KEY) -> DataFrame:
    """cells with wind_speed, ice_fraction (percent only where the map's values exceed 2) and ais_inverse."""
    top = F.max(F.abs("ice_conc")).over(W.partitionBy(key))
    ice = F.nanvl(F.when(F.col("__top") > 2, F.col("ice_conc") / 100).otherwise(F.col("ice_conc")), F.lit(0.0))
    out = cells.withColumn("__top", top).withColumn("wind_speed", F.hypot("wind_u10", "wind_v10")).withColumn("ice_fraction", F.least(F.greatest(ice, F.lit(0.0)), F.lit(1.0)))
    return quantile_normalize(out, "ais_heatmap", into="__ais", key=key).withColumn("ais_inverse", 1 - F.col("__ais")).drop("__top", "__ais")


def heuristic_classes(cells: DataFrame, key: str = KEY) -> DataFrame:
    """cells with risk (0.5 ice + 0.3 wave + 0.2 wind after scaling over the sea), cls (caution from the map's 82nd percentile, blocked 2) and unc."""
    sea = F.col("blocked") == 0
    out = cells.withColumn("wind_speed", F.hypot("wind_u10", "wind_v10"))
    out = quantiles_normalize(out, {"ice_conc": "__i", "wave_hs": "__w", "wind_speed": "__s"}, mask=sea, min_max=True, key=key)
    out = out.withColumn("risk", 0.5 * F.col("__i") + 0.3 * F.col("__w") + 0.2 * F.col("__s"))
    cut = out.where(sea).groupBy(key).agg(F.percentile("risk", F.lit(0.82)).alias("__cut"))
    out = out.join(cut, key, "left")
    cls = F.when(~sea, 2).when(F.col("risk") >= F.col("__cut"), 1).otherwise(0)
    return out.withColumn("cls", cls).withColumn("unc", F.when(sea, F.greatest(F.lit(0.0), 1 - F.abs(F.col("risk") - F.col("__cut")) / 0.25)).otherwise(0.0)).drop("__i", "__w", "__s", "__cut", "wind_speed")


def annotation_quality(cells: DataFrame, tiny: int = 2, key: str = KEY, tile: int = 256) -> DataFrame:
    """Per map: overlap_ratio of caution and blocked, components of the caution mask, tiny ones among them, and ok.

    Components are counted by tiles that are joined along their seams.
    """
    sums = cells.groupBy(key).agg((F.count_if((F.col("caution") > 0) & (F.col("blocked") > 0)) / F.greatest(F.count_if(F.col("caution") > 0), F.lit(1))).alias("overlap_ratio"))
    parts = component_sizes(cells, "caution", key, tile).groupBy(key).agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("n") <= tiny).alias("tiny"))
    out = sums.join(parts, key, "left").fillna(0, ["components", "tiny"])
    return out.withColumn("ok", (F.col("overlap_ratio") <= 0.5) & (F.col("tiny") <= 0.5 * F.col("components")))


def regrid_linear(field: DataFrame, spacing: float, targets: DataFrame, key: str | None = None) -> DataFrame:
    """targets (target_id, y, x) with value from field (row, col, value) on a regular grid of the given spacing, linear inside and beyond the edges; from the target's own map where key is given.

    The cell of a target beyond the edge is the last one, so its two nodes carry the line outwards.
    """
    keys = [key] if key else []
    ends = field.groupBy(*keys).agg(F.max("row").alias("mr"), F.max("col").alias("mc"))
    t = targets.join(ends, keys) if key else targets.crossJoin(F.broadcast(ends))  # one row
    base = lambda c, m: F.least(F.greatest(F.floor(F.col(c) / spacing), F.lit(0)), F.greatest(F.col(m) - 1, F.lit(0))).cast("int")
    t = t.withColumn("r", base("y", "mr")).withColumn("c", base("x", "mc")).withColumn("dy", F.col("y") / spacing - F.col("r")).withColumn("dx", F.col("x") / spacing - F.col("c"))
    side = lambda d, k: F.col(d) if k else 1 - F.col(d)
    corners = F.explode(F.array(*(F.struct((F.col("r") + a).alias("row"), (F.col("c") + b).alias("col"), (side("dy", a) * side("dx", b)).alias("w")) for a in (0, 1) for b in (0, 1))))
    spread = t.select(*keys, "target_id", corners.alias("k")).select(*keys, "target_id", "k.*")
    return spread.join(field, [*keys, "row", "col"]).groupBy(*keys, "target_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def regrid(field: DataFrame, axes: DataFrame, targets: DataFrame, key: str | None = None) -> DataFrame:
    """targets (target_id, ts, lat, lon) with slice_ts and value: linear in both axes, beyond them too, from the time slice nearest to ts (the earlier of two).

    field has ts, row, col, value; axes has axis (`lat`, `lon`), idx, value, ascending, evenly spaced or not. The two axes
    are dimensions of one map (arrays in a row); the field is met by key, four corners a target. With key, field and targets
    belong to series of maps of that name, each with slices of its own.
    """
    keys = [key] if key else []
    lists = axes.groupBy("axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("at"))
    one = lists.agg(*(F.max(F.when(F.col("axis") == a, F.col("at"))).alias(f"__{a}") for a in ("lat", "lon")))
    near = nearest_timestamp(targets.select(*keys, "ts").distinct(), field.select(*keys, "ts").distinct(), key).withColumnRenamed("nearest", "slice_ts")
    t = targets.join(near, [*keys, "ts"]).crossJoin(F.broadcast(one))  # one row
    for a in ("lat", "lon"):
        at, place = F.col(f"__{a}"), F.col(a)
        below = F.size(F.filter(at, lambda v: v <= place)) - 1  # noqa: B023
        t = t.withColumn(f"__i_{a}", F.greatest(F.lit(0), F.least(below, F.size(at) - 2)))
        low = F.get(at, F.col(f"__i_{a}"))
        high = F.get(at, F.col(f"__i_{a}") + 1)
        t = t.withColumn(f"__w_{a}", F.coalesce((F.col(a) - low) / (high - low), F.lit(0.0)))
    side = lambda a, k: F.col(f"__w_{a}") if k else 1 - F.col(f"__w_{a}")
    corners = F.array(*(F.struct((F.col("__i_lat") + i).alias("row"), (F.col("__i_lon") + j).alias("col"), (side("lat", i) * side("lon", j)).alias("w")) for i in (0, 1) for j in (0, 1)))
    spread = t.select(*keys, "target_id", "slice_ts", F.explode(F.filter(corners, lambda c: c["w"] != 0)).alias("k")).select(*keys, "target_id", "slice_ts", "k.*")
    return spread.join(field.withColumnRenamed("ts", "slice_ts"), [*keys, "slice_ts", "row", "col"]).groupBy(*keys, "target_id", "slice_ts").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


class Sight:
    """Lines of sight over a map: free if no cell that the line touches is blocked (corners count)."""

    def __init__(self, rows: Sequence[int], cols: Sequence[int]):
        self.rows: dict[int, list[int]] = {}
        for r, c in sorted(zip(rows, cols, strict=True)):
            self.rows.setdefault(r, []).append(c)

    def clear(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """A line touches the cells of a row between two columns; the first blocked one from there on decides."""
        dr, dc = b[0] - a[0], b[1] - a[1]
        reach = abs(dr) + abs(dc)
        for r in range(min(a[0], b[0]), max(a[0], b[0]) + 1):
            blocked = self.rows.get(r)
            if not blocked:
                continue
            low, high = min(a[1], b[1]), max(a[1], b[1])
            if dr:  # |2 (dc (r - r0) - dr (c - c0))| <= |dr| + |dc|
                at, step = 2 * dc * (r - a[0]), 2 * dr
                ends = sorted(((at - reach) / step, (at + reach) / step))
                low, high = max(low, a[1] + math.ceil(ends[0] - 1e-12)), min(high, a[1] + math.floor(ends[1] + 1e-12))
            k = bisect.bisect_left(blocked, low)
            if k < len(blocked) and blocked[k] <= high:
                return False
        return True


def turn_degrees(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> float:
    """The change of course at b; 0 where two points are one."""
    v, w = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
    size = math.hypot(*v) * math.hypot(*w)
    return math.degrees(math.acos(max(-1.0, min(1.0, (v[0] * w[0] + v[1] * w[1]) / size)))) if size > 1e-12 else 0.0


def simplified(points: list[tuple[int, int]], sight: Sight, max_turn: float | None = None) -> tuple[list[int], bool]:
    """The places of the points that stay, and whether all do because the shorter line would cross a blocked cell."""
    keep, i = [0], 0
    while i < len(points) - 1:
        bent = lambda j: max_turn is not None and len(keep) > 1 and turn_degrees(points[keep[-2]], points[i], points[j]) > max_turn  # noqa: B023, E731
        i = next((j for j in range(len(points) - 1, i + 1, -1) if sight.clear(points[i], points[j]) and not bent(j)), i + 1)
        keep.append(i)
    if all(sight.clear(points[a], points[b]) for a, b in itertools.pairwise(keep)):
        return keep, False
    return list(range(len(points))), True


def simplify_routes(route_cells: DataFrame, blocked: DataFrame, key: str = "ts", routes: int = 256, max_turn: float | None = None) -> DataFrame:
    """route_cells (key, route_id, seq, row, col) without the points that a straight line over free cells can skip, greedily from the start, and fallback.

    With max_turn a point is not skipped where the course would change by more degrees. A route whose shorter line crosses a blocked cell (two
    neighbouring points may not see each other) keeps all its points and is marked as fallback. About `routes` routes and the
    blocked cells of their map meet in one group: a map with many routes is many groups, and its blocked cells (a map fits a
    worker) go to each of them.
    """
    schema = T.StructType([*route_cells.select(key, "route_id", "seq", "row", "col").schema.fields, T.StructField("fallback", T.BooleanType())])

    def simplify(routes: pd.DataFrame, mask: pd.DataFrame) -> pd.DataFrame:
        sight, out = Sight(mask["row"].tolist(), mask["col"].tolist()), []
        for _, r in routes.sort_values("seq").groupby("route_id", sort=True):
            keep, fallback = simplified(list(zip(r["row"].tolist(), r["col"].tolist(), strict=True)), sight, max_turn)
            out.append(r.iloc[keep].assign(fallback=fallback))
        return (pd.concat(out) if out else routes.assign(fallback=False))[schema.names]

    parts = route_cells.select(key, "route_id").distinct().groupBy(key).agg(F.ceil(F.count(F.lit(1)) / routes).cast("int").alias("__parts"))
    dealt = route_cells.select(*schema.names[:-1]).join(parts, key).withColumn("__part", F.pmod(F.xxhash64("route_id"), F.col("__parts")).cast("int")).drop("__parts")
    masks = blocked.select(key, "row", "col").join(parts, key).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return dealt.groupBy(key, "__part").cogroup(masks.groupBy(key, "__part")).applyInPandas(simplify, schema)
