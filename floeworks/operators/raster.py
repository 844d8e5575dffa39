"""Gridded layers: arrays and cells, labels, normalisation, fused risk, stencils, sampling, changes.

A cell table has a map key (sample_id here, any name by `key`), row, col and one column per layer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = "sample_id"


def explode_raster(df: DataFrame, width: int, values: str = "values") -> DataFrame:
    """One row a cell from row-major arrays: row = i div width, col = i % width."""
    out = df.select(*[c for c in df.columns if c != values], F.posexplode(values).alias("i", "value"))
    return out.withColumn("row", F.floor(F.col("i") / width).cast("int")).withColumn("col", (F.col("i") % width).cast("int")).drop("i")


def pack_raster(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Row-major arrays from cells."""
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v")))).alias("a"))
    return packed.select(*keys, F.transform("a", lambda x: x.v).alias("values"))


def blocked_from_bathy(c: Column, threshold: float = 0.0) -> Column:
    """1 on land and where the depth is not known (null or NaN)."""
    return F.when(c.isNull() | F.isnan(c) | (c >= threshold), 1).otherwise(0)


def merge_labels(blocked: Column, caution: Column) -> Column:
    """0 free, 1 caution, 2 blocked; blocked wins."""
    return F.when(blocked >= 0.5, 2).when(caution >= 0.5, 1).otherwise(0)


def feature_stack(env: DataFrame, bathy: DataFrame, heat: DataFrame, fill: float = 0.0, key: str = KEY) -> DataFrame:
    """env inner heat, left bathy with a fill value and has_bathy; keys (map, row, col), so all joins share one partitioning."""
    on = [key, "row", "col"]
    return env.join(heat, on).join(bathy.withColumn("has_bathy", F.lit(True)), on, "left").withColumn("bathy", F.coalesce("bathy", F.lit(fill))).withColumn("has_bathy", F.coalesce("has_bathy", F.lit(False)))


def quantile_normalize(cells: DataFrame, column: str, low: float = 0.05, high: float = 0.95, mask: Column | None = None, into: str | None = None, flat: float = 0.0, min_max: bool = False, key: str = KEY) -> DataFrame:
    """clip((v - q_low) / (q_high - q_low)) per map; quantiles over the masked cells, exact.

    Maps without spread get `flat`, or with min_max are scaled by their smallest and largest value. Values that
    are not finite count as 0.
    """
    return quantiles_normalize(cells, {column: into or f"{column}_norm"}, low, high, mask, flat, min_max, key)


def quantiles_normalize(cells: DataFrame, columns: dict[str, str], low: float = 0.05, high: float = 0.95, mask: Column | None = None, flat: float = 0.0, min_max: bool = False, key: str = KEY) -> DataFrame:
    """quantile_normalize() of several columns, each into the one named: one aggregation and one join with a row for each map."""
    finite = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in columns}
    some = {c: F.when(mask, v) if mask is not None else v for c, v in finite.items()}
    made = {"lo": lambda v: F.percentile(v, F.lit(low)), "hi": lambda v: F.percentile(v, F.lit(high)), "a": F.min, "b": F.max}
    q = cells.groupBy(key).agg(*(f(v).alias(f"__{n}_{c}") for c, v in some.items() for n, f in made.items() if min_max or n in ("lo", "hi")))
    out = cells.join(q, key)
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    for c, into in columns.items():
        v, lo, hi, a, b = finite[c], *(F.col(f"__{n}_{c}") for n in made)
        other = F.when(b - a >= 1e-6, clip((v - a) / (b - a))).otherwise(flat) if min_max else F.lit(flat)
        out = out.withColumn(into, F.coalesce(F.when(hi - lo >= 1e-6, clip((v - lo) / (hi - lo))).otherwise(other), F.lit(flat)))
    return out.drop(*(f"__{n}_{c}" for c in columns for n in made))


#: Component weights of the fused risk, and the normal quantile of its upper estimate.
RISK_WEIGHTS = {"unet_pred": 0.34, "uncertainty": 0.20, "ice": 0.18, "wave": 0.14, "wind": 0.10, "ais_inverse": 0.04}
P90_Z = 1.28155


def risk_components(cells: DataFrame, temperature: float = 1.0, key: str = KEY) -> DataFrame:
    """cells with the six components, each 0 to 1, from pred, unc, ice_conc, wave_hs, wind_u10, wind_v10, ais_heatmap, blocked."""
    sea = F.col("blocked") == 0
    top = F.max(F.abs("ice_conc")).over(W.partitionBy(key))
    out = cells.withColumn("wind_speed", F.hypot("wind_u10", "wind_v10")).withColumn("__top", top)
    out = quantiles_normalize(out, {"wave_hs": "wave", "wind_speed": "wind", "ais_heatmap": "__ais"}, mask=sea, key=key)
    clip = lambda x: F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    confidence = F.least(F.greatest(1 - clip(F.col("unc")), F.lit(1e-6)), F.lit(1 - 1e-6))
    calibrated = F.col("unc").cast("double") if temperature == 1.0 else 1 - 1 / (1 + F.exp(-F.log(confidence / (1 - confidence)) / temperature))
    return (
        out.withColumn("unet_pred", F.when(F.rint("pred") == 2, 1.0).when(F.rint("pred") == 1, 0.65).otherwise(0.0))
        .withColumn("uncertainty", clip(calibrated))
        .withColumn("ice", clip(F.when(F.col("__top") > 2, F.col("ice_conc") / 100).otherwise(F.col("ice_conc"))))
        .withColumn("ais_inverse", 1 - F.col("__ais"))
        .drop("__top", "__ais", "wind_speed")
    )


def fuse_risk(components: DataFrame) -> DataFrame:
    """risk_mean, risk_std (population) and risk_p90 from the components that are present as columns; weights are renormalised."""
    names = [n for n in RISK_WEIGHTS if n in components.columns]
    total = sum(RISK_WEIGHTS[n] for n in names)
    if not names:
        zero = F.when(F.col("blocked") == 1, 1.0).otherwise(0.0)
        return components.withColumn("risk_mean", zero).withColumn("risk_std", F.lit(0.0)).withColumn("risk_p90", zero)
    mean = sum((F.col(n) * (RISK_WEIGHTS[n] / total) for n in names[1:]), F.col(names[0]) * (RISK_WEIGHTS[names[0]] / total))
    plain = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    out = components.withColumn("__m", mean).withColumn("__p", plain)
    spread = sum((F.pow(F.col(n) - F.col("__p"), 2) for n in names[1:]), F.pow(F.col(names[0]) - F.col("__p"), 2)) / len(names)
    std = F.sqrt(spread) if len(names) > 1 else F.lit(0.0)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    blocked = F.col("blocked") == 1
    return out.withColumn("risk_std", std).withColumn("risk_mean", F.when(blocked, 1.0).otherwise(unit(F.col("__m")))).withColumn("risk_p90", F.when(blocked, 1.0).otherwise(unit(F.col("__m") + P90_Z * F.col("risk_std")))).drop("__m", "__p")


def layer_stats(cells: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """Per map and layer: min, max, mean, p50, p90."""
    long = cells.unpivot([key], columns, "layer", "v")
    return long.groupBy(key, "layer").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.9)).alias("p90"))


def class_histogram(cells: DataFrame, column: str = "pred", key: str = KEY) -> DataFrame:
    """Per map: counts and ratios of classes 0, 1, 2, and mean and p90 of unc."""
    n = F.count(F.lit(1))
    return cells.groupBy(key).agg(*(F.count_if(F.col(column) == k).alias(f"n{k}") for k in range(3)), *((F.count_if(F.col(column) == k) / n).alias(f"ratio{k}") for k in range(3)), F.avg("unc").alias("unc_mean"), F.percentile("unc", F.lit(0.9)).alias("unc_p90"))


def channel_stats(cells: DataFrame, channels: list[str], stride: int = 1) -> DataFrame:
    """channel, mean, std over every stride-th row and column; values that are not finite count as 0, variance at least 1e-8."""
    long = cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).unpivot([], channels, "channel", "v")
    v = F.when(F.isnan("v") | (F.abs("v") == float("inf")), 0.0).otherwise(F.col("v"))
    return long.groupBy("channel").agg(F.avg(v).alias("mean"), F.sqrt(F.greatest(F.var_pop(v), F.lit(1e-8))).alias("std"))


def class_weights(cells: DataFrame, column: str = "pred", stride: int = 1) -> DataFrame:
    """cls, weight: inverse frequencies over their mean; a class without cells counts as one cell."""
    some = cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    counts = some.agg(*(F.greatest(F.count_if(F.col(column) == k), F.lit(1)).alias(f"c{k}") for k in range(3)))
    total = F.col("c0") + F.col("c1") + F.col("c2")
    inverse = [total / F.col(f"c{k}") for k in range(3)]
    mean = (inverse[0] + inverse[1] + inverse[2]) / 3
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("cls"), (inverse[k] / mean).alias("weight")) for k in range(3)))).alias("x")).select("x.*")


def segmentation_scores(cells: DataFrame, truth: str = "y", pred: str = "pred", key: str = KEY) -> DataFrame:
    """Per map: IoU of each class (null where it occurs on neither side), their mean, pixel accuracy."""
    t, p = F.col(truth), F.col(pred)
    out = cells.groupBy(key).agg(*(F.count_if((t == k) & (p == k)).alias(f"i{k}") for k in range(3)), *(F.count_if((t == k) | (p == k)).alias(f"u{k}") for k in range(3)), (F.count_if(t == p) / F.count(F.lit(1))).alias("accuracy"))
    for k in range(3):
        out = out.withColumn(f"iou{k}", F.when(F.col(f"u{k}") > 0, F.col(f"i{k}") / F.col(f"u{k}")))
    sums = F.aggregate(F.array_compact(F.array("iou0", "iou1", "iou2")), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("miou", sums / F.greatest(F.size(F.array_compact(F.array("iou0", "iou1", "iou2"))), F.lit(1))).select(key, "iou0", "iou1", "iou2", "miou", "accuracy")


def stencil3(cells: DataFrame, column: str, function: str, key: str = KEY) -> DataFrame:
    """cells with <column>_<function> over the 3x3 neighbourhood (cut at the edges): sum, max, min or avg by two chained windows.

    The windows need a dense grid: every row and column of a map present.
    """
    along = W.partitionBy(key, "row").orderBy("col").rowsBetween(-1, 1)
    across = W.partitionBy(key, "col").orderBy("row").rowsBetween(-1, 1)
    f = {"sum": F.sum, "max": F.max, "min": F.min}
    if function == "avg":
        out = cells.withColumn("__s", F.sum(column).over(along)).withColumn("__n", F.count(column).over(along))
        return out.withColumn(f"{column}_avg", F.sum("__s").over(across) / F.sum("__n").over(across)).drop("__s", "__n")
    out = cells.withColumn("__s", f[function](column).over(along))
    return out.withColumn(f"{column}_{function}", f[function]("__s").over(across)).drop("__s")


def near_blocked(cells: DataFrame, key: str = KEY) -> DataFrame:
    """cells with near_blocked: free, with a blocked cell among the eight around."""
    return stencil3(cells, "blocked", "max", key).withColumn("near_blocked", ((F.col("blocked_max") == 1) & (F.col("blocked") == 0)).cast("int")).drop("blocked_max")


def class_edges(cells: DataFrame, column: str = "pred", key: str = KEY) -> DataFrame:
    """cells with edge: one of the four neighbours has another class."""
    along, across = W.partitionBy(key, "row").orderBy("col"), W.partitionBy(key, "col").orderBy("row")
    c = F.col(column)
    differs = [F.coalesce(f(column).over(w) != c, F.lit(False)) for w in (along, across) for f in (F.lag, F.lead)]
    return cells.withColumn("edge", (differs[0] | differs[1] | differs[2] | differs[3]).cast("int"))


def grown(cells: DataFrame, column: str, key: str = KEY) -> DataFrame:
    """cells with the 0/1 mask of column grown by one step to the four neighbours."""
    along, across = W.partitionBy(key, "row").orderBy("col").rowsBetween(-1, 1), W.partitionBy(key, "col").orderBy("row").rowsBetween(-1, 1)
    return cells.withColumn(column, F.greatest(F.max(column).over(along), F.max(column).over(across)))


def majority_smooth(cells: DataFrame, column: str, least: int = 2, key: str = KEY) -> DataFrame:
    """A mask without cells that have fewer than `least` set cells in their 3x3 neighbourhood (themselves included)."""
    return stencil3(cells, column, "sum", key).withColumn("smooth", F.when((F.col(column) == 1) & (F.col(f"{column}_sum") >= least), 1).otherwise(0)).drop(f"{column}_sum")


def cell_changes(cells: DataFrame, columns: list[str], order: str = KEY, tolerance: float = 1e-6) -> DataFrame:
    """Per step (after the first): cells whose value of each column moved by more than the tolerance, and of any."""
    w = W.partitionBy("row", "col").orderBy(order)
    out = cells.withColumn("__prev", F.lag(order).over(w))
    for c in columns:
        out = out.withColumn(f"__{c}", F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)) > tolerance, F.lit(True)))
    any_ = F.lit(False)
    for c in columns:
        any_ = any_ | F.col(f"__{c}")
    return out.where("__prev IS NOT NULL").groupBy(order).agg(*(F.count_if(F.col(f"__{c}")).alias(f"{c}_changed") for c in columns), F.count_if(any_).alias("any_changed"))


OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def changed_edges(changed: DataFrame, height: int, width: int, key: str = KEY) -> DataFrame:
    """Per map: distinct directed neighbour edges that touch a changed cell (key, row, col)."""
    spread = changed.select(key, "row", "col", F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in OFFSETS))).alias("o")).select(key, "row", "col", (F.col("row") + F.col("o.dr")).alias("r2"), (F.col("col") + F.col("o.dc")).alias("c2"))
    spread = spread.where(f"r2 BETWEEN 0 AND {height - 1} AND c2 BETWEEN 0 AND {width - 1}")
    both = spread.unionByName(spread.select(key, F.col("r2").alias("row"), F.col("c2").alias("col"), F.col("row").alias("r2"), F.col("col").alias("c2")))
    return both.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("changed_edges"))


def resample(cells: DataFrame, targets: DataFrame, column: str, mode: str = "bilinear", key: str = KEY) -> DataFrame:
    """targets (key, target_id, y, x in cell units) with value: nearest (half up), or bilinear with weights renormalised over corners that have a value."""
    t = targets.select(key, "target_id", "y", "x")
    if mode == "nearest":
        spread = t.select(key, "target_id", F.floor(F.col("y") + 0.5).cast("int").alias("row"), F.floor(F.col("x") + 0.5).cast("int").alias("col"), F.lit(1.0).alias("w"))
    else:
        fy, fx = F.floor("y").cast("int"), F.floor("x").cast("int")
        corner = lambda a, b: F.struct((fy + a).alias("row"), (fx + b).alias("col"), (F.abs(1 - a - (F.col("y") - fy)) * F.abs(1 - b - (F.col("x") - fx))).alias("w"))
        spread = t.select(key, "target_id", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("c")).select(key, "target_id", "c.*").where("w > 0")
    values = cells.select(key, "row", "col", F.when(~F.isnan(column), F.col(column)).alias("v"))
    found = spread.join(values, [key, "row", "col"], "left")
    out = found.groupBy(key, "target_id").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("v") * F.col("w"))).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("n"))
    return out.select(key, "target_id", (F.col("s") / F.col("n")).alias("value"))


def bbox_targets(spark: SparkSession, bbox: str, width: int, height: int) -> DataFrame:
    """target_id, lat, lon of the pixels of a box `minLon,minLat,maxLon,maxLat`, row by row from the north; corners are pixels."""
    west, south, east, north = (float(x) for x in bbox.split(","))
    if not (west < east and south < north):
        raise ValueError(f"no box: {bbox}")
    y, x = F.floor(F.col("target_id") / width), F.col("target_id") % width
    lat = F.lit(north) - y * (north - south) / max(1, height - 1)
    lon = F.lit(west) + x * (east - west) / max(1, width - 1)
    return spark.range(width * height).withColumnRenamed("id", "target_id").select("target_id", lat.alias("lat"), lon.alias("lon"))


def tile_targets(tiles: DataFrame, size: int = 256) -> DataFrame:
    """tiles (z, x, y of the Web Mercator pyramid, and any more) with target_id, lat, lon of the centre of each of their size x size pixels."""
    out = tiles.withColumn("target_id", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    n = F.pow(F.lit(2.0), F.col("z"))
    py, px = (F.floor(F.col("target_id") / size) + 0.5) / size, (F.col("target_id") % size + 0.5) / size
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (F.col("y") + py) / n))))
    return out.withColumn("lat", lat).withColumn("lon", (F.col("x") + px) / n * 360 - 180)


#: Weights of the risk hint and of the fallback risk.
HINT = {"ice_conc": 0.42, "wave_hs": 0.28, "wind_speed": 0.20, "ais_heatmap": 0.10}


def risk_hint(cells: DataFrame, key: str = KEY) -> DataFrame:
    """cells with hint: a weighted sum of layers scaled by their 2nd and 98th percentiles; 0 on blocked cells. A layer without a value adds nothing."""
    out = cells.withColumn("wind_speed", F.hypot("wind_u10", "wind_v10"))
    out = quantiles_normalize(out, {c: f"__{c}" for c in HINT}, 0.02, 0.98, flat=0.5, key=key)
    hint = sum((F.when(F.col(c).isNull(), 0.0).otherwise(F.col(f"__{c}") * w) for c, w in HINT.items()), F.lit(0.0))
    return out.withColumn("hint", F.when(F.col("blocked") == 1, 0.0).otherwise(hint)).drop(*(f"__{c}" for c in HINT), "wind_speed")


def overlay_channels(base: DataFrame, pulled: DataFrame, key: str = KEY) -> DataFrame:
    """base (key, channel, row, col, value) with the values of the channels that pulled holds; NaN becomes 0."""
    new = pulled.select(key, "channel", "row", "col", F.nanvl("value", F.lit(0.0)).alias("new"))
    return base.join(new, [key, "channel", "row", "col"], "left").select(key, "channel", "row", "col", F.coalesce("new", "value").alias("value"))


def merge_masks(human: DataFrame, suggested: DataFrame, key: str = KEY) -> DataFrame:
    """key, row, col, mask (largest of both), origin (merged, human_only, suggest_only)."""
    both = human.select(key, "row", "col", F.col("mask").alias("h")).join(suggested.select(key, "row", "col", F.col("mask").alias("s")), [key, "row", "col"], "full_outer")
    origin = F.when(F.col("h").isNull(), "suggest_only").when(F.col("s").isNull(), "human_only").otherwise("merged")
    return both.select(key, "row", "col", F.greatest("h", "s").alias("mask"), origin.alias("origin"))
