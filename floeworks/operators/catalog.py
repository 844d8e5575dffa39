"""Dataset catalogue: timestamp axes, gaps, manifests, registry, quality checks, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import month_key, stamp
from .selection import quantiles


def expected_axis(ts: DataFrame, step_hours: int = 1) -> DataFrame:
    """All timestamps from the first to the last at the given step; the axis starts at the first one."""
    ends = ts.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.expr(f"sequence(a, b, interval {max(1, step_hours)} hours)")).alias("ts"))


def missing_timestamps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select("ts").subtract(actual.select("ts"))


def available_timestamps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select("ts").intersect(actual.select("ts"))


def union_timeline(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ts").unionByName(b.select("ts")).distinct()


def gap_segments(missing: DataFrame, step_hours: int = 1) -> DataFrame:
    """Islands of consecutive missing steps: first, last, missing_count, missing_hours.

    The order is over distinct missing timestamps, thousands for decades of hours.
    """
    w = W.orderBy("ts")
    step = step_hours * 3600
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    marked = missing.select("ts", F.coalesce((seconds - F.lag(seconds).over(w) != step).cast("int"), F.lit(0)).alias("new"))
    marked = marked.withColumn("island", F.sum("new").over(w))
    out = marked.groupBy("island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("missing_count"))
    return out.select("first", "last", "missing_count", (F.col("missing_count") * step_hours).alias("missing_hours"))


def native_step_hours(ts: DataFrame) -> DataFrame:
    """One row: the upper median of the positive whole-hour differences, 1 without any."""
    w = W.orderBy("ts")
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    d = ts.select("ts").distinct().select(F.floor((s - F.lag(s).over(w)) / 3600).alias("d")).where("d > 0")
    ranked = d.select("d", F.row_number().over(W.orderBy("d")).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    return ranked.agg(F.coalesce(F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col("d"))), F.lit(1)).cast("long").alias("native_step_hours"))


def timestamp_index(ts: DataFrame, step_hours: int = 1) -> DataFrame:
    """One row: counts, coverage, status, native step and months of a timeline against its expected axis."""
    clean = ts.select("ts").distinct()
    axis = expected_axis(clean, step_hours)
    have = axis.join(clean.withColumn("have", F.lit(1)), "ts", "left")
    sums = have.agg(F.count(F.lit(1)).alias("expected_count"), F.count("have").alias("available_count"), F.count_distinct(F.when(F.col("have") == 1, month_key(stamp(F.col("ts"))))).alias("month_count"))
    source = clean.agg(F.count(F.lit(1)).alias("source_count"), F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))
    coverage = F.when(F.col("expected_count") > 0, F.col("available_count") / F.col("expected_count")).otherwise(0.0)
    out = sums.crossJoin(source).crossJoin(native_step_hours(clean))  # one row each
    return out.select(
        "source_count", "expected_count", "available_count",
        (F.col("expected_count") - F.col("available_count")).alias("missing_count"),
        F.round(coverage, 6).alias("coverage"),
        F.when(coverage < 0.75, "fail").when(coverage < 0.95, "warn").otherwise("pass").alias("status"),
        "first_timestamp", "last_timestamp", "native_step_hours", "month_count",
    )


def timeline_gaps(ts: DataFrame) -> DataFrame:
    """from, to, hours of the differences above 1.5 times the median one."""
    w = W.orderBy("ts")
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    d = ts.select("ts").distinct().select(F.lag("ts").over(w).alias("from_ts"), F.col("ts").alias("to_ts"), ((s - F.lag(s).over(w)) / 3.6e9).alias("hours")).where("hours IS NOT NULL")
    mid = d.agg(F.median("hours").alias("mid"))
    return d.crossJoin(F.broadcast(mid)).where("mid > 0 AND hours > mid * 1.5 + 1e-6").drop("mid")  # one row


def nearest_timestamp(wanted: DataFrame, available: DataFrame, by: str | None = None, ranges: int = 256) -> DataFrame:
    """wanted (ts) with the nearest available timestamp, the earlier one of two equally near ones; among those of the same `by` where it is given.

    Both sides are put on one line of distinct timestamps, which is cut into ranges at its quantiles. Within a range the last available at or
    before and the first at or after each point are the candidates; what a range has none of comes from a table with a row for each
    range. No pairs are made, and no task takes the whole line. Null or without any available one: null.
    """
    kind = available.schema["ts"].dataType
    key = F.col(by) if by else F.lit(0)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    have = available.where("ts IS NOT NULL").select(key.alias("__key"), micros.alias("v")).distinct().withColumn("at", F.col("v"))
    asked = wanted.where("ts IS NOT NULL").select(key.alias("__key"), micros.alias("v")).distinct().withColumn("at", F.lit(None).cast("long"))
    both = have.unionByName(asked)
    cuts = both.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    both = both.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x <= F.col("v"))) if cuts else F.lit(0))
    order = W.partitionBy("__key").orderBy("__range")  # over a row for each range
    ends = both.groupBy("__key", "__range").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ends = ends.select(F.col("__key").alias("__key2"), F.col("__range").alias("__range2"), F.last("last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    line = W.partitionBy("__key", "__range")
    # both frames begin at an end of the range: one that ends there is read again for every row
    a, b = (F.last("at", True).over(line.orderBy(o).rangeBetween(W.unboundedPreceding, 0)) for o in (F.asc("v"), F.desc("v")))
    near = both.select("*", a.alias("a"), b.alias("b")).where("at IS NULL").join(ends, F.col("__key").eqNullSafe(F.col("__key2")) & (F.col("__range") == F.col("__range2")))
    a, b = F.coalesce("a", "before"), F.coalesce("b", "after")
    nearest = F.when(b.isNull() | (F.col("v") - a <= b - F.col("v")), F.coalesce(a, b)).otherwise(b)
    near = near.select(F.col("__key").alias("__of"), F.col("v").alias("__v"), F.timestamp_micros(nearest).cast(kind).alias("nearest"))
    out = wanted.select(*([by] if by else []), "ts", micros.alias("__at"), key.alias("__key"))
    return out.join(near, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__at") == F.col("__v")), "left").select(*([by] if by else []), "ts", "nearest")


def manifest_incremental(files: DataFrame, previous: DataFrame, full_scan: bool = False) -> DataFrame:
    """path, size, mtime_ns, hash, reused: the old hash where path, size and time agree, else SHA-256 of text."""
    old = previous.select("path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("hash").alias("old_hash"))
    same = F.lit(not full_scan) & (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime")) & (F.col("old_hash") != "")
    same = F.coalesce(same, F.lit(False))
    return files.join(old, "path", "left").select("path", "size", "mtime_ns", F.when(same, F.col("old_hash")).otherwise(F.sha2("text", 256)).alias("hash"), same.alias("reused"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed)."""
    both = old.select("path", F.col("hash").alias("h0"), F.lit(1).alias("o")).join(new.select("path", F.col("hash").alias("h1"), F.lit(1).alias("n")), "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


LAYERS = ("x_stack", "blocked_mask", "ais_heatmap", "pred", "uncertainty")


def dataset_registry(samples: DataFrame, layers: DataFrame, meta: DataFrame) -> DataFrame:
    """Per sample: has_<layer>, source_ok, completeness_score (of four parts) and is_complete."""
    has = layers.groupBy("sample_id").agg(*(F.max((F.col("layer") == x).cast("int")).alias(f"has_{x}") for x in LAYERS))
    out = samples.join(has, "sample_id", "left").join(meta.select("sample_id", "source_ok"), "sample_id", "left").fillna(0, [f"has_{x}" for x in LAYERS]).withColumn("source_ok", F.coalesce("source_ok", F.lit(False)))
    parts = F.col("has_x_stack") + F.col("has_blocked_mask") + F.col("has_ais_heatmap") + F.col("source_ok").cast("int")
    return out.select("sample_id", *(f"has_{x}" for x in LAYERS), "source_ok", F.round(parts / 4, 6).alias("completeness_score"), (parts == 4).alias("is_complete"))


def layer_availability(samples: DataFrame, layers: DataFrame) -> DataFrame:
    """sample_id, layer, available for every sample and layer."""
    spread = samples.select("sample_id", F.explode(F.array(*map(F.lit, LAYERS))).alias("layer"))
    return spread.join(layers.select("sample_id", "layer").distinct().withColumn("x", F.lit(1)), ["sample_id", "layer"], "left").select("sample_id", "layer", F.col("x").isNotNull().alias("available"))


def coverage_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """dimension, value, n, rate for each key, in one pass over grouping sets."""
    sets = df.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(k).alias(f"g_{k}") for k in keys))
    dimension = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.lit(k)) for k in keys])
    value = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.coalesce(F.col(k).cast("string"), F.lit("unknown"))) for k in keys])
    out = sets.select(dimension.alias("dimension"), value.alias("value"), "n").groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    return out.withColumn("rate", F.round(F.col("n") / F.sum("n").over(W.partitionBy("dimension")), 6))


def dataset_version(registry: DataFrame, columns: list[str]) -> DataFrame:
    """One row, version: `ds-<rows>-<hash>`, `ds-empty` without rows. Rows are hashed one by one and their hashes summed, so no row list is gathered."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    number = F.conv(F.substring(F.sha1(line), 1, 12), 16, 10).cast("decimal(20,0)")
    total = registry.agg(F.count(F.lit(1)).alias("n"), F.sum(number).cast("decimal(38,0)").alias("s"))
    return total.select(F.when(F.col("n") == 0, "ds-empty").otherwise(F.concat(F.lit("ds-"), F.col("n").cast("string"), F.lit("-"), F.substring(F.sha1(F.col("s").cast("string")), 1, 12))).alias("version"))


def registry_summary(registry: DataFrame, time: str = "timestamp") -> DataFrame:
    """dimension (month, source, product_id), value, n, rate of the samples, and on each row the totals: samples, complete ones, their rate, data_version.

    registry has a time string that starts with the month, source, product_id and is_complete.
    """
    rows = registry.withColumn("month", F.substring(time, 1, 7)).withColumn("__done", F.col("is_complete").cast("int"))
    total = rows.agg(F.count(F.lit(1)).alias("total_samples"), F.coalesce(F.sum("__done"), F.lit(0)).cast("long").alias("complete_samples"))
    total = total.withColumn("complete_rate", F.round(F.coalesce(F.col("complete_samples") / F.nullif("total_samples", F.lit(0)), F.lit(0.0)), 6))
    version = dataset_version(rows, [time, "source", "product_id", "__done"]).withColumnRenamed("version", "data_version")
    return coverage_counts(rows, ["month", "source", "product_id"]).crossJoin(total).crossJoin(version)  # one row each


def grid_alignment(shapes: DataFrame) -> DataFrame:
    """sample_id, layer, aligned: does a layer's shape agree with the sample's expected one (by priority of layers)."""
    rank = F.coalesce(*[F.when(F.col("layer") == x, F.lit(i)) for i, x in enumerate(LAYERS)], F.lit(len(LAYERS)))
    expected = shapes.groupBy("sample_id").agg(F.min(F.struct(rank.alias("r"), "h", "w")).alias("e"))
    return shapes.join(expected, "sample_id").select("sample_id", "layer", ((F.col("h") == F.col("e.h")) & (F.col("w") == F.col("e.w"))).alias("aligned"))


def majority_shape(shapes: DataFrame) -> DataFrame:
    """layer, h, w, n, present, consistency: the most frequent shape of each layer (the smallest of equals)."""
    by = shapes.groupBy("layer", "h", "w").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("layer").agg(F.max(F.struct("n", (-F.col("h")).alias("a"), (-F.col("w")).alias("b"))).alias("t"), F.sum("n").alias("present"))
    return top.select("layer", (-F.col("t.a")).alias("h"), (-F.col("t.b")).alias("w"), F.col("t.n").alias("n"), "present", F.round(F.col("t.n") / F.col("present"), 6).alias("consistency"))


#: The checks that block a release.
CRITICAL = ("required_files_coverage", "shape_consistency", "timeline_continuity")


def score_status(c: Column) -> Column:
    return F.when(c >= 0.95, "pass").when(c >= 0.75, "warn").otherwise("fail")


def with_policy(checks: DataFrame) -> DataFrame:
    """checks (name, raw_status) with severity and status: a degradable failure is a warning."""
    severity = F.when(F.col("name").isin(*CRITICAL), "critical").otherwise("degradable")
    return checks.withColumn("severity", severity).withColumn("status", F.when((F.col("raw_status") == "fail") & (F.col("severity") != "critical"), "warn").otherwise(F.col("raw_status")))


def quality_gate(checks: DataFrame) -> DataFrame:
    """One row: status (PASS, WARN, FAIL), block_release, blockers and warnings."""
    blocker = (F.col("severity") == "critical") & (F.col("status") != "pass")
    out = checks.agg(F.sum(blocker.cast("int")).alias("blockers"), F.sum((F.col("status") == "warn").cast("int")).alias("warnings"), F.sum((F.col("status") == "fail").cast("int")).alias("fails"))
    out = out.fillna(0)
    status = F.when(F.col("blockers") > 0, "FAIL").when(F.col("warnings") + F.col("fails") > 0, "WARN").otherwise("PASS")
    return out.select(status.alias("status"), (F.col("blockers") > 0).alias("block_release"), F.col("blockers").cast("long").alias("blockers"), F.col("warnings").cast("long").alias("warnings"), F.col("fails").cast("long").alias("fails"))


def data_quality_checks(samples: DataFrame, layers: DataFrame, times: DataFrame, numeric: DataFrame | None = None) -> DataFrame:
    """name, score, raw_status, severity, status of the checks over samples, layer files and the timeline, and with numeric (numeric_quality()) over values."""
    n = samples.agg(F.count(F.lit(1)).alias("n"))
    have = layers.groupBy("layer").agg(F.count_distinct("sample_id").alias("present"))
    wide = have.agg(*(F.coalesce(F.max(F.when(F.col("layer") == x, F.col("present"))), F.lit(0)).alias(x) for x in LAYERS)).crossJoin(n)
    cover = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n")).otherwise(0.0)
    required = wide.select(F.lit("required_files_coverage").alias("name"), F.least(cover("x_stack"), cover("blocked_mask")).alias("score"), F.lit(0).alias("lazy"))
    auxiliary = wide.select(F.lit("auxiliary_layers_coverage").alias("name"), cover("ais_heatmap").alias("score"), ((cover("pred") < 0.3) | (cover("uncertainty") < 0.2)).cast("int").alias("lazy"))
    shape = majority_shape(layers).agg(F.coalesce(F.min(F.when(F.col("layer").isin("x_stack", "blocked_mask"), F.col("n") / F.col("present"))), F.lit(0.0)).alias("score"))
    shape = shape.select(F.lit("shape_consistency").alias("name"), "score", F.lit(0).alias("lazy"))
    deltas = times.select("ts").distinct().agg((F.count(F.lit(1)) - 1).alias("d"))
    gaps = timeline_gaps(times).agg(F.count(F.lit(1)).alias("g")).crossJoin(deltas)
    timeline = gaps.select(F.lit("timeline_continuity").alias("name"), (1 - F.col("g") / F.greatest(F.col("d"), F.lit(1))).alias("score"), F.lit(0).alias("lazy"))
    all_ = required.unionByName(shape).unionByName(auxiliary).unionByName(timeline)
    if numeric is not None:
        all_ = all_.unionByName(numeric.select(F.lit("numeric_quality_sampled").alias("name"), "score", F.lit(0).alias("lazy")))
    raw = score_status(F.col("score"))
    all_ = all_.select("name", F.round("score", 6).alias("score"), F.when((raw == "pass") & (F.col("lazy") == 1), "warn").otherwise(raw).alias("raw_status"))
    return with_policy(all_)


def numeric_quality(cells: DataFrame, channels: list[str], key: str = "sample_id") -> DataFrame:
    """One row over all maps: maps, mean and p95 of their shares of values that are no finite number, over all cells, sea and land, blocked_mean, channel_counts and score.

    A map's channels are those with a value anywhere. Quantiles are exact and found by counts.
    """
    bad = [(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in channels]
    rows = cells.select(key, (F.col("blocked") > 0).alias("land"), sum(bad[1:], bad[0]).alias("bad"), *(F.col(c).isNotNull().cast("int").alias(f"__{c}") for c in channels))
    share = lambda where: F.sum(F.when(where, F.col("bad"))) / (F.count(F.when(where, 1)) * len(channels))
    by = rows.groupBy(key).agg(share(F.lit(True)).alias("all"), share(~F.col("land")).alias("sea"), share(F.col("land")).alias("on_land"), F.avg(F.col("land").cast("double")).alias("blocked"), sum((F.max(f"__{c}") for c in channels[1:]), F.max(f"__{channels[0]}")).alias("channels"))
    long = by.unpivot([key], ["all", "sea", "on_land"], "metric", "value")
    tops = quantiles(long, ["metric"], "value", {"p95": 0.95})
    tops = tops.agg(*(F.max(F.when(F.col("metric") == m, F.col("p95"))).alias(f"{m}_p95") for m in ("all", "sea", "on_land")))
    out = by.agg(F.count(F.lit(1)).alias("maps"), *(F.avg(m).alias(f"{m}_mean") for m in ("all", "sea", "on_land")), F.coalesce(F.avg("blocked"), F.lit(0.0)).alias("blocked_mean"), F.count_distinct("channels").alias("channel_counts")).crossJoin(tops)  # one row each
    p95 = F.col("all_p95")
    score = F.when(p95.isNull(), 0.0).when(p95 > 0.6, 0.5).when(p95 > 0.4, 0.75).when(p95 > 0.3, 0.9).otherwise(1.0)
    score = score * F.when(F.col("sea_p95") > 0.65, 0.8).otherwise(1.0) * F.when(F.col("channel_counts") > 1, 0.7).otherwise(1.0)
    names = {"all": "nan_ratio", "sea": "sea_nan_ratio", "on_land": "land_nan_ratio"}
    return out.select("maps", *(F.round(f"{m}_{x}", 6).alias(f"{n}_{x}") for m, n in names.items() for x in ("mean", "p95")), F.round("blocked_mean", 6).alias("blocked_ratio_mean"), "channel_counts", F.round(score, 6).alias("score"))


def numbered(df: DataFrame, *order: str, into: str = "i", ranges: int = 256) -> DataFrame:
    """df with the place of each row (from 0) in the order of columns; equal rows in any order.

    Fewer than `ranges` keys, drawn by hash, cut the order into ranges; a row's place is the count of the ranges before
    its own and its place inside, so no task holds more than a range. A hash of the whole row is the last key, so rows that
    are equal in the order's columns only are cut too.
    """
    whole = df.withColumn("__tie", F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]))
    places = [*order, "__tie"]
    keys = whole.select(*places).distinct()
    cuts = sorted(keys.orderBy(F.xxhash64(*places), *places).limit(ranges - 1).collect(), key=lambda r: [(v is not None, v) for v in r])
    types = dict(whole.select(*places).dtypes)
    place = F.struct(*(F.col(c) for c in places))
    bounds = [F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(places, r, strict=True))) for r in cuts]
    part = whole.withColumn("__range", F.size(F.filter(F.array(*bounds), lambda x: x <= place)) if bounds else F.lit(0))
    sums = part.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).selectExpr("__range", "sum(n) OVER (ORDER BY __range) - n AS __before")  # a row for each range
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*places)) - 1
    return part.join(F.broadcast(sums), "__range").withColumn(into, F.col("__before") + inside).select(*df.columns, into)


def spread_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows evenly spread over the order: those at floor(i * (n - 1) / (k - 1)); all rows if they are not more."""
    n = df.count()
    if n <= k:
        return df
    picks = sorted({i * (n - 1) // max(1, k - 1) for i in range(k)})
    return numbered(df, order, into="__i").where(F.col("__i").isin(picks)).drop("__i")


def timeline_windows(ts: DataFrame, width: int, stride: int) -> DataFrame:
    """window_id, position, ts: windows of `width` consecutive timestamps, each `stride` after the last."""
    ranked = ts.select("ts").distinct().withColumn("i", F.row_number().over(W.orderBy("ts")) - 1)
    n = F.count(F.lit(1)).over(W.partitionBy())
    ranked = ranked.withColumn("windows", F.greatest(F.lit(0), F.floor((n - width) / stride) + 1))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / stride))
    last = F.least(F.floor(F.col("i") / stride), F.col("windows") - 1)
    spread = ranked.where(first <= last).select("ts", "i", F.explode(F.sequence(first, last)).alias("window_id"))
    return spread.select(F.col("window_id").cast("long").alias("window_id"), (F.col("i") - F.col("window_id") * stride).cast("long").alias("position"), "ts")


def anchor_window(ts: DataFrame, anchor: Column, width: int) -> DataFrame:
    """The anchor and what follows up to width timestamps, filled up with those before it; ascending."""
    ranked = ts.select("ts").distinct().withColumn("after", F.col("ts") >= anchor)
    order = W.partitionBy("after").orderBy(F.when(F.col("after"), F.unix_seconds(F.col("ts").cast("timestamp"))).otherwise(-F.unix_seconds(F.col("ts").cast("timestamp"))))
    ranked = ranked.withColumn("k", F.row_number().over(order))
    return ranked.orderBy(F.desc("after"), "k").limit(width).select("ts")


def page(df: DataFrame, order: list[str], page_no: int, size: int) -> DataFrame:
    """Rows of one page (from 1, clamped) with total and pages; a deep page gathers no rows of those before it."""
    size = max(1, size)
    total = df.count()
    pages = max(1, -(-total // size))
    page_no = min(max(1, page_no), pages)
    rows = numbered(df, *order, into="__i").where(F.col("__i").between((page_no - 1) * size, page_no * size - 1)).orderBy(*order).drop("__i")
    return rows.withColumn("total", F.lit(total).cast("long")).withColumn("pages", F.lit(pages).cast("long"))


def source_meta_check(df: DataFrame, fields: tuple[str, ...] = ("source", "product_id", "valid_time", "ingested_at")) -> DataFrame:
    """df with missing (array of the blank required fields) and ok."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) == "", F.lit(f)) for f in fields]))
    return df.withColumn("missing", missing).withColumn("ok", F.size("missing") == 0)


def source_meta_backfill(df: DataFrame, source: str = "unknown", product_id: str = "unknown", now: str = "") -> DataFrame:
    """Blank required fields get fallback values; valid_time comes from the timestamp."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return (
        df.withColumn("source", F.coalesce(blank("source"), F.lit(source)))
        .withColumn("product_id", F.coalesce(blank("product_id"), F.lit(product_id)))
        .withColumn("valid_time", F.coalesce(blank("valid_time"), F.col("timestamp")))
        .withColumn("ingested_at", F.coalesce(blank("ingested_at"), F.lit(now)))
    )


def resolve_sources(wanted: DataFrame, existing: DataFrame, candidates: DataFrame, fresh: str = "fresh") -> DataFrame:
    """ts, resolved, source: a fresh existing sample, else the primary or snapshot candidate, a stale sample, the nearest."""
    near = nearest_timestamp(wanted, existing.select("ts"))
    flags = candidates.groupBy("ts").agg(F.max((F.col("kind") == "primary").cast("int")).alias("p"), F.max((F.col("kind") == "snapshot").cast("int")).alias("s"))
    out = near.join(existing.select("ts", fresh, F.lit(1).alias("e")), "ts", "left").join(flags, "ts", "left")
    source = F.when((F.col("e") == 1) & F.col(fresh), "local_existing").when(F.col("p") == 1, "primary").when(F.col("s") == 1, "snapshot").when(F.col("e") == 1, "stale_local_existing").otherwise("nearest_local_fallback")
    return out.select("ts", F.when(source == "nearest_local_fallback", F.col("nearest")).otherwise(F.col("ts")).alias("resolved"), source.alias("source"))


def contract_checks(files: DataFrame, samples: DataFrame, required: tuple[str, ...] = ("x_stack", "blocked_mask")) -> DataFrame:
    """sample_id, layer of every required file that is missing."""
    want = samples.select("sample_id", F.explode(F.array(*map(F.lit, required))).alias("layer"))
    return want.join(files.select("sample_id", "layer").distinct(), ["sample_id", "layer"], "left_anti")


def month_audit(times: DataFrame, per_day: int = 4) -> DataFrame:
    """month, actual, expected, complete: distinct timestamps per month against per_day a day."""
    by = times.select(F.trunc("ts", "month").alias("month"), "ts").groupBy("month").agg(F.count_distinct("ts").alias("actual"))
    expected = F.day(F.last_day("month")) * per_day
    return by.select(F.date_format("month", "yyyy-MM").alias("month"), "actual", expected.cast("long").alias("expected"), (F.col("actual") >= expected).alias("complete"))


#: Names of timestamp folders and of prediction files.
TIMESTAMP_NAME = r"^\d{4}-\d{2}-\d{2}_\d{2}$"
PREDICTION_NAME = r"^\d{4}-\d{2}-\d{2}_\d{2}(_uncertainty)?\.npy$"


def naming_check(names: DataFrame, pattern: str, check: str) -> DataFrame:
    """One row of a check over names (name): check, status (warn if a name doesn't fit the pattern), total, invalid."""
    out = names.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(F.col("name").rlike(pattern), F.lit(False))).alias("invalid"))
    return out.select(F.lit(check).alias("check"), F.when(F.col("invalid") > 0, "warn").otherwise("pass").alias("status"), "total", "invalid")


def array_failures(samples: DataFrame, arrays: DataFrame, stack: str = "x_stack", mask: str = "blocked_mask") -> DataFrame:
    """sample_id, reason of samples whose arrays (sample_id, layer, dims array<int>, dtype) break the contract.

    missing_required, x_stack_not_3d, blocked_not_2d, shape_mismatch (rows and columns of both differ); a sample with missing arrays has that reason only.
    """
    of = lambda layer: F.max(F.when(F.col("layer") == layer, F.col("dims")))
    by = samples.select("sample_id").distinct().join(arrays.groupBy("sample_id").agg(of(stack).alias("x"), of(mask).alias("b")), "sample_id", "left")
    missing, flat, deep = F.col("x").isNull() | F.col("b").isNull(), F.size("x") != 3, F.size("b") != 2
    reasons = F.array(F.when(missing, "missing_required"), F.when(~missing & flat, "x_stack_not_3d"), F.when(~missing & deep, "blocked_not_2d"), F.when(~missing & ~flat & ~deep & (F.slice("x", 2, 2) != F.col("b")), "shape_mismatch"))
    return by.select("sample_id", F.explode(F.array_compact(reasons)).alias("reason"))


def array_check(samples: DataFrame, arrays: DataFrame, stack: str = "x_stack", mask: str = "blocked_mask") -> DataFrame:
    """One row: the consistency check over all samples (fail with any failure, warn if types, channel counts or shapes differ) with its counts of kinds."""
    failures = array_failures(samples, arrays, stack, mask).agg(F.count(F.lit(1)).alias("failures"))
    whole = arrays.groupBy("sample_id").agg(F.count_if(F.col("layer") == stack).alias("s"), F.count_if(F.col("layer") == mask).alias("m")).where("s > 0 AND m > 0")
    full = arrays.where(F.col("layer").isin(stack, mask)).join(whole.select("sample_id"), "sample_id", "left_semi")
    is_stack = F.col("layer") == stack
    shape = F.when(is_stack & (F.size("dims") == 3), F.slice("dims", 2, 2)).when(~is_stack & (F.size("dims") == 2), F.col("dims"))
    kinds = full.agg(
        F.count_distinct(F.when(is_stack, F.col("dtype"))).alias("stack_types"), F.count_distinct(F.when(~is_stack, F.col("dtype"))).alias("mask_types"),
        F.count_distinct(F.when(is_stack & (F.size("dims") == 3), F.get("dims", F.lit(0)))).alias("channel_counts"), F.count_distinct(shape).alias("shapes"),
    )
    out = kinds.crossJoin(failures).crossJoin(samples.agg(F.count_distinct("sample_id").alias("total")))  # one row each
    differ = F.greatest("stack_types", "mask_types", "channel_counts", "shapes") > 1
    return out.select(F.lit("sample_shape_dtype_consistency").alias("check"), F.when(F.col("failures") > 0, "fail").when(differ, "warn").otherwise("pass").alias("status"), "total", "failures", "stack_types", "mask_types", "channel_counts", "shapes")


def contract_report(folders: DataFrame, predictions: DataFrame, heatmaps: DataFrame, samples: DataFrame, arrays: DataFrame) -> DataFrame:
    """check, status, total, invalid of the naming checks (folders, prediction files, heat maps without their ending; all by name) and of the arrays."""
    names = naming_check(folders, TIMESTAMP_NAME, "timestamp_dir_naming").unionByName(naming_check(predictions, PREDICTION_NAME, "pred_file_naming"))
    names = names.unionByName(naming_check(heatmaps, TIMESTAMP_NAME, "ais_heatmap_file_naming"))
    return names.unionByName(array_check(samples, arrays).select("check", "status", "total", F.col("failures").alias("invalid")))


def sample_audit(samples: DataFrame, files: DataFrame, required: tuple[str, ...], shape_of: str, per_day: int = 4) -> DataFrame:
    """month, expected, actual, complete, shapes, ok of samples (sample_id, ts) and their files (sample_id, layer, h, w).

    complete counts samples with all required files, shapes the different shapes of the layer shape_of among them; a month is ok with at least per_day
    samples a day, all complete, of one shape.
    """
    have = files.groupBy("sample_id").agg(F.count_distinct(F.when(F.col("layer").isin(*required), F.col("layer"))).alias("n"), F.max(F.when(F.col("layer") == shape_of, F.struct("h", "w"))).alias("shape"))
    full = F.coalesce(F.col("n") == len(required), F.lit(False))
    by = samples.join(have, "sample_id", "left").groupBy(F.trunc("ts", "month").alias("month")).agg(F.count(F.lit(1)).alias("actual"), F.count_if(full).alias("complete"), F.count_distinct(F.when(full, F.col("shape"))).alias("shapes"))
    expected = (F.day(F.last_day("month")) * per_day).cast("long")
    ok = (F.col("actual") >= expected) & (F.col("complete") == F.col("actual")) & (F.col("shapes") == 1)
    return by.select(F.date_format("month", "yyyy-MM").alias("month"), expected.alias("expected"), "actual", "complete", "shapes", ok.alias("ok"))


def map_audit(cells: DataFrame) -> DataFrame:
    """tag, maps, months, low, high, has_nan, shapes, ok of stored maps (tag, ts, row, col, value): ok with one shape and no NaN. low and high leave NaN out."""
    v = F.when(~F.isnan("value"), F.col("value"))
    maps = cells.groupBy("tag", "ts").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.max(F.isnan("value").cast("int")).alias("nan"), F.struct(F.max("row").alias("h"), F.max("col").alias("w")).alias("shape"))
    by = maps.groupBy("tag").agg(F.count(F.lit(1)).alias("maps"), F.count_distinct(F.trunc("ts", "month")).alias("months"), F.min("low").alias("low"), F.max("high").alias("high"), (F.max("nan") == 1).alias("has_nan"), F.count_distinct("shape").alias("shapes"))
    return by.withColumn("ok", ~F.col("has_nan") & (F.col("shapes") == 1))
