"""Keyed operational state: batch forms over event tables, and stream jobs of equal result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from ..functions.grid import Grid, to_cell
from ..operators.automaton import scan


def source_health(events: DataFrame, now: Column, threshold: int = 3, cooldown_sec: int = 600) -> DataFrame:
    """Per source: failure_count since the last success, its last failure and success, circuit_open, retry_after_sec.

    A failure that brings the count to the threshold or beyond opens the circuit until cooldown later; it
    closes by time without a reset of the count, so one more failure opens it again. Sums are by key: the last
    success of a source first, then the failures after it.
    """
    e = events.select("source", F.struct("ts", "event_id").alias("at"), "ts", "ok")
    last = e.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    after = e.join(last, "source").where(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))))
    fails = after.groupBy("source").agg(F.count(F.lit(1)).alias("failure_count"), F.max("ts").alias("last_failure_at"))
    out = last.join(fails, "source", "left").select("source", F.coalesce("failure_count", F.lit(0)).cast("long").alias("failure_count"), "last_failure_at", F.col("last_ok.ts").alias("last_success_at"))
    until = F.unix_micros(F.col("last_failure_at").cast("timestamp")) + cooldown_sec * 1_000_000
    left = until - F.unix_micros(now.cast("timestamp"))
    is_open = F.coalesce((F.col("failure_count") >= threshold) & (left > 0), F.lit(False))
    return out.withColumn("circuit_open", is_open).withColumn("retry_after_sec", F.when(is_open, F.greatest(F.lit(1), F.floor(left / 1_000_000))).otherwise(0).cast("long"))


def source_credibility(health: DataFrame) -> DataFrame:
    """One row: healthy, degraded, blocked, level."""
    out = health.agg(F.count_if(~F.col("circuit_open") & (F.col("failure_count") == 0)).alias("healthy"), F.count_if(~F.col("circuit_open") & (F.col("failure_count") > 0)).alias("degraded"), F.count_if("circuit_open").alias("blocked"))
    return out.withColumn("level", F.when(F.col("blocked") > 0, "high_risk").when(F.col("degraded") > 0, "medium_risk").otherwise("normal"))


def stream_source_health(events: DataFrame) -> DataFrame:
    """events (source, ts, event_id, ok) as a stream -> failure_count and last times of each source that a batch touches.

    State per source is three values; within a batch events are taken in order of ts and event_id.
    """
    schema = "source string, failure_count long, last_failure_at timestamp, last_success_at timestamp"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, fail, good = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        ok = rows["ok"].to_numpy()
        if ok.any():
            at = len(ok) - 1 - ok[::-1].argmax()
            good, tail = rows["ts"].iloc[at].to_pydatetime(), rows.iloc[at + 1 :]
            count = 0
            fail = None
        else:
            tail = rows
        if len(tail):
            count, fail = count + len(tail), tail["ts"].iloc[-1].to_pydatetime()
        state.update((count, fail, good))
        yield pd.DataFrame({"source": [key[0]], "failure_count": [count], "last_failure_at": pd.to_datetime([fail]), "last_success_at": pd.to_datetime([good])})

    return events.groupBy("source").applyInPandasWithState(step, schema, "count long, fail timestamp, good timestamp", "update", GroupStateTimeout.NoTimeout)


def progress_state(events: DataFrame, now: Column, retention_hours: int = 24, max_entries: int = 200, recover: bool = False) -> DataFrame:
    """Latest state per progress_id: status, percent (clamped; 100 when completed, at least 1 when failed), updated_at; old ones and all but the newest max_entries are dropped.

    With recover, running ones count as failed by the restart.
    """
    last = events.groupBy("progress_id").agg(F.max(F.struct("ts", "event_id", "status", "percent")).alias("x")).select("progress_id", "x.*")
    status = F.when(F.lit(recover) & (F.col("status") == "running"), "failed").otherwise(F.col("status"))
    percent = F.least(F.greatest("percent", F.lit(0)), F.lit(100))
    percent = F.when(F.col("status") == "completed", 100).when(status == "failed", F.greatest(percent, F.lit(1))).otherwise(percent)
    out = last.select("progress_id", status.alias("status"), percent.cast("int").alias("percent"), F.col("ts").alias("updated_at"))
    cutoff = now.cast("timestamp") - F.expr(f"interval {max(1, retention_hours)} hours")
    return out.where(F.col("updated_at").cast("timestamp") >= cutoff).orderBy(F.desc("updated_at"), "progress_id").limit(max_entries)


def run_lifecycle(events: DataFrame) -> DataFrame:
    """run_id, state (active or recycled), since: the last deciding event of each run; a restore counts only after a delete, a run needs a create.

    A sum by run keeps the last create, delete and restore; no run's events are gathered.
    """
    at = F.struct("ts", "event_id")
    by = events.groupBy("run_id").agg(*(F.max(F.when(F.col("action") == a, at)).alias(a) for a in ("create", "delete", "restore")), F.min(F.when(F.col("action") == "create", at)).alias("first"))
    by = by.where("first IS NOT NULL")
    gone = F.coalesce((F.col("delete") > F.col("first")) & (F.col("restore").isNull() | (F.col("restore") < F.col("delete"))), F.lit(False))
    back = F.coalesce((F.col("delete") > F.col("first")) & (F.col("restore") > F.col("delete")), F.lit(False))
    since = F.when(gone, F.col("delete.ts")).when(back, F.col("restore.ts")).otherwise(F.col("first.ts"))
    return by.select("run_id", F.when(gone, "recycled").otherwise("active").alias("state"), since.alias("since"))


#: The states a run can be in, and what each action makes of them.
RUN_STATES = (None, "active", "recycled", "purged")
RUN_ACTIONS = {"create": (1, 1, 2, 1), "delete": (0, 2, 2, 3), "restore": (0, 1, 1, 3), "purge": (0, 3, 2, 3), None: (0, 1, 2, 3)}


def run_states(events: DataFrame) -> DataFrame:
    """run_id, state (active, recycled, purged), since of the runs that were ever created, by their events in order.

    create makes a run active, delete recycles it, restore brings it back, purge (a hard delete, of an active run only) ends it until it
    is created again. The events of a run pass a finite automaton by blocks, so a run of very many is no single fold.
    """
    w = W.partitionBy("run_id").orderBy("ts", "event_id")
    rows = events.where("run_id IS NOT NULL").select("run_id", "ts", "action", (F.row_number().over(w) - 1).alias("i"))
    names = [a for a in RUN_ACTIONS if a]
    symbol = F.coalesce(*[F.when(F.col("action") == a, i) for i, a in enumerate(names)], F.lit(len(names)))
    table = [list(RUN_ACTIONS[a]) for a in (*names, None)]
    out = scan(rows, "run_id", "i", symbol, table, 0)
    after = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in table]), symbol + 1), F.col("state") + 1)
    last = out.withColumn("after", after).where("after <> state").groupBy("run_id").agg(F.max_by(F.struct("after", "ts"), "i").alias("x"))
    return last.select("run_id", F.element_at(F.array(*map(F.lit, RUN_STATES)), F.col("x.after") + 1).alias("state"), F.col("x.ts").alias("since"))


def freshness(meta: DataFrame, now: Column, warn_hours: float = 24.0, hard_hours: float = 72.0) -> DataFrame:
    """meta (layer, ts) with age_hours, status (fresh, stale, outdated, unknown) and actions."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9)
    status = F.when(age.isNull() | F.col("ts").isNull(), "unknown").when(age <= warn_hours, "fresh").when(age <= hard_hours, "stale").otherwise("outdated")
    actions = F.when(status == "fresh", "").when(status == "stale", "switch_conservative,raise_risk_weight").when(status == "outdated", "switch_conservative,freeze_dynamic_replan,mark_result_low_confidence").otherwise("mark_result_unknown_freshness")
    return meta.withColumn("age_hours", F.when(F.col("ts").isNotNull(), age)).withColumn("status", status).withColumn("actions", actions)


def worst_freshness(layers: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "unknown", 3).when(F.col("status") == "outdated", 2).when(F.col("status") == "stale", 1).otherwise(0)
    return layers.agg(F.max(rank).alias("r")).select(F.element_at(F.array(*map(F.lit, ("fresh", "stale", "outdated", "unknown"))), F.coalesce("r", F.lit(3)) + 1).alias("overall"))


def risk_budget_modes(steps: DataFrame, budget: float, warn_ratio: float = 0.7, hard_ratio: float = 1.0, modes: tuple[str, str, str] = ("balanced", "conservative", "aggressive"), min_interval: int = 1) -> DataFrame:
    """steps (sequence_id, step_index from 0, risk_extra_km) with usage before the step, stage (normal, warn, hard), the mode in force, previous_mode and switched.

    A sequence starts in the first mode and takes the mode of its stage, but not before min_interval steps after its last switch.
    Mode and steps since then (up to the interval) are the states of an automaton, whose maps are composed by blocks.
    """
    w = W.partitionBy("sequence_id").orderBy("step_index")
    used = F.coalesce(F.sum("risk_extra_km").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    usage = F.greatest(F.lit(0.0), used / budget) if budget > 1e-8 else F.lit(0.0)
    stage = F.when(F.col("usage") >= hard_ratio, "hard").when(F.col("usage") >= warn_ratio, "warn").otherwise("normal")
    names, gap = list(dict.fromkeys(modes)), max(1, min_interval)
    base, warn, hard = (names.index(m) for m in modes)
    wanted = F.when(F.col("stage") == "hard", hard).when(F.col("stage") == "warn", warn).otherwise(base)

    def after(state: int, target: int) -> int:
        mode, steps_since = divmod(state, gap)
        return target * gap if target != mode and steps_since == gap - 1 else mode * gap + min(steps_since + 1, gap - 1)

    table = [[after(s, t) for s in range(len(names) * gap)] for t in range(len(names))]
    out = scan(steps.withColumn("usage", usage).withColumn("stage", stage), "sequence_id", "step_index", wanted, table, base * gap + gap - 1)
    before = F.floor(F.col("state") / gap)
    switched = (wanted != before) & (F.col("state") % gap == gap - 1)
    name = lambda i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    return out.withColumn("switched", switched).withColumn("previous_mode", name(before)).withColumn("mode", F.when(F.col("switched"), name(wanted)).otherwise(F.col("previous_mode"))).drop("state")


def risk_switch_events(modes: DataFrame, min_interval: int = 1) -> DataFrame:
    """The switches among what risk_budget_modes gives: from_mode, to_mode, budget_stage, budget_usage, cooldown_steps."""
    return modes.where("switched").select("sequence_id", "step_index", F.col("previous_mode").alias("from_mode"), F.col("mode").alias("to_mode"), F.col("stage").alias("budget_stage"), F.round("usage", 6).alias("budget_usage"), F.lit(max(1, min_interval)).alias("cooldown_steps"))


def sequence_steps(steps: DataFrame) -> DataFrame:
    """steps with cumulative distance and run time, and is_last."""
    w = W.partitionBy("sequence_id").orderBy("step_index")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("total_km", F.sum("moved_distance_km").over(run)).withColumn("total_ms", F.sum("runtime_ms").over(run)).withColumn("is_last", F.lead("step_index").over(w).isNull())


def replan_triggers(steps: DataFrame, blocked_ratio: float = 0.02, corridor_min: float = 0.05, risk_spike: float = 0.05, max_skip: int = 3, always: bool = False) -> DataFrame:
    """steps (sequence_id, step_index from 0, blocked_change, path_blocked, corridor, risk) with reasons and replan.

    Three more columns are read where they are there: cached_cells (below 2: no_cached_path, and 0: the path's own reasons don't hold),
    switched (risk_mode_switch) and stage (hard: risk_budget_pressure), as risk_budget_modes gives them; these two count at the first
    step too. With always every later step is due. Whether a step is due because of the steps skipped before it depends on the decisions before;
    the steps since the last replanning, up to max_skip, are the states of an automaton, whose maps are composed by blocks.
    """
    w = W.partitionBy("sequence_id").orderBy("step_index")
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in steps.columns else F.lit(other)
    later, path = F.col("step_index") > 0, has("cached_cells", 0 if "cached_cells" in steps.columns else 2)
    of_path = {
        "no_cached_path": path < 2,
        "blocked_change_ratio": (F.col("blocked_change") > 0) & (F.col("blocked_change") >= blocked_ratio),
        "path_blocked": (path > 0) & (F.col("path_blocked") > 0),
        "corridor_mismatch": (path > 0) & (F.col("corridor") < corridor_min),
        "risk_spike": (path > 0) & (F.col("risk") - F.lag("risk").over(w) >= risk_spike),
    }
    base = F.array(F.when(~later, "initial_step"), *([F.when(later, "always_mode")] if always else [F.when(later & x, n) for n, x in of_path.items()]))
    more = F.array(F.when(has("switched", False), "risk_mode_switch"), F.when(has("stage", "") == "hard", "risk_budget_pressure"))
    marked = steps.select("sequence_id", F.col("step_index").cast("int").alias("step_index"), F.array_compact(base).alias("base"), F.array_compact(more).alias("more"))
    most = max(1, max_skip)
    table = [[0, *range(2, most + 1), 1], [1] * (most + 1)]  # state 0: never yet
    out = scan(marked, "sequence_id", "step_index", ((F.size("base") > 0) | (F.size("more") > 0)).cast("int"), table, 0)
    due = F.when((F.col("state") == most) & later & F.lit(not always), F.array(F.lit("max_skip_steps"))).otherwise(F.array().cast("array<string>"))
    return out.select("sequence_id", "step_index", F.concat("base", due, "more").alias("reasons")).withColumn("replan", F.size("reasons") > 0)


def stream_heatmap(ais: DataFrame, grid: Grid, window_hours: int = 168, step_hours: int = 6, late_hours: int = 24) -> DataFrame:
    """Sliding counts per cell of a position stream, each window once its end is late_hours behind (append mode); later rows are dropped.

    Positions are counted by step and cell first; only those counts are repeated for the windows they lie in. Where the
    step does not divide the window, positions go to their windows one by one.
    """
    row, col = to_cell(F.col("lat"), F.col("lon"), grid)
    cells = ais.select(F.col("postime").cast("timestamp").alias("t"), row.alias("row"), col.alias("col")).where("row IS NOT NULL").withWatermark("t", f"{late_hours} hours")
    if window_hours % step_hours:
        w = F.window("t", f"{window_hours} hours", f"{step_hours} hours")
        return cells.groupBy(w, "row", "col").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("center"), "row", "col", "n")
    steps = cells.groupBy(F.window("t", f"{step_hours} hours").alias("step"), "row", "col").agg(F.count(F.lit(1)).alias("n"))
    w = F.window("step", f"{window_hours} hours", f"{step_hours} hours")
    return steps.groupBy(w, "row", "col").agg(F.sum("n").alias("n")).select(F.col("window.end").alias("center"), "row", "col", "n")


def replay_slice(steps: DataFrame, from_step: int, to_step: int) -> DataFrame:
    """The steps of each sequence between two indices, with next_step (null at the end of the sequence)."""
    w = W.partitionBy("sequence_id").orderBy("step_index")
    return steps.withColumn("next_step", F.lead("step_index").over(w)).where(F.col("step_index").between(from_step, to_step))


def sequence_issues(steps: DataFrame) -> DataFrame:
    """Per sequence: steps, and issues (gaps in the index, a first step other than 0, negative distances)."""
    by = steps.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("steps"), F.min("step_index").alias("a"), F.max("step_index").alias("b"), F.count_distinct("step_index").alias("kinds"), F.min("moved_distance_km").alias("least"))
    issues = F.array_compact(F.array(F.when(F.col("a") != 0, "first_step_not_zero"), F.when((F.col("kinds") != F.col("steps")) | (F.col("b") - F.col("a") + 1 != F.col("kinds")), "step_gap_or_repeat"), F.when(F.col("least") < 0, "negative_distance")))
    return by.select("sequence_id", "steps", issues.alias("issues"))


def stream_latest(events: DataFrame, key: str, path: str, checkpoint: str):  # noqa: ANN201
    """Start a query that keeps the latest event (ts, event_id) of each key of a stream as a table under path/<batch>.

    Each batch merges its own latest rows into the table before it and writes the next version; a batch that is repeated
    after a failure writes the same version again, so the result is exact. The version before the last is kept for
    such a repeat, older ones are deleted.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number:
            new = spark.read.parquet(f"{path}/{number - 1}").unionByName(batch)
        rest = [c for c in batch.columns if c not in (key, "ts", "event_id")]
        last = new.groupBy(key).agg(F.max(F.struct("ts", "event_id", *rest)).alias("x")).select(key, "x.*")
        last.write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).start()
