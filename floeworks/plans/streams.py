"""Queries that work off the tables' files as streams with timers, and the batch twin of run states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..streaming import state as T
from ..streaming import timers as S
from .adapters import adapt, ctes
from .registry import query

STORE = "spark.sql.streaming.stateStore.providerClass"
LATE = 10


def worked_off(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the files of events gives, once they are worked off and the timers up to the watermark have gone off."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be a file or a folder
    at, before = scratch(spark, "timers"), spark.conf.get(STORE, None)
    spark.conf.set(STORE, S.PROVIDER)
    try:
        out = build(events)
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


WATERMARK = f"(SELECT max(ts) - INTERVAL {LATE} MINUTE FROM events)"


@query(
    "stream_circuits",
    ctes("source_events")
    + f""", e AS (SELECT *, lead(ts) OVER w AS next_ts, lead(ok) OVER w AS next_ok, count(*) FILTER (WHERE ok) OVER w AS epoch FROM source_events WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)),
    f AS (SELECT *, row_number() OVER w AS n, lag(ts) OVER w AS before, ts + INTERVAL 1 HOUR AS until FROM e WHERE NOT ok WINDOW w AS (PARTITION BY source, epoch ORDER BY ts, event_id))
    SELECT source, ts AS at, 'opened' AS change, n AS failure_count FROM f WHERE n = 2 OR n > 2 AND before + INTERVAL 1 HOUR <= ts
    UNION ALL SELECT source, next_ts, 'closed by success', 0 FROM f WHERE n >= 2 AND next_ok AND next_ts < until
    UNION ALL SELECT source, until, 'closed by time', n FROM f WHERE n >= 2 AND coalesce(next_ts >= until, until <= {WATERMARK})""",
)
def circuits(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("src"), (F.col("user_id") % 10).cast("string"))
    return worked_off(spark, d, lambda e: S.stream_circuits(e.select(source.alias("source"), "ts", "event_id", (F.col("event_type") != "error").alias("ok")), 2, 3600, LATE))


@query(
    "stream_progress",
    ctes("progress_events")
    + f""", e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM progress_events WINDOW w AS (PARTITION BY progress_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY progress_id ORDER BY ts, event_id) AS entry FROM e),
    s AS (SELECT progress_id, entry, min(ts) AS created_at, max(ts) AS updated_at, arg_max(status, (ts, event_id)) AS status, arg_max(percent, (ts, event_id)) AS percent FROM g GROUP BY 1, 2)
    SELECT progress_id, created_at, updated_at, status, CASE status WHEN 'completed' THEN 100 WHEN 'failed' THEN greatest(least(percent, 100), 1) ELSE greatest(least(percent, 100), 0) END AS percent,
    updated_at + INTERVAL 24 HOUR < {WATERMARK} OR lead(entry) OVER (PARTITION BY progress_id ORDER BY entry) IS NOT NULL AS expired FROM s""",
)
def entries(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    percent = F.floor(F.col("value") / 3).cast("int") - 10
    return S.last_progress(worked_off(spark, d, lambda e: S.stream_progress(e.select(F.col("user_id").alias("progress_id"), "ts", "event_id", status.alias("status"), percent.alias("percent")), 24, LATE)))


STATES = (
    ctes("run_actions").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS i FROM run_actions),
    f AS (SELECT run_id, i, CASE WHEN action = 'create' THEN 'active' END AS state, CASE WHEN action = 'create' THEN ts END AS since FROM r WHERE i = 1
      UNION ALL SELECT run_id, i, coalesce(new, state), CASE WHEN new IS NULL THEN since ELSE ts END FROM (SELECT r.run_id, r.i, r.ts, f.state, f.since, CASE
        WHEN action = 'create' AND coalesce(state, 'purged') = 'purged' THEN 'active' WHEN action = 'delete' AND state = 'active' THEN 'recycled'
        WHEN action = 'restore' AND state = 'recycled' THEN 'active' WHEN action = 'purge' AND state = 'active' THEN 'purged' END AS new FROM f JOIN r ON r.run_id = f.run_id AND r.i = f.i + 1))
    SELECT run_id, arg_max(state, i) AS state, arg_max(since, i) AS since FROM f GROUP BY 1 HAVING max(i) FILTER (WHERE state IS NOT NULL) IS NOT NULL"""
)


@query("stream_lifecycle", STATES)
def lifecycles(spark: SparkSession, d: str) -> DataFrame:
    action = F.create_map(*(F.lit(x) for x in ("signup", "create", "error", "delete", "click", "restore", "purchase", "purge")))[F.col("event_type")]
    changes = worked_off(spark, d, lambda e: S.stream_lifecycle(e.select(F.col("user_id").alias("run_id"), "ts", "event_id", F.coalesce(action, F.lit("touch")).alias("action")), LATE))
    return changes.groupBy("run_id").agg(F.max_by(F.struct("state", "since"), F.struct("since", "event_id")).alias("x")).select("run_id", "x.*")


@query("run_states", STATES)
def run_states(spark: SparkSession, d: str) -> DataFrame:
    return T.run_states(adapt(spark, d, "run_actions"))
