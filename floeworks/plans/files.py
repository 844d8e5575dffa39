"""Queries that write tables as the domain's files and read them through its readers, and a stream over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators.heatmap import ais_heatmap_counts, normalize_heatmap
from ..sources import files as S
from ..sources.scratch import scratch
from ..streaming.state import stream_heatmap
from .adapters import adapt, ctes
from .experiments import BENCH, rounded
from .registry import query


@query("read_ais_csv", ctes("ais") + "SELECT mmsi, date_trunc('second', postime) AS postime, round(lon, 5) AS lon, round(lat, 5) AS lat, CAST(event_id AS VARCHAR) AS status FROM ais WHERE event_id % 50 <> 3")
def positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions as CSV; every fiftieth longitude is no number."""
    rows = adapt(spark, d, "ais")
    lon = F.when(F.col("event_id") % 50 == 3, "none").otherwise(F.round("lon", 5).cast("string"))
    text = rows.select("mmsi", F.date_format("postime", "yyyy-MM-dd HH:mm:ss").alias("postime"), lon.alias("lon"), F.round("lat", 5).alias("lat"), F.col("event_id").alias("status"), *(F.lit(None).cast("string").alias(c) for c in S.AIS_COLUMNS[5:]))
    path = scratch(spark, "ais")
    text.select(*S.AIS_COLUMNS).write.option("header", True).csv(path)
    return rounded(S.read_ais_csv(spark, path).select("mmsi", "postime", "lon", "lat", "status"), "lon", "lat", digits=5)


@query("read_manifest", ctes("manifest_new") + "SELECT path, size, mtime_ns, sha1(path) AS hash, month AS timestamp, source FROM manifest_new WHERE mtime_ns % 10 <> 7")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest as JSON lines; some paths have back-slashes, every tenth line has none."""
    rows = adapt(spark, d, "manifest_new").withColumn("hash", F.sha1("path"))
    path = F.when(F.col("mtime_ns") % 10 == 7, "").when(F.col("mtime_ns") % 3 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    at = scratch(spark, "manifest")
    S.write_manifest(rows.withColumn("path", path).withColumnRenamed("month", "timestamp"), at)
    return S.read_manifest(spark, at).select("path", "size", "mtime_ns", "hash", "timestamp", "source")


@query("read_bench", BENCH + "SELECT run_id, mode, planner, status, round(runtime_ms, 4) AS runtime_ms, replan_count FROM bench")
def runs(spark: SparkSession, d: str) -> DataFrame:
    """Payload files of a thousand runs each."""
    rows = adapt(spark, d, "bench").select("run_id", "mode", "planner", "status", "runtime_ms", "replan_count")
    packed = rows.groupBy(F.floor(F.col("run_id") / 1000).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("rows"))).alias("value"))
    path = scratch(spark, "bench")
    S.write_texts(packed.select(F.concat("part", F.lit(".json")).alias("name"), "value"), path)
    return rounded(S.read_bench(spark, path, rows.schema).select(*rows.columns), "runtime_ms", digits=4)


@query("read_run_records", ctes("run_events") + "SELECT run_id, count(*) AS events, max(event_id) AS last FROM run_events WHERE run_id % 10 <> 0 GROUP BY 1")
def records(spark: SparkSession, d: str) -> DataFrame:
    """A file for each run; every tenth is broken."""
    by = adapt(spark, d, "run_events").groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last"))
    text = F.to_json(F.struct("run_id", "events", "last"))
    path = scratch(spark, "runs")
    S.write_texts(by.select(F.concat("run_id", F.lit(".txt")).alias("name"), F.when(F.col("run_id") % 10 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value")), path)
    return S.read_run_records(spark, path, "run_id long, events long, last long", "*.txt").select("run_id", "events", "last")


WEEK = Grid()
HEATED = (
    ctes("ais")
    + """, p AS (SELECT *, least(CAST(floor((86e0 - lat) / 26e0 * 52) AS INTEGER), 51) AS row, least(CAST(floor((lon + 180e0) / 360e0 * 360) AS INTEGER), 359) AS col FROM ais WHERE lat BETWEEN 60 AND 86 AND lon BETWEEN -180 AND 180),
    c AS (SELECT TIMESTAMP '2024-01-01' + INTERVAL 6 HOUR * k AS center FROM range(0, 124) r(k))\n"""
)


@query(
    "stream_heatmap",
    HEATED
    + """, w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', (SELECT max(postime) + INTERVAL 168 HOUR FROM ais), INTERVAL 6 HOUR)) AS center)
    SELECT center, row, col, count(*) AS n FROM w JOIN p ON postime >= center - INTERVAL 168 HOUR AND postime < center WHERE center <= (SELECT max(postime) FROM ais) - INTERVAL 24 HOUR GROUP BY 1, 2, 3""",
)
def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The table's files as a stream of positions, worked off; windows that end a day before the last position have been given."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be a file or a folder
    lon = -180.0 + 36.0 * (F.col("user_id") % 10) + F.col("value") / 20.0
    lat = F.when(F.col("user_id") % 50 == 7, 50.0).otherwise(60.0 + 2.5 * (F.col("user_id") % 10) + F.col("value") / 200.0)
    maps = stream_heatmap(e.select(F.col("ts").alias("postime"), lon.alias("lon"), lat.alias("lat")), WEEK)
    at = scratch(spark, "stream")
    maps.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("center timestamp, row int, col int, n long").parquet(f"{at}/out")


@query(
    "write_heatmaps",
    HEATED
    + """, n AS (SELECT center, row, col, count(*) AS n FROM c JOIN p ON postime >= center - INTERVAL 168 HOUR AND postime < center GROUP BY 1, 2, 3), t AS (SELECT center, ln(1e0 + max(n)) AS top FROM n GROUP BY 1)
    SELECT 'week' AS tag, strftime(center, '%Y-%m') AS month, center, count(*) AS cells, round(sum(ln(1e0 + n) / top), 4) AS heat FROM n JOIN t USING (center) GROUP BY 3""",
)
def stored(spark: SparkSession, d: str) -> DataFrame:
    """A month of maps under their tag and month, read again."""
    maps = normalize_heatmap(ais_heatmap_counts(adapt(spark, d, "ais"), WEEK, 168, 6, ["202401"]))
    path = scratch(spark, "maps")
    S.write_heatmaps(maps, path, "week")
    back = spark.read.parquet(path).where("tag = 'week' AND row IS NOT NULL")
    out = back.groupBy("tag", "month", "center").agg(F.count(F.lit(1)).alias("cells"), F.sum("heat").alias("heat")).where("cells > 0")
    return rounded(out, "heat", digits=4)
