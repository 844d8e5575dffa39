"""Queries over positions, text functions and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.grid import Grid, axis_index, bbox_filter, haversine_km, latlon_to_rc, rc_to_latlon, to_cell, wrap_longitude
from ..operators import catalog as C
from ..operators import heatmap as H
from .adapters import SQL, adapt, ctes
from .registry import query

GRID = Grid()
CELL = "CAST(least(greatest(floor((86e0 - lat) / 26e0 * 52), 0), 51) AS INTEGER) AS row, CAST(least(greatest(floor((lon + 180e0) / 360e0 * 360), 0), 359) AS INTEGER) AS col"
INSIDE = "lat BETWEEN 60 AND 86 AND lon BETWEEN -180 AND 180"
HEAT = (
    ctes("ais")
    + f"""
    , cells AS (SELECT postime, {CELL} FROM ais WHERE {INSIDE}),
    centers AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:59:59', INTERVAL 6 HOUR)) AS center),
    counts AS (SELECT center, row, col, count(*) AS n FROM centers JOIN cells ON postime >= center - INTERVAL 168 HOUR AND postime < center GROUP BY ALL),
    filled AS (SELECT center, row, col, coalesce(n, 0) AS n FROM centers LEFT JOIN counts USING (center))
    """
)


@query("ais_heatmap_counts", HEAT + "SELECT center, row, col, n FROM filled")
def ais_heatmap_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.ais_heatmap_counts(adapt(spark, d, "ais"), GRID, 168, 6, ["202401"])


@query("normalize_heatmap", HEAT + "SELECT center, row, col, n, round(CASE WHEN max(n) OVER (PARTITION BY center) > 0 THEN ln(1e0 + n) / ln(1e0 + max(n) OVER (PARTITION BY center)) ELSE 0e0 END, 6) AS heat FROM filled")
def normalize_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return H.normalize_heatmap(ais_heatmap_counts(spark, d)).withColumn("heat", F.round("heat", 6))


@query("to_cell", ctes("ais") + f"SELECT event_id, {CELL} FROM ais WHERE {INSIDE}")
def cells_of(spark: SparkSession, d: str) -> DataFrame:
    row, col = to_cell(F.col("lat"), F.col("lon"), GRID)
    return adapt(spark, d, "ais").select("event_id", row.alias("row"), col.alias("col")).where("row IS NOT NULL")


@query(
    "latlon_to_rc",
    ctes("ais")
    + """SELECT event_id, CAST(least(greatest(round_even((86e0 - lat) / 26e0 * 51, 0), 0), 51) AS INTEGER) AS row,
         CAST(least(greatest(round_even((lon + 180e0) / 360e0 * 359, 0), 0), 359) AS INTEGER) AS col, lat BETWEEN 60 AND 86 AND lon BETWEEN -180 AND 180 AS inside FROM ais""",
)
def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    row, col, inside = latlon_to_rc(F.col("lat"), F.col("lon"), GRID)
    return adapt(spark, d, "ais").select("event_id", row.alias("row"), col.alias("col"), inside.alias("inside"))


@query("rc_to_latlon", "SELECT event_id, round(86e0 - (user_id % 52) * (26e0 / 51), 6) AS lat, round(-180e0 + (event_id % 360) * (360e0 / 359), 6) AS lon FROM events")
def positions_of(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = rc_to_latlon(F.col("user_id") % 52, F.col("event_id") % 360, GRID)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("wrap_longitude", ctes("ais") + "SELECT event_id, round(CASE WHEN lon + 180e0 + 180e0 >= 360e0 THEN lon + 180e0 - 360e0 ELSE lon + 180e0 END, 6) AS lon FROM ais")
def wrapped(spark: SparkSession, d: str) -> DataFrame:
    shifted = adapt(spark, d, "ais").select("event_id", (F.col("lon") + 180).alias("lon"))
    return wrap_longitude(shifted, "lon").withColumn("lon", F.round("lon", 6))


@query(
    "haversine_km",
    ctes("ais")
    + """SELECT event_id, round(2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(lat - 72e0) / 2), 2) + cos(radians(72e0)) * cos(radians(lat)) * pow(sin(radians(lon - 10e0) / 2), 2)))), 5) AS km FROM ais""",
)
def distances(spark: SparkSession, d: str) -> DataFrame:
    return adapt(spark, d, "ais").select("event_id", F.round(haversine_km(F.lit(72.0), F.lit(10.0), F.col("lat"), F.col("lon")), 5).alias("km"))


@query("bbox_filter", ctes("ais") + "SELECT event_id FROM ais WHERE lon BETWEEN -40 AND 60 AND lat BETWEEN 65 AND 80")
def in_box(spark: SparkSession, d: str) -> DataFrame:
    return bbox_filter(adapt(spark, d, "ais"), "-40,65,60,80").select("event_id")


@query(
    "normalize_timestamp",
    """WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d_%H') WHEN 1 THEN strftime(ts, '%Y-%m-%d-%H:%M') ELSE CAST(ts AS VARCHAR) END AS raw, strftime(ts, '%Y-%m-%d_%H') AS h FROM events)
    SELECT event_id, CASE WHEN event_id % 3 < 2 THEN h END AS stamp, CASE WHEN event_id % 3 < 2 THEN concat(h[1:10], '-', h[12:13], ':00') END AS ui, CASE WHEN event_id % 3 < 2 THEN h[1:7] END AS month FROM x""",
)
def stamps(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 3 == 0, S.stamp(t)).when(F.col("event_id") % 3 == 1, F.date_format(t, "yyyy-MM-dd-HH:mm")).otherwise(t.cast("string"))
    out = spark.read.parquet(f"{d}/events.parquet").select("event_id", S.normalize_timestamp(raw).alias("stamp"))
    return out.select("event_id", "stamp", S.ui_timestamp(F.col("stamp")).alias("ui"), S.month_key(F.col("stamp")).alias("month"))


@query(
    "path_facets",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '2024-07-15_06' WHEN doc_id % 4 = 2 THEN '2024-07-15_12' ELSE '' END AS stamp,
       CASE doc_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN concat('processed/', lang) WHEN 2 THEN 'ais_heatmap' ELSE source END AS source FROM documents""",
)
def facets(spark: SparkSession, d: str) -> DataFrame:
    path = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("raw/a/"), F.col("lang")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("processed\\"), F.col("lang"), F.lit("\\2024-07-15_06\\x_stack.npy")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("ais_heatmap/2024-07-15_12.npy")))
        .otherwise(F.concat("source", F.lit("/meta.json")))
    )
    stamp, source = S.path_facets(path)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", stamp.alias("stamp"), source.alias("source"))


@query("safe_number", "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE value END, -1e0) AS x FROM events")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "none").when(F.col("event_id") % 5 == 1, "NaN").otherwise(F.col("value").cast("string"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.safe_number(raw, -1.0).alias("x"))


@query("fingerprint", "SELECT o_orderkey, left(sha1(concat(CAST(o_orderkey AS VARCHAR), '|', o_orderpriority, '|', o_orderstatus)), 12) AS version FROM orders")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.fingerprint([F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")]).alias("version"))


@query(
    "policy_scalars",
    """SELECT event_id, CASE m WHEN 0 THEN 0.22e0 WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.55e0 ELSE 0e0 END AS caution,
       round(value / 500 * CASE m WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.06e0 WHEN 2 THEN 0.03e0 ELSE 0e0 END, 6) AS reward,
       CASE m WHEN 0 THEN 0.06e0 WHEN 1 THEN 0.08e0 WHEN 2 THEN 0.1e0 ELSE 0e0 END AS near FROM (SELECT *, event_id % 4 AS m FROM events)""",
)
def policies(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ("tie_breaker", "budget", "minimize", "strict"))), (F.col("event_id") % 4 + 1).cast("int"))
    caution, reward, near = S.policy_scalars(mode, F.col("value") / 500)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", caution.alias("caution"), F.round(reward, 6).alias("reward"), near.alias("near"))


AXIS = ctes("hours") + ", axis AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hours), missing AS (SELECT ts FROM axis EXCEPT SELECT ts FROM hours)\n"
ISLANDS = """, marked AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM missing),
    islands AS (SELECT ts, sum(new) OVER (ORDER BY ts) AS island FROM marked)\n"""


@query("missing_timestamps", AXIS + "SELECT ts FROM missing")
def missing(spark: SparkSession, d: str) -> DataFrame:
    hours = adapt(spark, d, "hours")
    return C.missing_timestamps(C.expected_axis(hours, 1), hours)


@query("available_timestamps", AXIS + "SELECT ts FROM axis INTERSECT SELECT ts FROM hours")
def available(spark: SparkSession, d: str) -> DataFrame:
    hours = adapt(spark, d, "hours")
    return C.available_timestamps(C.expected_axis(hours, 1), hours)


@query("union_timeline", ctes("hours") + "SELECT ts FROM hours UNION SELECT date_trunc('day', ts) FROM events")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return C.union_timeline(adapt(spark, d, "hours"), spark.read.parquet(f"{d}/events.parquet").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).withColumn("ts", F.col("ts").cast(adapt(spark, d, "hours").schema["ts"].dataType)))


@query("gap_segments", AXIS + ISLANDS + 'SELECT min(ts) AS "first", max(ts) AS "last", count(*) AS missing_count, count(*) AS missing_hours FROM islands GROUP BY island')
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return C.gap_segments(missing(spark, d), 1)


@query(
    "timestamp_index",
    AXIS
    + """, deltas AS (SELECT date_diff('hour', lag(ts) OVER (ORDER BY ts), ts) AS d FROM hours),
    native AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM deltas WHERE d > 0) WHERE i = floor(n / 2) + 1),
    a AS (SELECT count(*) AS e FROM axis), s AS (SELECT count(*) AS n, min(ts) AS f, max(ts) AS l, count(DISTINCT strftime(ts, '%Y-%m')) AS m FROM hours)
    SELECT n AS source_count, e AS expected_count, n AS available_count, e - n AS missing_count, round(n / e, 6) AS coverage,
    CASE WHEN n / e < 0.75 THEN 'fail' WHEN n / e < 0.95 THEN 'warn' ELSE 'pass' END AS status, f AS first_timestamp, l AS last_timestamp, d AS native_step_hours, m AS month_count FROM a, s, native""",
)
def index(spark: SparkSession, d: str) -> DataFrame:
    return C.timestamp_index(adapt(spark, d, "hours"), 1)


@query(
    "timeline_gaps",
    ctes("hours")
    + """, d AS (SELECT lag(ts) OVER (ORDER BY ts) AS from_ts, ts AS to_ts, date_diff('second', lag(ts) OVER (ORDER BY ts), ts) / 3600e0 AS hours FROM hours), m AS (SELECT median(hours) AS mid FROM d)
    SELECT from_ts, to_ts, hours FROM d, m WHERE hours > mid * 1.5e0 + 1e-6""",
)
def long_gaps(spark: SparkSession, d: str) -> DataFrame:
    return C.timeline_gaps(adapt(spark, d, "hours"))


NEAREST = ctes("hours") + """, wanted AS (SELECT DISTINCT date_trunc('hour', ts) + INTERVAL 30 MINUTE AS ts FROM events),
    near AS (SELECT w.ts, max(h.ts) FILTER (WHERE h.ts <= w.ts) AS a, min(h.ts) FILTER (WHERE h.ts >= w.ts) AS b FROM wanted w, hours h GROUP BY w.ts),
    nearest AS (SELECT ts, CASE WHEN a IS NOT NULL AND (b IS NULL OR ts - a <= b - ts) THEN a ELSE coalesce(b, a) END AS nearest FROM near)\n"""


@query("nearest_timestamp", NEAREST + "SELECT ts, nearest FROM nearest")
def nearest(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.read.parquet(f"{d}/events.parquet").select(F.expr("date_trunc('hour', ts) + interval 30 minutes").alias("ts")).distinct()
    hours = adapt(spark, d, "hours")
    return C.nearest_timestamp(wanted.withColumn("ts", F.col("ts").cast(hours.schema["ts"].dataType)), hours)


MANIFEST = ctes("manifest_new", "manifest_old")


@query(
    "manifest_incremental",
    MANIFEST
    + """SELECT n.path, n.size, n.mtime_ns, CASE WHEN o.path IS NOT NULL AND n.size = o.size AND n.mtime_ns = o.mtime_ns THEN o.hash ELSE sha256(n.text) END AS hash,
    o.path IS NOT NULL AND n.size = o.size AND n.mtime_ns = o.mtime_ns AS reused FROM manifest_new n LEFT JOIN manifest_old o USING (path)""",
)
def incremental(spark: SparkSession, d: str) -> DataFrame:
    return C.manifest_incremental(adapt(spark, d, "manifest_new"), adapt(spark, d, "manifest_old"))


@query(
    "manifest_diff",
    MANIFEST
    + """, n AS (SELECT path, CASE WHEN mtime_ns % 13 = 0 THEN 'new' ELSE concat('h', CAST(mtime_ns % 97 AS VARCHAR)) END AS hash FROM manifest_new WHERE mtime_ns % 5 <> 0)
    SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM manifest_old o FULL JOIN n USING (path) WHERE o.hash IS DISTINCT FROM n.hash""",
)
def diff(spark: SparkSession, d: str) -> DataFrame:
    new = adapt(spark, d, "manifest_new").where("mtime_ns % 5 <> 0").selectExpr("path", "CASE WHEN mtime_ns % 13 = 0 THEN 'new' ELSE concat('h', mtime_ns % 97) END AS hash")
    return C.manifest_diff(adapt(spark, d, "manifest_old"), new)


LAYERS = ctes("layer_files") + ", samples AS (SELECT DISTINCT CAST(floor(vec_id / 5e0) AS BIGINT) AS sample_id FROM embeddings)\n"


def samples_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 5).alias("sample_id")).distinct()


@query(
    "dataset_registry",
    LAYERS
    + """, h AS (SELECT sample_id, """
    + ", ".join(f"max(CASE WHEN layer = '{x}' THEN 1 ELSE 0 END) AS has_{x}" for x in C.LAYERS)
    + """ FROM layer_files GROUP BY 1), f AS (SELECT sample_id, """
    + ", ".join(f"coalesce(has_{x}, 0) AS has_{x}" for x in C.LAYERS)
    + """, sample_id % 4 <> 0 AS source_ok FROM samples LEFT JOIN h USING (sample_id))
    SELECT *, round((has_x_stack + has_blocked_mask + has_ais_heatmap + CAST(source_ok AS INT)) / 4e0, 6) AS completeness_score,
    has_x_stack + has_blocked_mask + has_ais_heatmap + CAST(source_ok AS INT) = 4 AS is_complete FROM f""",
)
def registry(spark: SparkSession, d: str) -> DataFrame:
    samples = samples_of(spark, d)
    return C.dataset_registry(samples, adapt(spark, d, "layer_files"), samples.withColumn("source_ok", F.col("sample_id") % 4 != 0))


@query("layer_availability", LAYERS + f"SELECT s.sample_id, l.layer, f.sample_id IS NOT NULL AS available FROM samples s CROSS JOIN (SELECT unnest({list(C.LAYERS)}) AS layer) l LEFT JOIN layer_files f ON f.sample_id = s.sample_id AND f.layer = l.layer")
def availability(spark: SparkSession, d: str) -> DataFrame:
    return C.layer_availability(samples_of(spark, d), adapt(spark, d, "layer_files"))


@query(
    "coverage_counts",
    " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS rate FROM documents GROUP BY {k}" for k in ("lang", "source")),
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_counts(spark.read.parquet(f"{d}/documents.parquet"), ["lang", "source"])


@query(
    "grid_alignment",
    LAYERS
    + """, r AS (SELECT *, CASE layer WHEN 'x_stack' THEN 0 WHEN 'blocked_mask' THEN 1 WHEN 'ais_heatmap' THEN 2 WHEN 'pred' THEN 3 ELSE 4 END AS p FROM layer_files)
    SELECT sample_id, layer, w = first_value(w) OVER (PARTITION BY sample_id ORDER BY p) AS aligned FROM r""",
)
def alignment(spark: SparkSession, d: str) -> DataFrame:
    return C.grid_alignment(adapt(spark, d, "layer_files"))


@query(
    "majority_shape",
    LAYERS
    + """, c AS (SELECT layer, h, w, count(*) AS n FROM layer_files GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY layer) AS present, row_number() OVER (PARTITION BY layer ORDER BY n DESC, h, w) AS i FROM c)
    SELECT layer, h, w, n, CAST(present AS BIGINT) AS present, round(n / present, 6) AS consistency FROM t WHERE i = 1""",
)
def majority(spark: SparkSession, d: str) -> DataFrame:
    return C.majority_shape(adapt(spark, d, "layer_files"))


CHECKS = (
    LAYERS
    + f""", hours AS ({SQL['hours'].format(events='events')}),"""
    + """
    n AS (SELECT count(*) AS n FROM samples), p AS (SELECT layer, count(DISTINCT sample_id) / (SELECT n FROM n) AS cover FROM layer_files GROUP BY 1),
    c AS (SELECT layer, count(*) AS k FROM layer_files WHERE layer IN ('x_stack', 'blocked_mask') GROUP BY layer, w), t AS (SELECT max(k) / sum(k) AS s FROM c GROUP BY layer),
    d AS (SELECT date_diff('second', lag(ts) OVER (ORDER BY ts), ts) / 3600e0 AS h FROM hours), g AS (SELECT 1e0 - count(*) FILTER (WHERE h > (SELECT median(h) FROM d) * 1.5 + 1e-6) / greatest(count(h), 1) AS s FROM d),
    raw AS (SELECT 'required_files_coverage' AS name, (SELECT min(cover) FROM p WHERE layer IN ('x_stack', 'blocked_mask')) AS score
      UNION ALL SELECT 'shape_consistency', (SELECT min(s) FROM t) UNION ALL SELECT 'auxiliary_layers_coverage', (SELECT cover FROM p WHERE layer = 'ais_heatmap') UNION ALL SELECT 'timeline_continuity', (SELECT s FROM g)),
    checks AS (SELECT name, round(score, 6) AS score, CASE WHEN score >= 0.95 THEN 'pass' WHEN score >= 0.75 THEN 'warn' ELSE 'fail' END AS raw_status,
      CASE WHEN name = 'auxiliary_layers_coverage' THEN 'degradable' ELSE 'critical' END AS severity FROM raw),
    judged AS (SELECT *, CASE WHEN severity <> 'critical' AND raw_status = 'fail' THEN 'warn' ELSE raw_status END AS status FROM checks)\n"""
)


@query("data_quality_checks", CHECKS + "SELECT * FROM judged")
def checks(spark: SparkSession, d: str) -> DataFrame:
    return C.data_quality_checks(samples_of(spark, d), adapt(spark, d, "layer_files"), adapt(spark, d, "hours"))


@query(
    "quality_gate",
    CHECKS
    + """, s AS (SELECT count(*) FILTER (WHERE severity = 'critical' AND status <> 'pass') AS blockers, count(*) FILTER (WHERE status = 'warn') AS warnings, count(*) FILTER (WHERE status = 'fail') AS fails FROM judged)
    SELECT CASE WHEN blockers > 0 THEN 'FAIL' WHEN warnings + fails > 0 THEN 'WARN' ELSE 'PASS' END AS status, blockers > 0 AS block_release, blockers, warnings, fails FROM s""",
)
def gate(spark: SparkSession, d: str) -> DataFrame:
    return C.quality_gate(checks(spark, d))


@query("contract_checks", LAYERS + "SELECT sample_id, layer FROM samples CROSS JOIN (SELECT unnest(['x_stack', 'blocked_mask']) AS layer) EXCEPT SELECT sample_id, layer FROM layer_files")
def contract(spark: SparkSession, d: str) -> DataFrame:
    return C.contract_checks(adapt(spark, d, "layer_files"), samples_of(spark, d))


@query("month_audit", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderdate) AS actual, CAST(day(last_day(min(o_orderdate))) AS BIGINT) * 4 AS expected, count(DISTINCT o_orderdate) >= day(last_day(min(o_orderdate))) * 4 AS complete FROM orders GROUP BY 1")
def audit(spark: SparkSession, d: str) -> DataFrame:
    return C.month_audit(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("ts")))


@query("spread_sample", ctes("hours") + ", r AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM hours) SELECT ts FROM r WHERE n <= 20 OR i IN (SELECT k * (n - 1) // 19 FROM generate_series(0, 19) t(k))")
def spread(spark: SparkSession, d: str) -> DataFrame:
    return C.spread_sample(adapt(spark, d, "hours"), "ts", 20)


@query(
    "timeline_windows",
    ctes("hours")
    + """, r AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM hours)
    SELECT w.k AS window_id, i - w.k * 3 AS position, ts FROM r JOIN (SELECT unnest(range(0, 100000)) AS k) w ON i >= w.k * 3 AND i < w.k * 3 + 4 AND w.k * 3 + 4 <= n""",
)
def windows(spark: SparkSession, d: str) -> DataFrame:
    return C.timeline_windows(adapt(spark, d, "hours"), 4, 3)


@query("anchor_window", ctes("hours") + "SELECT ts FROM (SELECT ts FROM hours ORDER BY ts < TIMESTAMP '2024-01-29', CASE WHEN ts >= TIMESTAMP '2024-01-29' THEN epoch(ts) ELSE -epoch(ts) END LIMIT 40)")
def around(spark: SparkSession, d: str) -> DataFrame:
    return C.anchor_window(adapt(spark, d, "hours"), F.lit("2024-01-29").cast("timestamp_ntz"), 40)


@query("page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT CAST(ceil(count(*) / 50) AS BIGINT) FROM orders) AS pages FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def third_page(spark: SparkSession, d: str) -> DataFrame:
    return C.page(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 3, 50)


META = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END AS source, lang AS product_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '2024-07-01' END AS valid_time, 'x' AS ingested_at, '2024-07-15_00' AS timestamp FROM {documents}"


def meta_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(META, documents=spark.read.parquet(f"{d}/documents.parquet"))


@query("source_meta_check", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'source' END, CASE WHEN doc_id % 5 = 0 THEN 'valid_time' END) AS missing, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS ok FROM documents")
def meta_check(spark: SparkSession, d: str) -> DataFrame:
    return C.source_meta_check(meta_of(spark, d)).select("doc_id", F.array_join("missing", ",").alias("missing"), "ok")


@query("source_meta_backfill", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS source, lang AS product_id, CASE WHEN doc_id % 5 = 0 THEN '2024-07-15_00' ELSE '2024-07-01' END AS valid_time, 'x' AS ingested_at FROM documents")
def meta_backfill(spark: SparkSession, d: str) -> DataFrame:
    return C.source_meta_backfill(meta_of(spark, d)).select("doc_id", "source", "product_id", "valid_time", "ingested_at")


@query(
    "resolve_sources",
    NEAREST
    + """, wanted2 AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events), near2 AS (SELECT w.ts, max(h.ts) FILTER (WHERE h.ts <= w.ts) AS a, min(h.ts) FILTER (WHERE h.ts >= w.ts) AS b FROM wanted2 w, hours h GROUP BY w.ts),
    f AS (SELECT n.ts, CASE WHEN a IS NOT NULL AND (b IS NULL OR n.ts - a <= b - n.ts) THEN a ELSE coalesce(b, a) END AS nearest, h.ts IS NOT NULL AS e, hour(n.ts) % 2 = 0 AS fresh, hour(n.ts) % 6 = 1 AS p, hour(n.ts) % 6 = 3 AS s FROM near2 n LEFT JOIN hours h ON h.ts = n.ts),
    r AS (SELECT *, CASE WHEN e AND fresh THEN 'local_existing' WHEN p THEN 'primary' WHEN s THEN 'snapshot' WHEN e THEN 'stale_local_existing' ELSE 'nearest_local_fallback' END AS source FROM f)
    SELECT ts, CASE WHEN source = 'nearest_local_fallback' THEN nearest ELSE ts END AS resolved, source FROM r""",
)
def resolved(spark: SparkSession, d: str) -> DataFrame:
    hours = adapt(spark, d, "hours").withColumn("fresh", F.hour("ts") % 2 == 0)
    wanted = spark.read.parquet(f"{d}/events.parquet").select(F.date_trunc("hour", "ts").cast(hours.schema["ts"].dataType).alias("ts")).distinct()
    kinds = F.when(F.hour("ts") % 6 == 1, "primary").when(F.hour("ts") % 6 == 3, "snapshot")
    return C.resolve_sources(wanted, hours, wanted.withColumn("kind", kinds).where("kind IS NOT NULL"))


@query("filter_month", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15'")
def one_month(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", S.stamp(F.col("ts").cast("timestamp")).alias("timestamp"))
    return S.filter_month(S.filter_month(e, "all"), "2024-01-15").select("event_id")


@query(
    "axis_index",
    ctes("ais")
    + """, a AS (SELECT i AS idx, 85e0 - i * i / 10e0 AS v FROM range(0, 16) r(i)), p AS (SELECT a.idx, a.v, b.v AS n, a.idx = 0 AS f, a.idx = 14 AS l FROM a JOIN a b ON b.idx = a.idx + 1)
    SELECT event_id, CAST(round_even(idx + least(greatest((lat - v) / (n - v), 0e0), 1e0), 0) AS INTEGER) AS row, lat BETWEEN n AND v AS row_inside FROM ais JOIN p ON (lat <= v AND lat > n) OR (f AND lat > v) OR (l AND lat <= n)""",
)
def irregular(spark: SparkSession, d: str) -> DataFrame:
    axis = spark.range(16).select(F.col("id").cast("int").alias("idx"), (85 - F.col("id") * F.col("id") / 10).alias("value"))
    return axis_index(adapt(spark, d, "ais").select("event_id", "lat"), axis, "lat", "row").select("event_id", "row", "row_inside")
