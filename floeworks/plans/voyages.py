"""Queries over routes and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid, latlon_to_rc
from ..operators import routes as R
from ..streaming import state as T
from .adapters import adapt, ctes
from .experiments import rounded
from .registry import query

GRID = Grid()
POINTS = ctes("route_points")
KM = "2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
NODE = """CAST(least(greatest(round_even((86e0 - lat) / 26e0 * 51, 0), 0), 51) AS INTEGER) AS r, CAST(least(greatest(round_even((lon + 180e0) / 360e0 * 359, 0), 0), 359) AS INTEGER) AS c"""


@query(
    "route_signature",
    POINTS
    + "SELECT route_id, left(sha1(string_agg(concat(CAST(CAST(round(lon * 100) AS BIGINT) AS VARCHAR), '/', CAST(CAST(round(lat * 100) AS BIGINT) AS VARCHAR)), ',' ORDER BY seq)), 16) AS signature FROM route_points GROUP BY 1",
)
def signatures(spark: SparkSession, d: str) -> DataFrame:
    points = adapt(spark, d, "route_points")
    text = F.concat(F.round(F.col("lon") * 100).cast("long").cast("string"), F.lit("/"), F.round(F.col("lat") * 100).cast("long").cast("string"))
    return R.route_signature(points, text=text)


GEOMETRY = (
    POINTS
    + f""", g AS (SELECT *, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
    h AS (SELECT route_id, seq, coalesce({KM.format(a='y0', b='lat', c='x0', d='lon')}, 0e0) AS segment_km, sqrt(pow(lon - x0, 2) + pow(lat - y0, 2)) AS na, sqrt(pow(x2 - lon, 2) + pow(y2 - lat, 2)) AS nb,
      (lon - x0) * (x2 - lon) + (lat - y0) * (y2 - lat) AS dot FROM g),
    geometry AS (SELECT route_id, seq, segment_km, coalesce(CASE WHEN na > 1e-12 AND nb > 1e-12 THEN degrees(acos(least(greatest(dot / (na * nb), -1e0), 1e0))) ELSE 0e0 END, 0e0) AS turn_deg FROM h)\n"""
)


@query("route_geometry", GEOMETRY + "SELECT route_id, seq, round(segment_km, 4) AS segment_km, round(turn_deg, 3) AS turn_deg FROM geometry")
def geometry(spark: SparkSession, d: str) -> DataFrame:
    out = R.route_geometry(adapt(spark, d, "route_points")).select("route_id", "seq", "segment_km", "turn_deg")
    return rounded(rounded(out, "segment_km", digits=4), "turn_deg", digits=3)


@query("route_lengths", GEOMETRY + "SELECT route_id, count(*) AS points, round(sum(segment_km), 3) AS length_km, round(max(turn_deg), 3) AS max_turn_deg FROM geometry GROUP BY 1")
def lengths(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.route_lengths(adapt(spark, d, "route_points")), "length_km", "max_turn_deg", digits=3)


@query(
    "smooth_display",
    POINTS
    + """, n AS (SELECT *, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, count(*) OVER (PARTITION BY route_id) AS n FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
    s AS (SELECT route_id, 0 AS i, lon, lat FROM n WHERE seq = 1 AND n >= 3 UNION ALL SELECT route_id, 2 * seq - 1, 0.75e0 * lon + 0.25e0 * x2, 0.75e0 * lat + 0.25e0 * y2 FROM n WHERE x2 IS NOT NULL AND n >= 3
      UNION ALL SELECT route_id, 2 * seq, 0.25e0 * lon + 0.75e0 * x2, 0.25e0 * lat + 0.75e0 * y2 FROM n WHERE x2 IS NOT NULL AND n >= 3 UNION ALL SELECT route_id, 2 * n - 1, lon, lat FROM n WHERE x2 IS NULL AND n >= 3 UNION ALL SELECT route_id, seq - 1, lon, lat FROM n WHERE n < 3)
    SELECT route_id, CAST(i AS INTEGER) AS i, round(lon, 7) AS lon, round(lat, 7) AS lat FROM s""",
)
def smoothed(spark: SparkSession, d: str) -> DataFrame:
    packed = adapt(spark, d, "route_points").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("a")).select("route_id", F.expr("transform(a, x -> struct(x.lon, x.lat))").alias("coords"))
    out = R.smooth_display(packed, iterations=1).select("route_id", F.posexplode("coords").alias("i", "p"))
    return rounded(out.select("route_id", "i", "p.lon", "p.lat"), "lon", "lat", digits=7)


SEGMENTS = POINTS + f""", nodes AS (SELECT route_id, seq, {NODE} FROM route_points),
    seg AS (SELECT route_id, seq, lag(r) OVER w AS r0, lag(c) OVER w AS c0, r AS r1, c AS c1 FROM nodes WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
    traced AS (SELECT route_id, seq, r0, c0, r1, c1, ro AS row, co AS col FROM (SELECT *, unnest(generate_series(least(r0, r1), greatest(r0, r1))) AS ro FROM seg WHERE r0 IS NOT NULL) a, LATERAL (SELECT unnest(generate_series(least(c0, c1), greatest(c0, c1))) AS co) b
      WHERE 2 * abs((c1 - c0) * (ro - r0) - (r1 - r0) * (co - c0)) <= abs(c1 - c0) + abs(r1 - r0))\n"""


@query("trace_cells", SEGMENTS + "SELECT route_id, seq, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM traced")
def traced(spark: SparkSession, d: str) -> DataFrame:
    return R.trace_cells(R.route_segments(adapt(spark, d, "route_points"), GRID)).select("route_id", "seq", "row", "col")


FIELD = "SELECT row, col, CASE WHEN (row + col) % 5 = 0 THEN 1e0 ELSE 0e0 END AS caution, (row * 7 + col) % 11 / 11e0 AS corridor, (row + 3 * col) % 13 / 100e0 AS uncertainty, (row * col) % 17 / 100e0 AS risk, CASE WHEN (row + col) % 7 = 0 THEN 1e0 ELSE 0e0 END AS near_blocked"
LATITUDE, LONGITUDE = "86e0 - {0} * (26e0 / 51)", "-180e0 + {0} * (360e0 / 359)"
SEGMENT_KM = KM.format(a="(" + LATITUDE.format("r0") + ")", b="(" + LATITUDE.format("r1") + ")", c="(" + LONGITUDE.format("c0") + ")", d="(" + LONGITUDE.format("c1") + ")")
METRICS = ("distance_km", "caution_len_km", "caution_extra_km", "corridor_discount_km", "uncertainty_extra_km", "risk_extra_km", "corridor_alignment", "caution_hit_ratio", "near_blocked_hit_ratio", "alignment_p50", "alignment_p90", "effective_km")
LOOKED = f""", cells AS ({FIELD} FROM (SELECT i // 360 AS row, i % 360 AS col FROM range(0, 18720) r(i))),
    l AS (SELECT * FROM traced JOIN cells USING (row, col) WHERE (r0 = r1 AND c0 = c1) OR NOT (row = r0 AND col = c0)),
    m AS (SELECT route_id, seq, r0, c0, r1, c1, avg(caution) AS ca, avg(corridor) AS co, avg(uncertainty) AS un, avg(risk) AS ri, sum(corridor) AS cs, sum(caution) AS hits, sum(near_blocked) AS near, count(*) AS n FROM l GROUP BY 1, 2, 3, 4, 5, 6),
    k AS (SELECT *, {SEGMENT_KM} AS km FROM m),\n"""


def field(spark: SparkSession) -> DataFrame:
    return spark.range(52 * 360).selectExpr("CAST(floor(id / 360) AS INT) AS row", "CAST(id % 360 AS INT) AS col").selectExpr(*FIELD.removeprefix("SELECT ").split(", "))


@query(
    "route_metrics",
    SEGMENTS
    + LOOKED
    + """s AS (SELECT route_id, sum(km) AS distance_km, sum(km * ca) AS caution_len_km, sum(km * ca * 0.22e0) AS caution_extra_km, sum(km * co * 0.02e0) AS corridor_discount_km, sum(km * un) AS uncertainty_extra_km, sum(km * ri) AS risk_extra_km, CAST(sum(n) AS BIGINT) AS sample_count, sum(cs) / sum(n) AS corridor_alignment,
      sum(hits) / sum(n) AS caution_hit_ratio, sum(near) / sum(n) AS near_blocked_hit_ratio FROM k GROUP BY 1), q AS (SELECT route_id, quantile_cont(corridor, 0.5) AS alignment_p50, quantile_cont(corridor, 0.9) AS alignment_p90 FROM l GROUP BY 1)
    SELECT route_id, sample_count, """
    + ", ".join(f"round({m}, 3) AS {m}" for m in METRICS[:-1])
    + ", round(distance_km + caution_extra_km - corridor_discount_km + uncertainty_extra_km + risk_extra_km, 3) AS effective_km FROM s JOIN q USING (route_id)",
)
def metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.route_metrics(adapt(spark, d, "route_points"), field(spark), GRID), *METRICS, digits=3)


@query(
    "segment_metrics",
    SEGMENTS
    + LOOKED.rstrip(",\n")
    + """ SELECT route_id, seq, CAST(n AS BIGINT) AS samples, round(km, 3) AS km, round(ca, 3) AS caution, round(near / n, 3) AS near_blocked, round(co, 3) AS corridor, round(un, 3) AS uncertainty, round(ri, 3) AS risk,
    round(km * ca, 3) AS caution_len_km, round(km * ca * 0.22e0, 3) AS caution_extra_km, round(km * co * 0.02e0, 3) AS corridor_discount_km, round(km * un, 3) AS uncertainty_extra_km, round(km * ri, 3) AS risk_extra_km FROM k""",
)
def by_segment(spark: SparkSession, d: str) -> DataFrame:
    out = R.segment_metrics(adapt(spark, d, "route_points"), field(spark), GRID)
    return rounded(out, *(c for c in out.columns if c not in ("route_id", "seq", "samples")), digits=3)


BACKTEST = ("inside_ratio", "route_mean", "route_p90", "top10_hit", "top25_hit", "median_hit", "alignment", "zscore")


@query(
    "ais_backtest",
    POINTS
    + f""", n AS (SELECT route_id, {NODE}, lat BETWEEN 60 AND 86 AND lon BETWEEN -180 AND 180 AS inside FROM route_points), h AS (SELECT r, c, ln(1e0 + count(*)) AS heat FROM n GROUP BY 1, 2),
    f AS (SELECT i // 360 AS r, i % 360 AS c, coalesce(heat, 0e0) AS heat FROM range(0, 18720) t(i) LEFT JOIN h ON h.r = i // 360 AND h.c = i % 360),
    t AS (SELECT quantile_cont(heat, 0.9) AS q90, quantile_cont(heat, 0.75) AS q75, quantile_cont(heat, 0.5) AS q50, max(heat) AS top, avg(heat) AS mean, stddev_pop(heat) + 1e-6 AS std FROM f)
    SELECT route_id, count(*) AS points, round(avg(CAST(inside AS INT)), 4) AS inside_ratio, round(avg(heat), 4) AS route_mean, round(quantile_cont(heat, 0.9), 4) AS route_p90, round(avg(CAST(heat >= q90 AS INT)), 4) AS top10_hit, round(avg(CAST(heat >= q75 AS INT)), 4) AS top25_hit,
    round(avg(CAST(heat >= q50 AS INT)), 4) AS median_hit, round(least(greatest(avg(heat) / max(top), 0e0), 1e0), 4) AS alignment, round((avg(heat) - max(mean)) / max(std), 4) AS zscore FROM n JOIN f USING (r, c), t GROUP BY 1""",
)
def backtest(spark: SparkSession, d: str) -> DataFrame:
    points = adapt(spark, d, "route_points")
    row, col, _ = latlon_to_rc(F.col("lat"), F.col("lon"), GRID)
    heat = points.groupBy(row.alias("row"), col.alias("col")).agg(F.log1p(F.count(F.lit(1))).alias("heat"))
    return rounded(R.ais_backtest(points, heat, GRID), *BACKTEST, digits=4)


VALUES = "SELECT user_id AS route_id, value / 490e0 AS risk FROM events"


def risks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("route_id"), (F.col("value") / 490).alias("risk"))


@query("risk_constraint_chance", f"WITH v AS ({VALUES}) SELECT route_id, round(avg(CAST(least(risk, 1e0) > 0.9e0 AS INT)), 5) AS metric, count(*) FILTER (WHERE least(risk, 1e0) > 0.9e0) AS tail_count, round(avg(CAST(least(risk, 1e0) > 0.9e0 AS INT)) / 0.1e0, 5) AS usage, avg(CAST(least(risk, 1e0) > 0.9e0 AS INT)) <= 0.1e0 + 1e-12 AS satisfied FROM v GROUP BY 1")
def chance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.risk_constraint(risks(spark, d), "chance", 0.1, 0.9), "metric", "usage")


@query(
    "risk_constraint_cvar",
    f"""WITH v AS (SELECT route_id, least(risk, 1e0) AS r FROM ({VALUES})), n AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY r DESC) AS i, count(*) OVER (PARTITION BY route_id) AS n FROM v),
    t AS (SELECT route_id, avg(r) AS m, count(*) AS k FROM n WHERE i <= greatest(1, ceil(n * (1 - 0.9e0) - 1e-9)) GROUP BY 1) SELECT route_id, round(m, 5) AS metric, k AS tail_count, round(m / 0.95e0, 5) AS usage, m <= 0.95e0 + 1e-12 AS satisfied FROM t""",
)
def cvar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.risk_constraint(risks(spark, d), "cvar", 0.95, 0.9), "metric", "usage")


CANDIDATES = "SELECT o_custkey AS request, o_orderkey AS id, CAST(floor(o_totalprice / 20000) AS DOUBLE) AS distance_km, CAST(o_orderkey % 9 AS DOUBLE) AS risk_exposure, CAST(o_orderkey % 5 AS DOUBLE) AS caution_len_km, CAST(o_orderkey % 4 AS DOUBLE) AS corridor_score FROM {orders}"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CANDIDATES, orders=spark.read.parquet(f"{d}/orders.parquet"))


DOMINATED = "EXISTS (SELECT 1 FROM k b WHERE b.request = a.request AND b.distance_km <= a.distance_km AND b.risk_exposure <= a.risk_exposure AND (b.distance_km < a.distance_km OR b.risk_exposure < a.risk_exposure))"


@query("pareto_frontier", f"WITH k AS ({CANDIDATES.format(orders='orders')}) SELECT request, id, NOT {DOMINATED} AS frontier FROM k a")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    return R.pareto_frontier(candidates(spark, d), "request").select("request", "id", "frontier")


SCORED = {"distance_km": "1e0", "risk_exposure": "1e0", "caution_len_km": "0.25e0", "corridor_score": "-0.15e0"}


@query(
    "pareto_rank",
    f"WITH RECURSIVE k AS ({CANDIDATES.format(orders='orders')}), u AS (SELECT DISTINCT request, distance_km AS x, risk_exposure AS y FROM k), "
    + """w AS (SELECT a.request, a.x, a.y, b.x AS bx, b.y AS by_ FROM u a JOIN u b ON a.request = b.request AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y)),
    c AS (SELECT request, x, y, 1 AS n FROM u UNION SELECT w.request, w.x, w.y, c.n + 1 FROM c JOIN w ON w.request = c.request AND w.bx = c.x AND w.by_ = c.y), l AS (SELECT request, x, y, max(n) AS pareto_rank FROM c GROUP BY 1, 2, 3), """
    + "e AS (SELECT request, "
    + ", ".join(f"min({m}) AS a_{m}, max({m}) AS b_{m}" for m in SCORED)
    + " FROM k GROUP BY 1), s AS (SELECT k.request, id, distance_km, pareto_rank, round("
    + " + ".join(f"{v} * CASE WHEN b_{m} - a_{m} > 1e-12 THEN ({m} - a_{m}) / (b_{m} - a_{m}) ELSE 0e0 END" for m, v in SCORED.items())
    + ", 6) AS pareto_score FROM k JOIN l ON l.request = k.request AND x = distance_km AND y = risk_exposure JOIN e ON e.request = k.request) "
    + "SELECT request, id, pareto_rank, pareto_score, CAST(row_number() OVER (PARTITION BY request ORDER BY pareto_rank, pareto_score, distance_km, id) AS INTEGER) AS pareto_order FROM s",
)
def ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.pareto_rank(candidates(spark, d), "request").select("request", "id", "pareto_rank", "pareto_score", "pareto_order")


@query(
    "route_overlap",
    SEGMENTS
    + """, c AS (SELECT DISTINCT route_id % 10 AS request, route_id, row, col FROM traced), s AS (SELECT request, route_id, count(*) AS n FROM c GROUP BY 1, 2),
    p AS (SELECT a.request, a.route_id AS route_a, b.route_id AS route_b, count(*) AS shared FROM c a JOIN c b ON a.request = b.request AND a.row = b.row AND a.col = b.col AND a.route_id < b.route_id GROUP BY 1, 2, 3)
    SELECT p.request, route_a, route_b, round(shared / least(x.n, y.n), 5) AS ratio, shared / least(x.n, y.n) >= 0.82e0 AS similar FROM p JOIN s x ON x.route_id = route_a JOIN s y ON y.route_id = route_b""",
)
def overlap(spark: SparkSession, d: str) -> DataFrame:
    cells = R.trace_cells(R.route_segments(adapt(spark, d, "route_points"), GRID)).select((F.col("route_id") % 10).alias("request"), "route_id", "row", "col")
    return rounded(R.route_overlap(cells, "request", each=True), "ratio")


@query(
    "similar_routes",
    SEGMENTS
    + """, c AS (SELECT DISTINCT route_id % 10 AS request, route_id, row, col FROM traced), s AS (SELECT request, route_id, count(*) AS n FROM c GROUP BY 1, 2),
    p AS (SELECT a.request, a.route_id AS route_a, b.route_id AS route_b, count(*) AS shared FROM c a JOIN c b ON a.request = b.request AND a.row = b.row AND a.col = b.col AND a.route_id <> b.route_id GROUP BY 1, 2, 3)
    SELECT p.request, route_a, route_b, round(shared / x.n, 5) AS ratio FROM p JOIN s x ON x.route_id = route_a JOIN s y ON y.route_id = route_b WHERE (x.n < y.n OR x.n = y.n AND route_a < route_b) AND shared / x.n >= 0.3e0""",
)
def similar(spark: SparkSession, d: str) -> DataFrame:
    cells = R.trace_cells(R.route_segments(adapt(spark, d, "route_points"), GRID)).select((F.col("route_id") % 10).alias("request"), "route_id", "row", "col")
    return rounded(R.similar_routes(cells, "request", 0.3, each=True), "ratio")


@query(
    "diversity_penalty",
    POINTS
    + f""", c AS (SELECT DISTINCT route_id, {NODE} FROM route_points), o AS (SELECT a.v AS dr, b.v AS dc FROM (SELECT unnest(range(-3, 4)) AS v) a, (SELECT unnest(range(-3, 4)) AS v) b)
    SELECT CAST(r + dr AS INTEGER) AS row, CAST(c + dc AS INTEGER) AS col, round(least(sum(0.35e0 * (4 - greatest(abs(dr), abs(dc))) / 4), 1.2e0), 5) AS penalty FROM c, o WHERE r + dr BETWEEN 0 AND 51 AND c + dc BETWEEN 0 AND 359 GROUP BY 1, 2""",
)
def diversity(spark: SparkSession, d: str) -> DataFrame:
    row, col, _ = latlon_to_rc(F.col("lat"), F.col("lon"), GRID)
    cells = adapt(spark, d, "route_points").select("route_id", row.alias("row"), col.alias("col"))
    return rounded(R.diversity_penalty(cells, 52, 360), "penalty")


SMALL = Grid(8, 8, 70.0, 77.0, 0.0, 14.0)


@query(
    "edge_costs",
    ctes("cells")
    + f""", c AS (SELECT sample_id, row, col, caution, CASE WHEN row = 3 THEN 1 ELSE 0 END AS near, ais_heatmap, unc FROM cells)
    SELECT a.sample_id, a.row, a.col, b.row AS to_row, b.col AS to_col, round({KM.format(a='(77e0 - a.row)', b='(77e0 - b.row)', c='(2e0 * a.col)', d='(2e0 * b.col)')} * greatest(0.15e0, 1 + CASE WHEN b.caution > 0 THEN 0.22e0 WHEN b.near > 0 THEN 0.06e0 ELSE 0 END + b.unc - 0.02e0 * b.ais_heatmap), 4) AS cost
    FROM c a JOIN c b ON a.sample_id = b.sample_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND NOT (a.row = b.row AND a.col = b.col)""",
)
def edges(spark: SparkSession, d: str) -> DataFrame:
    c = adapt(spark, d, "cells").select("sample_id", "row", "col", "caution", (F.col("row") == 3).cast("int").alias("near_blocked"), F.col("ais_heatmap").alias("corridor"), F.col("unc").alias("penalty"))
    return rounded(R.edge_costs(c, SMALL, key="sample_id"), "cost", digits=4)


@query(
    "nearest_free_cell",
    ctes("cells")
    + """, f AS (SELECT sample_id, row AS fr, col AS fc FROM cells WHERE blocked = 0), m AS (SELECT max(sample_id) + 1 AS n FROM cells),
    p AS (SELECT event_id % n AS sample_id, event_id AS id, CAST(event_id % 8 AS INTEGER) AS row, CAST(user_id % 8 AS INTEGER) AS col FROM events, m),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pow(fr - row, 2) + pow(fc - col, 2), fr, fc) AS i FROM p JOIN f USING (sample_id))
    SELECT sample_id, id, row, col, fr AS free_row, fc AS free_col FROM r WHERE i = 1""",
)
def free(spark: SparkSession, d: str) -> DataFrame:
    """Points are dealt to the maps by their number, so every point and every map has its part."""
    cells = adapt(spark, d, "cells").select("sample_id", "row", "col", "blocked")
    maps = cells.agg((F.max("sample_id") + 1).alias("maps"))
    points = spark.read.parquet(f"{d}/events.parquet").crossJoin(F.broadcast(maps))  # one row
    points = points.select((F.col("event_id") % F.col("maps")).alias("sample_id"), F.col("event_id").alias("id"), (F.col("event_id") % 8).cast("int").alias("row"), (F.col("user_id") % 8).cast("int").alias("col"))
    return R.nearest_free_cell(points, cells, key="sample_id")


PROFILE = "(CASE v WHEN 'ice_class_bulk' THEN 0.8e0 WHEN 'open_water_cargo' THEN 0.5e0 WHEN 'icebreaker' THEN 1.2e0 ELSE 1e0 END)"


@query(
    "apply_vessel_profile",
    f"""WITH r AS (SELECT event_id, ['arc7_lng', 'ice_class_bulk', 'open_water_cargo', 'icebreaker', 'unknown'][event_id % 5 + 1] AS v, value / 490e0 AS b, CASE WHEN event_id % 2 = 0 THEN 'strict' END AS m FROM events)
    SELECT event_id, round(least(greatest(b * {PROFILE}, 0e0), 1e0), 6) AS corridor_bias, coalesce(m, CASE v WHEN 'ice_class_bulk' THEN 'budget' WHEN 'open_water_cargo' THEN 'minimize' ELSE 'tie_breaker' END) AS caution_mode FROM r""",
)
def vessels(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, (*(v[0] for v in R.VESSELS), "unknown")))
    e = spark.read.parquet(f"{d}/events.parquet")
    requests = e.select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("vessel"), (F.col("value") / 490).alias("corridor_bias"), F.when(F.col("event_id") % 2 == 0, "strict").alias("caution_mode"))
    return rounded(R.apply_vessel_profile(requests, R.profiles(spark)).select("event_id", "corridor_bias", "caution_mode"), "corridor_bias", digits=6)


NOW = "2024-01-30 23:55:00"
HEALTH = (
    ctes("source_events")
    + f""", o AS (SELECT source, max(ts) FILTER (WHERE ok) AS good FROM source_events GROUP BY 1), f AS (SELECT source, count(*) AS n, max(ts) AS bad FROM source_events JOIN o USING (source) WHERE NOT ok AND (good IS NULL OR ts > good) GROUP BY 1),
    h AS (SELECT source, coalesce(n, 0) AS failure_count, bad AS last_failure_at, good AS last_success_at, epoch_us(bad) + 3600000000 - epoch_us(TIMESTAMP '{NOW}') AS us FROM o LEFT JOIN f USING (source)),
    health AS (SELECT source, failure_count, last_failure_at, last_success_at, coalesce(failure_count >= 1 AND us > 0, false) AS circuit_open, CASE WHEN failure_count >= 1 AND us > 0 THEN CAST(greatest(1, floor(us / 1000000)) AS BIGINT) ELSE 0 END AS retry_after_sec FROM h)\n"""
)


def health_of(spark: SparkSession, d: str) -> DataFrame:
    return T.source_health(adapt(spark, d, "source_events"), F.lit(NOW), 1, 3600)


@query("source_health", HEALTH + "SELECT * FROM health")
def health(spark: SparkSession, d: str) -> DataFrame:
    return health_of(spark, d)


@query(
    "source_credibility",
    HEALTH
    + """, s AS (SELECT count(*) FILTER (WHERE NOT circuit_open AND failure_count = 0) AS healthy, count(*) FILTER (WHERE NOT circuit_open AND failure_count > 0) AS degraded, count(*) FILTER (WHERE circuit_open) AS blocked FROM health)
    SELECT *, CASE WHEN blocked > 0 THEN 'high_risk' WHEN degraded > 0 THEN 'medium_risk' ELSE 'normal' END AS level FROM s""",
)
def credibility(spark: SparkSession, d: str) -> DataFrame:
    return T.source_credibility(health_of(spark, d))


@query(
    "progress_state",
    ctes("progress_events")
    + f""", l AS (SELECT progress_id, ts, status, percent, row_number() OVER (PARTITION BY progress_id ORDER BY ts DESC, event_id DESC) AS i FROM progress_events),
    s AS (SELECT progress_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, percent, status = 'completed' AS done, ts FROM l WHERE i = 1)
    SELECT progress_id, status, CASE WHEN done THEN 100 WHEN status = 'failed' THEN greatest(least(greatest(percent, 0), 100), 1) ELSE least(greatest(percent, 0), 100) END AS percent, ts AS updated_at FROM s WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 8 HOUR ORDER BY ts DESC, progress_id LIMIT 60""",
)
def progress(spark: SparkSession, d: str) -> DataFrame:
    return T.progress_state(adapt(spark, d, "progress_events"), F.lit(NOW), 8, 60, True)


@query(
    "run_lifecycle",
    ctes("run_events")
    + """, s AS (SELECT run_id, max((ts, event_id)) FILTER (WHERE action = 'delete') AS de, max((ts, event_id)) FILTER (WHERE action = 'restore') AS re, min((ts, event_id)) FILTER (WHERE action = 'create') AS cr,
      max(ts) FILTER (WHERE action = 'delete') AS dt, max(ts) FILTER (WHERE action = 'restore') AS rt, min(ts) FILTER (WHERE action = 'create') AS ct FROM run_events GROUP BY 1),
    g AS (SELECT *, coalesce(dt > ct AND (rt IS NULL OR rt < dt), false) AS gone, coalesce(dt > ct AND rt > dt, false) AS back FROM s WHERE ct IS NOT NULL)
    SELECT run_id, CASE WHEN gone THEN 'recycled' ELSE 'active' END AS state, CASE WHEN gone THEN dt WHEN back THEN rt ELSE ct END AS since FROM g""",
)
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return T.run_lifecycle(adapt(spark, d, "run_events"))


FRESH = f"""WITH l AS (SELECT event_type AS layer, max(ts) - INTERVAL 1 HOUR * (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 30 WHEN 'error' THEN 100 ELSE 24 END) AS ts FROM events WHERE event_type <> 'purchase' GROUP BY event_type UNION ALL SELECT 'none', NULL),
    a AS (SELECT layer, ts, greatest(0e0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9) AS age FROM l),
    f AS (SELECT layer, round(CASE WHEN ts IS NOT NULL THEN age END, 5) AS age_hours, CASE WHEN ts IS NULL THEN 'unknown' WHEN age <= 24 THEN 'fresh' WHEN age <= 72 THEN 'stale' ELSE 'outdated' END AS status FROM a)\n"""


def layers(spark: SparkSession, d: str) -> DataFrame:
    back = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 30).when(F.col("event_type") == "error", 100).otherwise(24)
    by = spark.read.parquet(f"{d}/events.parquet").where("event_type <> 'purchase'").groupBy("event_type").agg(F.max("ts").alias("ts"))
    by = by.select(F.col("event_type").alias("layer"), (F.col("ts").cast("timestamp") - F.make_interval(hours=back)).alias("ts"))
    return by.unionByName(spark.createDataFrame([("none", None)], by.schema))


@query("freshness", FRESH + "SELECT layer, age_hours, status FROM f")
def fresh(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.freshness(layers(spark, d), F.lit(NOW)).select("layer", "age_hours", "status"), "age_hours")


@query("worst_freshness", FRESH + "SELECT CASE WHEN bool_or(status = 'unknown') THEN 'unknown' WHEN bool_or(status = 'outdated') THEN 'outdated' WHEN bool_or(status = 'stale') THEN 'stale' ELSE 'fresh' END AS overall FROM f")
def overall(spark: SparkSession, d: str) -> DataFrame:
    return T.worst_freshness(T.freshness(layers(spark, d), F.lit(NOW)))


@query(
    "risk_budget_modes",
    ctes("steps")
    + """, u AS (SELECT *, coalesce(sum(risk_extra_km) OVER (PARTITION BY sequence_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) / 12e0 AS usage FROM steps),
    s AS (SELECT *, CASE WHEN usage >= 1 THEN 'hard' WHEN usage >= 0.7e0 THEN 'warn' ELSE 'normal' END AS stage FROM u),
    m AS (SELECT *, CASE stage WHEN 'hard' THEN 'aggressive' WHEN 'warn' THEN 'conservative' ELSE 'balanced' END AS mode FROM s)
    SELECT sequence_id, step_index, round(usage, 7) AS usage, stage, mode, coalesce(lag(mode) OVER (PARTITION BY sequence_id ORDER BY step_index) <> mode, false) AS switched FROM m""",
)
def budget(spark: SparkSession, d: str) -> DataFrame:
    out = T.risk_budget_modes(adapt(spark, d, "steps"), 12.0)
    return rounded(out.select("sequence_id", "step_index", "usage", "stage", "mode", "switched"), "usage", digits=7)


@query("sequence_steps", ctes("steps") + "SELECT sequence_id, step_index, round(sum(moved_distance_km) OVER w, 3) AS total_km, round(sum(runtime_ms) OVER w, 2) AS total_ms, step_index = max(step_index) OVER (PARTITION BY sequence_id) AS is_last FROM steps WINDOW w AS (PARTITION BY sequence_id ORDER BY step_index ROWS UNBOUNDED PRECEDING)")
def sequences(spark: SparkSession, d: str) -> DataFrame:
    out = T.sequence_steps(adapt(spark, d, "steps")).select("sequence_id", "step_index", "total_km", "total_ms", "is_last")
    return rounded(rounded(out, "total_km", digits=3), "total_ms", digits=2)


def modes_sql(interval: int, budget: str = "12e0") -> str:
    """Recursive CTE `modes`: a sequence in order, with the mode in force and the step of its last switch."""
    return (
        ctes("steps").replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", u AS (SELECT *, greatest(0e0, coalesce(sum(risk_extra_km) OVER (PARTITION BY sequence_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) / {budget}) AS usage FROM steps),
        v AS (SELECT *, CASE WHEN usage >= 1 THEN 'hard' WHEN usage >= 0.7e0 THEN 'warn' ELSE 'normal' END AS stage FROM u),
        t AS (SELECT *, CASE stage WHEN 'hard' THEN 'aggressive' WHEN 'warn' THEN 'conservative' ELSE 'balanced' END AS wanted FROM v),
        modes AS (SELECT sequence_id, step_index, usage, stage, 'balanced' AS previous_mode, wanted AS mode, wanted <> 'balanced' AS switched, CASE WHEN wanted <> 'balanced' THEN 0 ELSE -10000 END AS last FROM t WHERE step_index = 0
          UNION ALL SELECT t.sequence_id, t.step_index, t.usage, t.stage, m.mode, CASE WHEN wanted <> m.mode AND t.step_index - last >= {interval} THEN wanted ELSE m.mode END, wanted <> m.mode AND t.step_index - last >= {interval},
          CASE WHEN wanted <> m.mode AND t.step_index - last >= {interval} THEN t.step_index ELSE last END FROM modes m JOIN t ON t.sequence_id = m.sequence_id AND t.step_index = m.step_index + 1)\n"""
    )


#: Risk that is won back on every third step, so that stages change to and fro.
WAVES = ("risk_extra_km", "CASE WHEN step_index % 3 = 2 THEN -0.8e0 ELSE 1e0 END * risk_extra_km")


def waves(spark: SparkSession, d: str) -> DataFrame:
    return adapt(spark, d, "steps").withColumn("risk_extra_km", F.expr(WAVES[1].replace("e0", "D")))


def waved(sql: str) -> str:
    return sql.replace("sum(risk_extra_km)", f"sum({WAVES[1]})")


@query("risk_budget_modes_interval", waved(modes_sql(3, "1.2e0")) + "SELECT sequence_id, step_index, round(usage, 7) AS usage, stage, mode, previous_mode, switched FROM modes")
def budget_interval(spark: SparkSession, d: str) -> DataFrame:
    out = T.risk_budget_modes(waves(spark, d), 1.2, min_interval=3)
    return rounded(out.select("sequence_id", "step_index", "usage", "stage", "mode", "previous_mode", "switched"), "usage", digits=7)


@query("risk_switch_events", waved(modes_sql(2, "1.2e0")) + "SELECT sequence_id, step_index, previous_mode AS from_mode, mode AS to_mode, stage AS budget_stage, round(usage, 6) AS budget_usage, 2 AS cooldown_steps FROM modes WHERE switched")
def switches(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.risk_switch_events(T.risk_budget_modes(waves(spark, d), 1.2, min_interval=2), 2), "budget_usage", digits=6)


def trigger_sql(first: str, extra: str) -> str:
    return (
        f"""s AS (SELECT sequence_id, step_index, risk_extra_km / 8 - lag(risk_extra_km / 8) OVER (PARTITION BY sequence_id ORDER BY step_index) AS spike, moved_distance_km / 20000 AS blocked, 1 - moved_distance_km / 500 AS corridor, {extra} FROM {first}),
    b AS (SELECT sequence_id, step_index, concat_ws(',', CASE WHEN step_index = 0 THEN 'initial_step' END, CASE WHEN step_index > 0 AND cached < 2 THEN 'no_cached_path' END, CASE WHEN step_index > 0 AND blocked >= 0.02e0 THEN 'blocked_change_ratio' END, CASE WHEN cached > 0 AND step_index % 11 = 5 THEN 'path_blocked' END,
      CASE WHEN step_index > 0 AND cached > 0 AND corridor < 0.05e0 THEN 'corridor_mismatch' END, CASE WHEN step_index > 0 AND cached > 0 AND spike >= 0.05e0 THEN 'risk_spike' END) AS base,
      concat_ws(',', CASE WHEN switched THEN 'risk_mode_switch' END, CASE WHEN stage = 'hard' THEN 'risk_budget_pressure' END) AS more FROM s),
    f AS (SELECT sequence_id, step_index, base, more, false AS due, step_index AS last FROM b WHERE step_index = 0
      UNION ALL SELECT b.sequence_id, b.step_index, b.base, b.more, b.step_index - f.last >= 3, CASE WHEN b.base <> '' OR b.more <> '' OR b.step_index - f.last >= 3 THEN b.step_index ELSE f.last END FROM f JOIN b ON b.sequence_id = f.sequence_id AND b.step_index = f.step_index + 1)
    SELECT sequence_id, step_index, concat_ws(',', nullif(base, ''), CASE WHEN due THEN 'max_skip_steps' END, nullif(more, '')) AS reasons, base <> '' OR due OR more <> '' AS replan FROM f"""
    )


def trigger_steps(s: DataFrame) -> DataFrame:
    return s.select("sequence_id", "step_index", (F.col("moved_distance_km") / 20000).alias("blocked_change"), (F.col("step_index") % 11 == 5).cast("int").alias("path_blocked"), (1 - F.col("moved_distance_km") / 500).alias("corridor"), (F.col("risk_extra_km") / 8).alias("risk"), *(c for c in ("cached_cells", "stage", "switched") if c in s.columns))


@query("replan_triggers", ctes("steps").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + trigger_sql("steps", "2 AS cached, false AS switched, '' AS stage"))
def triggers(spark: SparkSession, d: str) -> DataFrame:
    return T.replan_triggers(trigger_steps(adapt(spark, d, "steps"))).select("sequence_id", "step_index", F.array_join("reasons", ",").alias("reasons"), "replan")


@query(
    "replan_triggers_budget",
    waved(modes_sql(3, "1.2e0")) + ", " + trigger_sql("steps JOIN modes USING (sequence_id, step_index)", "step_index % 7 AS cached, switched, stage"),
)
def budget_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Modes with a minimum interval of three steps; every seventh step has no cached path, another one a path of one cell."""
    modes = T.risk_budget_modes(waves(spark, d), 1.2, min_interval=3).select("sequence_id", "step_index", "stage", "switched")
    steps = adapt(spark, d, "steps").join(modes, ["sequence_id", "step_index"]).withColumn("cached_cells", F.col("step_index") % 7)
    return T.replan_triggers(trigger_steps(steps)).select("sequence_id", "step_index", F.array_join("reasons", ",").alias("reasons"), "replan")


@query("replay_slice", ctes("steps") + "SELECT sequence_id, step_index, next_step FROM (SELECT *, lead(step_index) OVER (PARTITION BY sequence_id ORDER BY step_index) AS next_step FROM steps) WHERE step_index BETWEEN 10 AND 20")
def replayed(spark: SparkSession, d: str) -> DataFrame:
    return T.replay_slice(adapt(spark, d, "steps"), 10, 20).select("sequence_id", "step_index", "next_step")


@query(
    "sequence_issues",
    ctes("steps")
    + """, s AS (SELECT * FROM steps WHERE NOT (sequence_id % 3 = 0 AND step_index = 2) AND NOT (sequence_id % 5 = 0 AND step_index = 0)), g AS (SELECT sequence_id, count(*) AS steps, min(step_index) AS a, max(step_index) AS b FROM s GROUP BY 1)
    SELECT sequence_id, steps, concat_ws(',', CASE WHEN a <> 0 THEN 'first_step_not_zero' END, CASE WHEN b - a + 1 <> steps THEN 'step_gap_or_repeat' END) AS issues FROM g""",
)
def issues(spark: SparkSession, d: str) -> DataFrame:
    steps = adapt(spark, d, "steps").where("NOT (sequence_id % 3 = 0 AND step_index = 2) AND NOT (sequence_id % 5 = 0 AND step_index = 0)")
    return T.sequence_issues(steps).select("sequence_id", "steps", F.array_join("issues", ",").alias("issues"))
