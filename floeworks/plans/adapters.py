"""The domain's inputs from the generic test tables, as SQL that Spark and DuckDB both run.

Table names stand in braces. Spark gets DataFrames for them, DuckDB the views of those names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "ais": """
        SELECT event_id, user_id AS mmsi, ts AS postime,
               -180e0 + 36e0 * (user_id % 10) + value / 20e0 AS lon,
               CASE WHEN user_id % 50 = 7 THEN 50e0 ELSE 60e0 + 2.5e0 * (user_id % 10) + value / 200e0 END AS lat
        FROM {events}""",
    "route_points": """
        SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
               -180e0 + 36e0 * (user_id % 10) + value / 20e0 AS lon,
               60e0 + 2.5e0 * (user_id % 10) + value / 200e0 AS lat
        FROM {events}""",
    "hours": """
        SELECT date_trunc('hour', ts) AS ts FROM {events} GROUP BY 1 HAVING 6 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= count(*)""",
    "source_events": """
        SELECT concat('src', CAST(user_id % 10 AS VARCHAR(8))) AS source, ts, event_id, event_type <> 'error' AS ok FROM {events}""",
    "run_events": """
        SELECT user_id AS run_id, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'restore' ELSE 'touch' END AS action
        FROM {events}""",
    "run_actions": """
        SELECT user_id AS run_id, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'restore' WHEN 'purchase' THEN 'purge' ELSE 'touch' END AS action
        FROM {events}""",
    "progress_events": """
        SELECT user_id AS progress_id, ts, event_id,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
               CAST(floor(value / 3e0) AS INT) - 10 AS percent
        FROM {events}""",
    "steps": """
        SELECT user_id AS sequence_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step_index, ts,
               value AS moved_distance_km, value * 10e0 AS runtime_ms, value / 1000e0 AS risk_extra_km
        FROM {events}""",
    "calibration_pairs": """
        SELECT event_id, 1e0 - value / 500e0 AS confidence,
               CASE WHEN (event_id * 7919) % 1000 < 1000e0 * (1e0 - (value / 500e0) * (value / 500e0)) THEN 1 ELSE 0 END AS outcome
        FROM {events}""",
    "bench": """
        SELECT o.o_orderkey AS run_id,
               CASE WHEN o.o_orderkey % 2 = 0 THEN 'static' ELSE 'dynamic' END AS mode,
               o.o_orderpriority AS planner,
               CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 3 = 0 THEN 'fail' ELSE 'ok' END AS status,
               o.o_orderdate AS window_start, o.o_orderkey % 2 AS repeat_idx,
               o.o_totalprice / 100e0 AS runtime_ms,
               sum(l.l_quantity) AS distance_km,
               sum(l.l_quantity * l.l_discount) AS caution_len_km,
               sum(l.l_extendedprice * l.l_tax) / 1000e0 AS risk_exposure,
               sum(l.l_extendedprice) / 1000e0 AS route_cost_effective_km,
               count(*) AS replan_count
        FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
        GROUP BY o.o_orderkey, o.o_orderpriority, o.o_orderstatus, o.o_orderdate, o.o_totalprice""",
    "manifest_new": """
        SELECT concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR(20))) AS path, n_chars AS size, doc_id AS mtime_ns,
               lang AS month, source, text
        FROM {documents}""",
    "manifest_old": """
        SELECT concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR(20))) AS path,
               CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS size, doc_id AS mtime_ns,
               lang AS month, source, concat('h', CAST(doc_id % 97 AS VARCHAR(8))) AS hash
        FROM {documents} WHERE doc_id % 7 <> 0""",
    "layer_files": """
        SELECT CAST(floor(vec_id / 5e0) AS BIGINT) AS sample_id,
               CASE vec_id % 5 WHEN 0 THEN 'x_stack' WHEN 1 THEN 'blocked_mask' WHEN 2 THEN 'ais_heatmap' WHEN 3 THEN 'pred' ELSE 'uncertainty' END AS layer,
               8 AS h, CASE WHEN label = 8 THEN 16 ELSE 8 END AS w
        FROM {embeddings} WHERE label <> 9""",
    "review_decisions": """
        SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'needs_revision' END AS decision FROM {labels}""",
}

PIXELS = {
    "spark": "SELECT vec_id, pos, CAST(val AS DOUBLE) AS val FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, val",
    "duckdb": "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings",
}
CELLS = """
        SELECT sample_id, row, col,
               50e0 + 100e0 * c0 AS ice_conc, 2e0 + 4e0 * c1 AS wave_hs, 20e0 * c2 AS wind_u10, 20e0 * c3 AS wind_v10,
               abs(c4) AS ais_heatmap, 100e0 * c2 - 20e0 AS bathy,
               CASE WHEN c0 > 0.12e0 THEN 1 ELSE 0 END AS caution,
               CASE WHEN 100e0 * c2 - 20e0 >= 0e0 THEN 1 ELSE 0 END AS blocked,
               CASE WHEN c2 >= 0.2e0 THEN 2 WHEN c0 + c1 > 0.2e0 THEN 1 ELSE 0 END AS pred,
               least(1e0, 2e0 * abs(c4)) AS unc
        FROM (
          SELECT CAST(floor(vec_id / 5e0) AS BIGINT) AS sample_id, CAST(floor(pos / 8e0) AS INT) AS row, CAST(pos % 8 AS INT) AS col,
                 max(CASE WHEN vec_id % 5 = 0 THEN val END) AS c0, max(CASE WHEN vec_id % 5 = 1 THEN val END) AS c1,
                 max(CASE WHEN vec_id % 5 = 2 THEN val END) AS c2, max(CASE WHEN vec_id % 5 = 3 THEN val END) AS c3,
                 max(CASE WHEN vec_id % 5 = 4 THEN val END) AS c4
          FROM (PIXELS) px GROUP BY 1, 2, 3
        ) t"""


def _tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


#: Order lines that one task joins and sums.
LINES = 1_000_000


def _dealt(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Orders and their lines dealt by order where the session's partitions would hold more than LINES lines each, so a task's memory doesn't grow with the table."""
    lines = frames["lineitem"]
    parts = math.ceil(lines.count() / LINES)
    if parts <= int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return frames
    return {t: f.repartition(parts, {"orders": "o_orderkey", "lineitem": "l_orderkey"}[t]) for t, f in frames.items()}


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter `name` over the tables of sf_dir; zone-less timestamps become timestamps (UTC session)."""
    sql = CELLS.replace("PIXELS", PIXELS["spark"]) if name == "cells" else SQL[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(sql)}
    return spark.sql(sql, **(_dealt(frames) if name == "bench" else frames))


def ctes(*names: str) -> str:
    """`WITH name AS (...), ...` for DuckDB."""
    found = {n: CELLS.replace("PIXELS", PIXELS["duckdb"]) if n == "cells" else SQL[n] for n in names}
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', s)})" for n, s in found.items()) + "\n"
