"""Vessel density: rolling counts per cell and their normal form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid, to_cell


def centers(spark, months: Sequence[str], step_hours: int) -> DataFrame:  # noqa: ANN001
    """All timestamps of the months (`yyyyMM`) at the given step, from each month's first hour."""
    rows = spark.createDataFrame([(m,) for m in months], "month string").withColumn("a", F.to_timestamp(F.concat("month", F.lit("01")), "yyyyMMdd"))
    return rows.select(F.explode(F.expr(f"sequence(a, CAST(add_months(a, 1) AS TIMESTAMP) - interval 1 second, interval {step_hours} hours)")).alias("center"))


def ais_heatmap_counts(ais: DataFrame, grid: Grid, window_hours: int = 168, step_hours: int = 6, months: Sequence[str] | None = None) -> DataFrame:
    """center, row, col, n: positions of each cell in [center - window, center).

    Positions are first counted by step and cell, so only these counts are repeated for the centers of
    their window and shuffled; a busy cell is summed before it moves. With months, every center of theirs is kept: one without positions has a row
    with null row and col and n = 0. Where the step does not divide a day or the window, the built-in sliding
    window takes over.
    """
    row, col = to_cell(F.col("lat"), F.col("lon"), grid)
    cells = ais.select(F.col("postime").cast("timestamp").alias("t"), row.alias("row"), col.alias("col")).where("row IS NOT NULL")
    if 24 % step_hours == 0 and window_hours % step_hours == 0:
        step = step_hours * 3600
        pre = cells.groupBy(F.floor(F.unix_seconds("t") / step).alias("b"), "row", "col").agg(F.count(F.lit(1)).alias("n"))
        spread = pre.select("row", "col", "n", F.explode(F.expr(f"sequence(b + 1, b + {window_hours // step_hours})")).alias("b"))
        spread = spread.withColumn("center", F.timestamp_seconds(F.col("b") * step)).groupBy("center", "row", "col").agg(F.sum("n").alias("n"))
    else:
        w = F.window("t", f"{window_hours} hours", f"{step_hours} hours")
        spread = cells.groupBy(w.end.alias("center"), "row", "col").agg(F.count(F.lit(1)).alias("n"))
    if months is None:
        return spread
    spine = F.broadcast(centers(ais.sparkSession, months, step_hours))  # at most 744 rows a month
    return spine.join(spread, "center", "left").select("center", "row", "col", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalize_heatmap(counts: DataFrame) -> DataFrame:
    """counts with heat: log1p(n) over its largest value in each map (0 for an empty map)."""
    top = counts.groupBy("center").agg(F.log1p(F.max("n")).alias("top"))
    return counts.join(top, "center").withColumn("heat", F.when(F.col("top") > 0, F.log1p("n") / F.col("top")).otherwise(0.0)).drop("top")
