"""Connected components of edge tables, and of set cells of maps by tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def _written(df: DataFrame, name: str) -> DataFrame:
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it can reach) of the nodes of edges (a, b); nodes are of any type that can be ordered.

    In each round every node takes over the smallest label around it, then the label of its label (so labels travel twice as far each time);
    the rounds grow with the logarithm of the longest way. Labels are sums by key, edges stay as they are.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = _written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = _written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("near"))
        # a label is a node too, and may have been told of a smaller one
        told = labels.join(near, "u").groupBy(F.col("label").alias("u")).agg(F.min("near").alias("told"))
        step = labels.join(near, "u").join(told, "u", "left").select("u", F.least("label", "near", "told").alias("new"), "label")
        step = _written(step, "labels")
        jump = step.join(step.select(F.col("u").alias("new"), F.col("new").alias("far")), "new", "left")
        after = _written(jump.select("u", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("moved")), "labels")
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def _label(on: np.ndarray) -> np.ndarray:
    """The first cell (row-major) of each set cell's 8-connected part; -1 on the others."""
    framed = np.zeros((on.shape[0] + 2, on.shape[1] + 2), bool)
    framed[1:-1, 1:-1] = on
    big = np.iinfo(np.int64).max
    lab = np.where(framed, np.arange(framed.size).reshape(framed.shape), big)
    while True:
        low = lab
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                low = np.minimum(low, np.roll(lab, (dr, dc), (0, 1)))
        # a label is a cell: take over that cell's label too, so long shapes need few rounds
        low = np.where(framed, np.minimum(low, low.ravel()[np.where(framed, low, 0)]), big)
        if (low == lab).all():
            break
        lab = low
    r, c = np.divmod(lab, framed.shape[1])
    return np.where(framed, (r - 1) * on.shape[1] + c - 1, -1)[1:-1, 1:-1]


def _tiles(cells: DataFrame, column: str, key: str, tile: int) -> DataFrame:
    """key, row, col, label of the set cells: the first cell (row << 32 | col) of their part of the tile."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        on = np.zeros((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), bool)
        on[pdf["row"] - r0, pdf["col"] - c0] = True
        first = _label(on)[pdf["row"] - r0, pdf["col"] - c0]
        return pd.DataFrame({key: pdf[key], "row": pdf["row"], "col": pdf["col"], "label": (first // on.shape[1] + r0 << 32) + first % on.shape[1] + c0})

    kinds = {c: cells.schema[c].dataType.simpleString() for c in (key, "row", "col")}
    on = cells.where(F.col(column) > 0).select(key, "row", "col").distinct()
    return on.groupBy(key, F.floor(F.col("row") / tile).alias("__y"), F.floor(F.col("col") / tile).alias("__x")).applyInPandas(label, f"{key} {kinds[key]}, row {kinds['row']}, col {kinds['col']}, label long")


def _seams(tiles: DataFrame, key: str, tile: int) -> DataFrame:
    """key, label, root of the labels that touch another tile's: the smallest label they are joined with across seams."""
    edge = tiles.where(F.expr(f"pmod(row, {tile}) IN (0, {tile - 1}) OR pmod(col, {tile}) IN (0, {tile - 1})"))
    # half of the eight neighbours: each pair is met from one side
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    asked = edge.select(key, "label", "row", "col", F.explode(steps).alias("o")).select(key, "label", F.col("row").alias("r0"), F.col("col").alias("c0"), (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    other = F.expr(f"floor(r0 / {tile}) <> floor(row / {tile}) OR floor(c0 / {tile}) <> floor(col / {tile})")
    met = asked.where(other).join(edge.select(key, "row", "col", F.col("label").alias("beside")), [key, "row", "col"])
    node = lambda c: F.struct(F.col(key).alias("map"), F.col(c).alias("label"))
    found = components(met.select(node("label").alias("a"), node("beside").alias("b")).distinct())
    return found.select(F.col("node.map").alias(key), F.col("node.label").alias("label"), F.col("component.label").alias("root"))


def label_components(cells: DataFrame, column: str = "caution", key: str = "sample_id", tile: int = 256) -> DataFrame:
    """key, row, col, component for the set cells of each map: 8-connected, named by their first cell (row << 32 | col).

    Tiles are labelled by themselves, so a task holds one tile however large the map; labels that touch across seams are joined
    as components of a graph, which has rows for the cells along seams only.
    """
    tiles = _written(_tiles(cells, column, key, tile), "tiles")
    roots = _seams(tiles, key, tile)
    return tiles.join(roots, [key, "label"], "left").select(key, "row", "col", F.coalesce("root", "label").alias("component"))


def component_sizes(cells: DataFrame, column: str = "caution", key: str = "sample_id", tile: int = 256) -> DataFrame:
    """key, component, n: cells are counted by tile and label before seams join them."""
    tiles = _written(_tiles(cells, column, key, tile), "tiles")
    counts = tiles.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(_seams(tiles, key, tile), [key, "label"], "left").groupBy(key, F.coalesce("root", "label").alias("component")).agg(F.sum("n").alias("n"))
