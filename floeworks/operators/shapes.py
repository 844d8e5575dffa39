"""Shapes to cells by scan lines, in built-in functions: crossings a row, spans, then the cells of spans that don't overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .raster import KEY

#: Fixed value: what keeps the slope of a level edge finite.
EPS = 1e-9


def _edges(ops: DataFrame, keys: list[str], closed: bool) -> DataFrame:
    """One row an edge, from point 0 (row y0, col x0) to point 1; a polygon's first edge comes from its last point."""
    p, n = F.col("points"), F.size("points")
    before = lambda i: F.get(p, F.when(i == 0, n - 1).otherwise(i - 1))
    zipped = F.transform(p, lambda x, i: F.struct(before(i)["row"].cast("double").alias("y0"), before(i)["col"].cast("double").alias("x0"), x["row"].cast("double").alias("y1"), x["col"].cast("double").alias("x1")))
    return ops.select(*keys, F.explode(zipped if closed else F.slice(zipped, 2, F.greatest(n - 1, F.lit(0)))).alias("e")).select(*keys, "e.*")


def _steps(edges: DataFrame, keys: list[str]) -> DataFrame:
    """row and col of the points that lie evenly along each edge, a cell apart in its longer direction, both ends included."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))).cast("int")
    i = F.col("i")
    at = lambda a, b: F.rint(F.when((i == F.col("n")) & (i > 0), F.col(b)).otherwise(F.col(a) + i * ((F.col(b) - F.col(a)) / F.greatest(F.col("n"), F.lit(1))))).cast("long")
    spread = edges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return spread.select(*keys, at("y0", "y1").alias("row"), at("x0", "x1").alias("col"))


def _clip(c: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return F.greatest(low, F.least(high, c))


def _polygons(ops: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Spans of the cells whose centre is inside by the even-odd rule, and the cells along the edges."""
    edges = _edges(ops, keys, True)
    # a row is crossed where one end of the edge is above its centre line and the other isn't
    first = F.greatest(F.ceil(F.least("y0", "y1") - 0.5), F.lit(0))
    last = F.least(F.ceil(F.greatest("y0", "y1") - 0.5) - 1, F.lit(height - 1))
    crossed = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    x = (F.col("x0") - F.col("x1")) * (F.col("row") + 0.5 - F.col("y1")) / ((F.col("y0") - F.col("y1")) + EPS) + F.col("x1")
    ends = crossed.select(*keys, "row", x.alias("x")).groupBy(*keys, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # the edges that cross one row
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.ceil(F.get("xs", 2 * k) - 0.5).alias("lo"), (F.ceil(F.get("xs", 2 * k + 1) - 0.5) - 1).alias("hi")))
    inside = ends.where(F.size("xs") > 1).select(*keys, "row", F.explode(pairs).alias("s")).select(*keys, "row", "s.*")
    box = ops.select(*[F.col(c).alias(f"__{c}") for c in keys], *(f(F.col("points")[c]).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.array_min), ("max", F.array_max))))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    low = lambda c, end: _clip(F.floor(F.col(f"min_{c}")) - 1, 0, end)
    high = lambda c, end: _clip(F.ceil(F.col(f"max_{c}")) + 1, 0, end)
    along = _steps(edges, keys).join(box, same).select(*keys, _clip(F.col("row"), low("row", height - 1), high("row", height - 1)).alias("row"), _clip(F.col("col"), low("col", width - 1), high("col", width - 1)).alias("col"))
    return inside.unionByName(along.select(*keys, "row", F.col("col").alias("lo"), F.col("col").alias("hi")))


def _strokes(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of the discs (radius in whole cells, at least one) around the points along a line."""
    at = _steps(_edges(ops, [*keys, "radius"], False), [*keys, "radius"]).distinct()
    r = F.greatest(F.coalesce(F.col("radius"), F.lit(1)).cast("long"), F.lit(1))
    spread = at.withColumn("r", r).withColumn("d", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    half = F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("d") * F.col("d")))
    return spread.select(*keys, (F.col("row") + F.col("d")).alias("row"), (F.col("col") - half).alias("lo"), (F.col("col") + half).alias("hi"))


def _boxes(ops: DataFrame, keys: list[str]) -> DataFrame:
    ends = lambda c: (F.ceil(F.array_min(F.col("points")[c])), F.floor(F.array_max(F.col("points")[c])))
    (top, bottom), (left, right) = ends("row"), ends("col")
    made = ops.select(*keys, top.alias("top"), bottom.alias("bottom"), left.alias("lo"), right.alias("hi")).where("top <= bottom")
    return made.select(*keys, F.explode(F.sequence("top", "bottom")).alias("row"), "lo", "hi")


def _circles(ops: DataFrame, keys: list[str]) -> DataFrame:
    a, b = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    made = ops.select(*keys, a["row"].cast("double").alias("y"), a["col"].cast("double").alias("x"), F.hypot(b["col"] - a["col"], b["row"] - a["row"]).alias("r"))
    rows = made.where(F.ceil(F.col("y") - F.col("r")) <= F.floor(F.col("y") + F.col("r"))).withColumn("row", F.explode(F.sequence(F.ceil(F.col("y") - F.col("r")), F.floor(F.col("y") + F.col("r")))))
    half = F.sqrt(F.greatest(F.col("r") * F.col("r") - (F.col("row") - F.col("y")) * (F.col("row") - F.col("y")), F.lit(0.0)))
    return rows.select(*keys, "row", F.ceil(F.col("x") - half).alias("lo"), F.floor(F.col("x") + half).alias("hi"))


def rasterize(ops: DataFrame, height: int, width: int, key: str = KEY) -> DataFrame:
    """ops (key, op_idx, mode, shape, radius, points array<struct<col, row>>) as cells: key, op_idx, mode, row, col, each once.

    Polygons (three points or more; also what has no known shape) take the cells whose centre is inside, and those along their edges; strokes (two points or
    more) the discs around the points along them; rectangles hold all their points (two corners are enough), circles a centre and a point. Every shape becomes spans of rows;
    overlapping spans of one operation are merged before their cells are listed, so the work follows the covered cells.
    """
    keys = [key, "op_idx", "mode"]
    some = ops.select(*keys, "shape", "radius", "points").where("points IS NOT NULL")
    n, shape = F.size("points"), F.lower(F.trim(F.coalesce("shape", F.lit("polygon"))))
    two = shape.isin("stroke", "rectangle", "circle")
    spans = _polygons(some.where(~two & (n >= 3)), keys, height, width)
    for name, f in (("stroke", _strokes), ("rectangle", _boxes), ("circle", _circles)):
        part = f(some.where((shape == name) & (n >= 2)), keys)
        spans = spans.unionByName(part)
    spans = spans.select(*keys, F.col("row").cast("int").alias("row"), F.greatest(F.col("lo"), F.lit(0)).cast("int").alias("lo"), F.least(F.col("hi"), F.lit(width - 1)).cast("int").alias("hi")).where(f"lo <= hi AND row BETWEEN 0 AND {height - 1}").distinct()
    line = W.partitionBy(*keys, "row").orderBy("lo", "hi")
    reached = F.max("hi").over(line.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.withColumn("lo", F.greatest("lo", F.coalesce(reached + 1, F.col("lo")))).where("lo <= hi")
    return fresh.select(*keys, "row", F.explode(F.sequence("lo", "hi")).alias("col"))


def apply_annotation_ops(cells: DataFrame, ops: DataFrame, height: int, width: int, key: str = KEY) -> DataFrame:
    """cells (caution, blocked) with the caution mask after the ordered add/erase operations, and y_class.

    Only the last operation over a cell matters, so it is a maximum by key; blocked cells stay clear.
    """
    last = rasterize(ops, height, width, key).groupBy(key, "row", "col").agg(F.max_by("mode", "op_idx").alias("mode"))
    out = cells.join(last, [key, "row", "col"], "left")
    caution = F.when(F.col("blocked") > 0, 0).when(F.col("mode") == "add", 1).when(F.col("mode") == "erase", 0).otherwise(F.col("caution"))
    out = out.withColumn("caution", caution).drop("mode")
    return out.withColumn("y_class", F.when(F.col("blocked") > 0, 2).when(F.col("caution") > 0, 1).otherwise(0))


def import_label_shapes(mapping: DataFrame, shapes: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Cells of each timestamp's shapes by way of the file mapping (file, timestamp), and one row of converted and missing counts."""
    known = shapes.join(mapping, "file")
    ops = known.select("timestamp", F.xxhash64("file", "shape", F.to_json(F.struct("points"))).alias("op_idx"), F.lit("add").alias("mode"), "shape", "radius", "points")
    cells = rasterize(ops, height, width, "timestamp").select("timestamp", "row", "col").distinct()
    counts = mapping.join(shapes.select("file").distinct().withColumn("x", F.lit(1)), "file", "left").agg(F.count("x").alias("converted"), (F.count(F.lit(1)) - F.count("x")).alias("missing"))
    return cells, counts
