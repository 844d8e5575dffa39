"""Mixing sources to target weights by min-cost flow.

Sources overlap where rows of different sources hold the same text. Texts are summed by membership pattern (the set
of sources that hold them); token capacity flows from patterns to the quotas of their sources. A pattern gives the
tokens of its different texts once at cost 1, a second time at cost 2, a third time at cost 4, and again at cost 8
as far as its rows go (each row three times); the costs are convex, so text that the mix has not seen goes first,
whichever source asks for it. A source takes at most three times its own rows of a pattern. Capacity is opened by
rising cost and each time filled up by a maximal flow, which gives a cheapest flow because sets of supplies that
quotas can take are a polymatroid. The flow is solved on the driver, over patterns and sources only: sources are a
dimension (at most SOURCES, else an error). Of patterns beyond the PATTERNS largest no list is kept: each of their texts is given
by one of its sources, drawn by hash, like that source's own; in the others its rows are one late pattern, which costs from the
start what a second time costs. So fresh text goes first there too, and quotas are met just the same.

Each source then takes whole passes over its rows of a pattern; one pattern of a source, its own texts where that is
possible, also gives a part of a pass: rows in the order of a seeded hash of doc_id up to the rest of its tokens, and
then, from the largest down, rows that fit into what is still missing, so a source ends within its smallest row left. That part is found by summing 4096 slices of the
hash and ordering only the slice in which it ends, so no source is ordered whole. Reruns agree.

Null texts have size 0 and take no words; very long texts count like others. A null source is a source of its own,
after the others. Repeated rows are documents of their own (equal rows are chosen together), as are rows without
doc_id. Of documents equally near to what is missing the first by hash and doc_id is taken. An empty table gives no
rows. Other columns are not read by mixed() and are kept by resample(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
REPEAT_COSTS = (1, 2, 4, 8)
MOST = 3
SLICES = 4096
FILLERS = 1024
LATE = -1
SOURCES, PATTERNS, SMALL = 100_000, 20_000, 100_000


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; none above most times its size, the excess shared again by weight."""
    left, free = Fraction(sum(sizes)), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > most * sizes[i] * w]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return [float(x) for x in out]


class Flow:
    """Maximal flows by levels (breadth first) and blocking flows; capacities may be raised between calls."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def edge(self, a: int, b: int, capacity: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        return len(self.to) - 2

    def levels(self, root: int) -> list[int]:
        level = [-1] * len(self.out)
        level[root] = 0
        queue = [root]
        for a in queue:
            for k in self.out[a]:
                if self.left[k] and level[self.to[k]] < 0:
                    level[self.to[k]] = level[a] + 1
                    queue.append(self.to[k])
        return level

    def fill(self, root: int, sink: int) -> None:
        while (level := self.levels(root))[sink] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            node = root
            while True:
                if node == sink:
                    amount = min(self.left[k] for k in path)
                    for k in path:
                        self.left[k] -= amount
                        self.left[k ^ 1] += amount
                    path, node = [], root
                    continue
                while at[node] < len(self.out[node]):
                    k = self.out[node][at[node]]
                    if self.left[k] and level[self.to[k]] == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(self.out[node]):
                    path.append(k)
                    node = self.to[k]
                elif path:
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break


def route(units: Sequence[int], cells: Sequence[dict[int, int]], quotas: Sequence[int], costs: Sequence[int] = REPEAT_COSTS, late: range = range(0)) -> list[dict[int, int]]:
    """Tokens from each pattern to each of its sources: a cheapest flow among the largest ones.

    units are the tokens of a pattern's different texts, cells the most that each of its sources may take. The patterns
    in late hold texts that another pattern gives first: theirs cost as much as a second time.
    """
    p, s = len(units), len(quotas)
    root, sink = p + s, p + s + 1
    flow = Flow(p + s + 2)
    supply = [flow.edge(root, i, 0) for i in range(p)]
    to = [{j: flow.edge(i, p + j, most) for j, most in cells[i].items()} for i in range(p)]
    for j, q in enumerate(quotas):
        flow.edge(p + j, sink, q)
    given = [0] * p
    for turn, _ in enumerate(sorted(costs)):
        for i in range(p):
            rest = sum(cells[i].values()) - given[i]
            more = rest if turn == len(costs) - 1 else 0 if turn == 0 and i in late else min(units[i], rest)
            flow.left[supply[i]] += more
            given[i] += more
        flow.fill(root, sink)
    return [{j: flow.left[k ^ 1] for j, k in row.items()} for row in to]


def rounded(flow: Sequence[dict[int, int]], sizes: Sequence[dict[int, int]], own: int) -> list[dict[int, int]]:
    """The flow with whole passes over the rows that the patterns from own on have in a source, wherever the source's own texts (its pattern before own) make up for it."""
    out = [dict(row) for row in flow]
    for i, row in enumerate(sizes):
        for j, size in row.items() if i >= own else ():
            if not size:
                continue
            whole = min(MOST, (2 * out[i][j] + size) // (2 * size)) * size
            rest = out[j][j] + out[i][j] - whole
            if 0 <= rest <= MOST * sizes[j][j]:
                out[i][j], out[j][j] = whole, rest
    return out


def _hash(seed: int) -> Column:
    """A seeded number below 2**32 of doc_id, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, source: str = "source", column: str = "text") -> DataFrame:
    """doc_id, source, size and key (a hash of the text) of every row."""
    return docs.select("doc_id", F.col(source).alias("source"), word_count(column).alias("size"), F.xxhash64(column).alias("key"))


def plan(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), seed: int = 0) -> tuple[Decided, DataFrame | None, DataFrame]:
    """What each cell (the rows that a pattern has in a source) takes, the cells of texts held by several sources, and each source's size and target.

    rows is sized(). The first has source, pattern (null: texts that this source gives, LATE: those that another gives first), passes and the bounds of
    a part of a pass, and the rows that fill it up; the second key, size and pattern (None without such texts); the third source, source_size, target.
    """
    spark = rows.sparkSession
    by_text = rows.where("size > 0").groupBy("key", "size", "source").agg(F.count(F.lit(1)).alias("n"))
    texts = written(by_text.groupBy("key", "size").agg(F.collect_set(F.struct("source")).alias("held")).where("size(held) > 1").select("key", "size", F.array_sort("held").alias("held")))  # at most all sources
    held = texts.groupBy("held").agg(F.sum("size").alias("unit"))
    held = [(tuple(x["source"] for x in r["held"]), r["unit"]) for r in held.orderBy(F.desc("unit"), "held").limit(PATTERNS).collect()]
    number = {names: i for i, (names, _) in enumerate(held)}
    shared = None
    if not texts.isEmpty():
        names = F.broadcast(spark.createDataFrame([([(x,) for x in k], i) for k, i in number.items()], "held array<struct<source:string>>, pattern int"))  # PATTERNS rows
        owner = F.get("held", F.pmod(F.xxhash64("key", F.lit(seed)), F.size("held")).cast("int"))
        shared = written(texts.join(names, "held", "left").select("key", "size", "pattern", F.when(F.col("pattern").isNull(), owner).alias("owner")))
    placed = with_pattern(rows, shared)
    sums = placed.groupBy("source", "pattern").agg(F.sum("size").alias("size"))
    found = sums.limit(2 * SOURCES + 10 * PATTERNS + 1).collect()
    by = {(r["source"], r["pattern"]): r["size"] for r in found}
    names = sorted({s for s, _ in by}, key=lambda x: (x is None, x or ""))
    if len(found) > 2 * SOURCES + 10 * PATTERNS or len(names) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    index = {x: i for i, x in enumerate(names)}
    sizes = [by.get((x, None), 0) for x in names]
    for (x, p), size in by.items():
        if p is not None:
            sizes[index[x]] += size
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    late = [x for x in names if (x, LATE) in by]
    labels = [None] * len(names) + [LATE] * len(late) + list(range(len(held)))
    cells = [{index[x]: by.get((x, None), 0)} for x in names] + [{index[x]: by[x, LATE]} for x in late] + [{index[x]: by[x, i] for x in k if (x, i) in by} for k, i in number.items()]
    units = [next(iter(c.values())) for c in cells[: len(names) + len(late)]] + [u for _, u in held]
    flow = route(units, [{j: MOST * n for j, n in c.items()} for c in cells], [round(g) for g in goal], late=range(len(names), len(names) + len(late)))
    flow = rounded(flow, cells, len(names))
    takes = {(names[j], p): (x, cell[j]) for p, row, cell in zip(labels, flow, cells, strict=True) for j, x in row.items()}
    placed = placed.withColumn("h", _hash(seed))
    # what a pattern of several sources can't give exactly is carried to the source's own texts
    lines, extras = {}, []
    several = {k: divmod(x, size) for k, (x, size) in takes.items() if k[1] is not None and size and x % size}
    if several:
        lines, extra, given = _parts(placed, several)
        extras.append(extra)
        for (name, p), (_, rest) in several.items():
            if takes[name, None][1]:
                x, size = takes[name, None]
                takes[name, None] = max(0, min(MOST * size, x + rest - given.get((name, p), 0))), size
    own = {k: divmod(x, size) for k, (x, size) in takes.items() if k[1] is None and size and x % size}
    more, extra, _ = _parts(placed, own)
    lines, extras = lines | more, [*extras, extra]
    kind = rows.schema["doc_id"].dataType.simpleString()
    decided = [(*k, x // size if size else 0, *lines.get(k, (None,) * 4)) for k, (x, size) in takes.items()]
    decided = spark.createDataFrame(decided, f"source string, pattern int, passes long, from_h long, cut_h long, cut_id {kind}, cut_size long")
    return Decided(decided, reduce(DataFrame.unionByName, extras)), shared, spark.createDataFrame(list(zip(names, sizes, goal, strict=True)), "source string, source_size long, target double")


Cell = tuple[str | None, int | None]


def _parts(placed: DataFrame, shares: dict[Cell, tuple[int, int]]) -> tuple[dict[Cell, tuple], DataFrame, dict[Cell, int]]:
    """For cells that take whole passes and a part of one (in words): the bounds of the rows taken in order of h, the rows that fill up, and the words both give."""
    spark, kind, width = placed.sparkSession, placed.schema["doc_id"].dataType.simpleString(), 2**32 // SLICES
    asked = spark.createDataFrame([(*k, r) for k, (_, r) in shares.items()], "t_source string, t_pattern int, rest long")
    parts = placed.join(F.broadcast(asked), _same("t"))  # a row for each cell
    slices = parts.groupBy("source", "pattern", "rest", F.floor(F.col("h") / width).cast("long").alias("slice")).agg(F.sum("size").alias("size"))
    slices = slices.selectExpr("source", "pattern", "rest", "slice", "sum(size) OVER (PARTITION BY source, pattern ORDER BY slice) AS upto", "size")
    ends = slices.where("upto > rest").groupBy("source", "pattern").agg(F.min(F.struct("slice", F.expr("rest - (upto - size) AS inside"))).alias("e"))
    ends = [(r["source"], r["pattern"], r["e"]["slice"] * width, r["e"]["inside"]) for r in ends.collect()]
    bounds = F.broadcast(spark.createDataFrame(ends, "t_source string, t_pattern int, from_h long, inside long"))
    last = placed.join(bounds, _same("t")).where(f"h >= from_h AND h < from_h + {width}")
    last = last.selectExpr("source", "pattern", "inside", "struct(h, doc_id, size) AS place", "sum(size) OVER (PARTITION BY source, pattern ORDER BY h, doc_id, size) AS upto")
    cut = last.where("upto <= inside").groupBy("source", "pattern").agg(F.max("place").alias("cut"), F.max("upto").alias("filled"))
    cut = {(r["source"], r["pattern"]): (r["cut"], r["filled"]) for r in cut.collect()}
    lines = {(x, p): (f, *(tuple(cut[x, p][0]) if (x, p) in cut else (-1, None, None))) for x, p, f, _ in ends}
    missing = {(x, p): i - (cut[x, p][1] if (x, p) in cut else 0) for x, p, _, i in ends}
    bounds = F.broadcast(spark.createDataFrame([(*k, *line, missing[k], MOST - shares[k][0]) for k, line in lines.items()], f"t_source string, t_pattern int, from_h long, cut_h long, cut_id {kind}, cut_size long, missing long, most int"))
    extra = written(_fillers(placed.join(bounds, _same("t")).withColumn("fresh", (~_before()).cast("int"))))
    filled = {(r["source"], r["pattern"]): r["weight"] for r in extra.groupBy("source", "pattern").agg(F.sum("weight").alias("weight")).collect()}
    given = {k: shares[k][1] - missing[k] + filled.get(k, 0) for k in lines}
    return lines, extra.drop("weight"), given


class Decided(NamedTuple):
    """What the mix takes: a row for each cell (passes, and the bounds of a part of a pass), and the rows that fill it up."""

    cells: DataFrame
    extra: DataFrame


def _fillers(rows: DataFrame) -> DataFrame:
    """Rows of cells with missing -> source, pattern, h, doc_id, size, copies and weight (of all copies, equal rows together) of those that fill up what is missing.

    Rows that the part of a pass has not reached (fresh) go first, once each, then any as often as rows may still be taken; both
    from the largest size down, as long as they fit, and at last one more of the smallest if that comes nearer. A cell offers at most FILLERS
    rows of each power of two of sizes, fresh or not, the first by hash.
    """
    rows = rows.where("size > 0").groupBy("source", "pattern", "missing", "most", "fresh", "h", "doc_id", "size").agg(F.sum("size").alias("weight")).where("weight < 2 * missing")
    place = F.row_number().over(Window.partitionBy("source", "pattern", "fresh", F.floor(F.log2("weight"))).orderBy("h", "doc_id", "size"))
    some = rows.withColumn("place", place).where(F.col("place") <= FILLERS)
    schema = rows.select("source", "pattern", "h", "doc_id", "size", F.lit(0).cast("long").alias("copies"), "weight").schema

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "h", "doc_id", "size"], ascending=[False, True, True, True])
        missing, most = int(pdf["missing"].iloc[0]), int(pdf["most"].iloc[0])
        weight, fresh, copies = pdf["weight"].tolist(), pdf["fresh"].tolist(), [0] * len(pdf)
        for turn in (0, 1):
            for i, w in enumerate(weight):
                left = most - (1 - fresh[i]) - copies[i] if turn else fresh[i]
                n = min(left, missing // w)
                copies[i] += n
                missing -= n * w
        near = min((w - missing, i) for i, w in enumerate([*weight, 2 * missing]) if i == len(weight) or copies[i] < most - (1 - fresh[i]))
        if near[0] < missing:
            copies[near[1]] += 1
        out = pdf.assign(copies=copies)
        return out.assign(weight=out["copies"] * out["weight"])[out["copies"] > 0][schema.names]

    return some.groupBy("source", "pattern").applyInPandas(fill, schema)


def _as(side: str) -> list[Column]:
    return [F.col("source").alias(f"{side}_source"), F.col("pattern").alias(f"{side}_pattern")]


def _same(side: str) -> Column:
    return F.col("source").eqNullSafe(F.col(f"{side}_source")) & F.col("pattern").eqNullSafe(F.col(f"{side}_pattern"))


def with_pattern(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """rows (key, size, source and any more) with the pattern of their text, null where this source is the one that gives it."""
    if shared is None:
        return rows.withColumn("pattern", F.lit(None).cast("int"))
    small = shared.limit(SMALL + 1).count() <= SMALL
    other = F.col("owner").isNotNull() & ~F.col("owner.source").eqNullSafe(F.col("source"))
    out = rows.join(F.broadcast(shared) if small else shared, ["key", "size"], "left")
    return out.withColumn("pattern", F.when(other, LATE).otherwise(F.col("pattern"))).drop("owner")


def _before() -> Column:
    return F.expr("h < from_h OR coalesce(struct(h, doc_id, size) <= struct(cut_h, cut_id, cut_size), false)")


def take(rows: DataFrame, decided: Decided, shared: DataFrame | None, seed: int = 0) -> DataFrame:
    """rows (sized() and any more columns) with times: how often the mix takes each one."""
    cells = decided.cells.withColumnsRenamed({"source": "t_source", "pattern": "t_pattern"})
    made = with_pattern(rows, shared).withColumn("h", _hash(seed)).join(F.broadcast(cells), _same("t"), "left")  # a row for each cell
    extra = decided.extra.select(*_as("e"), F.col("h").alias("e_h"), F.col("doc_id").alias("e_id"), F.col("size").alias("e_size"), "copies")
    small = extra.limit(SMALL + 1).count() <= SMALL
    same = (F.col("h") == F.col("e_h")) & (F.col("size") == F.col("e_size")) & F.col("doc_id").eqNullSafe(F.col("e_id")) & _same("e")
    made = made.join(F.broadcast(extra) if small else extra, same, "left")
    more = F.coalesce(_before(), F.lit(False)).cast("long") + F.coalesce("copies", F.lit(0).cast("long"))
    return made.withColumn("times", F.when(F.col("size") > 0, F.col("passes") + more).otherwise(0)).select(*rows.columns, "times")


def mixed(docs: DataFrame, source: str = "source", column: str = "text", weights: Sequence[int] = (5, 2, 1), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, source, size, key, times; and the table of sources. One pass over the texts, kept as a table of sizes."""
    rows = written(sized(docs, source, column))
    decided, shared, sources = plan(rows, weights, seed)
    return take(rows, decided, shared, seed), sources


def resample(docs: DataFrame, source: str = "source", column: str = "text", weights: Sequence[int] = (5, 2, 1), seed: int = 0) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. Texts are moved only where more than SMALL of them are held by several sources."""
    decided, shared, _ = plan(written(sized(docs, source, column)), weights, seed)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), "doc_id", F.col(source).alias("source"), word_count(column).alias("size"), F.xxhash64(column).alias("key"))
    return take(rows, decided, shared, seed).where("times > 0").select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")
