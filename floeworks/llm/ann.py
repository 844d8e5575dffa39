"""Approximate nearest neighbours by learned partitions.

A bounded sample is joined into a graph of nearest neighbours; the graph is cut into parts of equal size
(recursive bisection along the second eigenvector, then swaps that lower the cut); a small classifier learns
to predict from a vector how its neighbours are spread over the parts. Every vector of the table goes to the
part the classifier finds likeliest, every query to as many of its likeliest parts as together hold `mass` of its
neighbours by the classifier's own estimate (two at least), and candidates there are ranked by their exact cosine in
double precision. So a query inside a clear cluster probes few parts, one between clusters many.

There is a part for every ROWS_PER_PART vectors, PARTS[0] at least; a model tells at most PARTS[1] of them apart. A part
that then holds more than `most` vectors is divided again in the same way by a model of its own, which a task fits on
about PART_SAMPLE of the part's vectors, and so on (LEVELS times, which are more parts than any table needs), so parts stay
small however long the table. A query is routed level by level, with a share of `mass` for each that leaves `mass` in all.
Equal vectors are one vector
with its smallest ids, as many as a result can hold, so a vector that fills a third of the table is one row. A part is
searched in blocks of BLOCK vectors, which a task holds while the part's queries pass by, so a part that no model can
divide is many tasks; a vector moves once for each level (once more for every QUERIES queries of its part), a query once for
each block of its parts. Only the sample (at most `sample` vectors) and the first model reach the driver; models of
parts travel with the rows of their parts.

Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components
take no part; nor do rows without id. Vectors are scaled by powers of two before squaring, so huge and tiny ones
have a cosine too. Ties go to the smaller id. Rows of one id are one query and one candidate, with the largest cosine
of any of them. A table
without usable vectors or queries gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import runs, written

SAMPLE, PARTS, ROWS_PER_PART, MASS = 4096, (16, 256), 800, 0.95
#: Vectors that a task holds, and queries that pass by in one task.
BLOCK, QUERIES = 8192, 1 << 18
#: Vectors of a part from which its own model is fitted, vectors beyond which a part is divided, and levels of models.
PART_SAMPLE, MOST, LEVELS = 2048, 8 * ROWS_PER_PART, 5
#: Parts up to which their sizes are broadcast.
SMALL = 100_000


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x times the power of two that brings their largest component to 0.5..1: exact, and squares can't overflow or vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """For each row of unit vectors, the indices of its k nearest others."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """A part for each node of the graph; sizes differ by at most one at each bisection."""
    n = len(near)
    a = np.zeros((n, n), np.float32)
    a[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    a = np.maximum(a, a.T)
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)

    def bisect(nodes: np.ndarray, first: int, count: int) -> None:
        if count < 2 or len(nodes) < 2:
            part[nodes] = first
            return
        b = a[np.ix_(nodes, nodes)]
        degree = b.sum(axis=1) + 1e-3
        root = 1 / np.sqrt(degree)
        top = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
        v = rng.standard_normal(len(nodes)).astype(np.float32)
        for _ in range(60):  # power iteration on the normalised graph, away from its first eigenvector
            v = v - top * (top @ v)
            v = v + root * (b @ (root * v))
            v /= np.linalg.norm(v) + 1e-30
        left_parts = count // 2
        size = len(nodes) * left_parts // count
        side = np.zeros(len(nodes), bool)
        side[np.argsort(v * root, kind="stable")[:size]] = True
        for _ in range(50):  # swap the pairs that gain most while the cut falls
            gain = b @ side.astype(np.float32) - b @ (~side).astype(np.float32)
            out = np.flatnonzero(side)[np.argsort(gain[side], kind="stable")]
            into = np.flatnonzero(~side)[np.argsort(-gain[~side], kind="stable")]
            m = min(len(out), len(into), max(1, len(nodes) // 50))
            m = int(((gain[into[:m]] - gain[out[:m]]) > 2).sum())
            if not m:
                break
            side[out[:m]], side[into[:m]] = False, True
        bisect(nodes[side], first, left_parts)
        bisect(nodes[~side], first + left_parts, count - left_parts)

    bisect(np.arange(n), 0, parts)
    return part


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray):
        self.w = (w1, b1, w2, b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def fit_router(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, rounds: int = 40, seed: int = 0) -> Router:
    """Trained with Adam on the parts of each vector and its neighbours."""
    rng = np.random.default_rng(seed)
    goal = np.zeros((len(x), parts), np.float32)
    np.add.at(goal, (np.arange(len(x)), part), 1.0)
    for j in range(near.shape[1]):
        np.add.at(goal, (np.arange(len(x)), part[near[:, j]]), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    x = x.astype(np.float32)
    w = [rng.standard_normal((x.shape[1], hidden)).astype(np.float32) * np.sqrt(2.0), np.zeros(hidden, np.float32), rng.standard_normal((hidden, parts)).astype(np.float32) * np.sqrt(2 / hidden), np.zeros(parts, np.float32)]
    w = [v.astype(np.float32) for v in w]
    m, s, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            b = order[i : i + 128]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - goal[b]) / len(b)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[b].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] -= (0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Router(*w)


def likeliest(logits: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and part of the likeliest parts of each row: those before which less than `mass` has been reached, and the first two."""
    p = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(logits) else logits
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_ = np.take_along_axis(p, order, 1)
    before = np.cumsum(sorted_, axis=1) - sorted_
    row, place = np.nonzero((before < mass * p.sum(axis=1, keepdims=True)) | (np.arange(p.shape[1]) < 2))
    return row, order[row, place]


def usable(column: str, width: int | None = None) -> Column:
    c = F.col(column)
    ok = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(c, lambda v: v != 0)
    return ok if width is None else ok & (F.size(c) == width)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def learned(vectors: DataFrame, parts: int, sample: int = SAMPLE, seed: int = 0) -> Router | None:
    """The router fitted on the first `sample` vectors (id, v) by hash of id."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").collect()
    if len(rows) < 2:
        return None
    return fitted(np.array([r["v"] for r in rows], float), parts, seed)


def fitted(vectors: np.ndarray, parts: int, seed: int = 0) -> Router:
    """The router of a sample: its graph of neighbours, cut into parts (one for every eight vectors at most)."""
    x = unit(vectors)
    near = neighbour_graph(x)
    parts = max(1, min(parts, len(x) // 8))
    return fit_router(x, near, balanced_parts(near, parts, seed), parts, seed=seed)


def divided(index: DataFrame, asked: DataFrame, counts: DataFrame, mass: float, most: int, rows_per_part: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """index (part, v, ids) and asked (part, id, v) with the parts of more than `most` vectors divided, and the sizes of the new parts.

    counts has part and n. A new part's number is (part + 1) * PARTS[1] plus its place in the old one, which no other part has.
    """
    top = PARTS[1]
    big = written(counts.where(F.col("n") > most).withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")))
    small = big.limit(SMALL + 1).count() <= SMALL
    large = F.broadcast(big) if small else big
    inside = index.join(large, "part")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        router = fitted(np.stack(pdf["v"].to_numpy()).astype(float), min(top, max(2, int(pdf["n"].iloc[0]) // rows_per_part)), seed)
        return pdf[["part", "nb"]].head(1).assign(model=pickle.dumps(router.w))

    models = inside.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.col("n")) < PART_SAMPLE).select("part", "n", "nb", "v")
    models = models.groupBy("part").applyInPandas(fit, "part long, nb int, model binary")
    columns = {"kind": "int", "id": "long", "v": "array<double>", "ids": "array<long>", "model": "binary"}

    def row(df: DataFrame, kind: int, block: Column) -> DataFrame:
        own = [F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        return df.select("part", block.alias("b"), *own)

    both = row(models, 0, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    both = both.unionByName(row(inside, 1, F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))).unionByName(row(asked.join(large, "part"), 2, F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's model comes first and is held; its vectors and queries pass by."""
        router: Router | None = None
        for t in runs(batches, ("part", "b", "kind")):
            kind = t.column("kind")[0].as_py()
            if kind == 0:
                router = Router(*pickle.loads(t.column("model")[0].as_py()))
                continue
            z = router.logits(unit(matrix(t.column("v"))).astype(np.float32))
            at, place = (np.arange(t.num_rows), np.argmax(z, axis=1)) if kind == 1 else likeliest(z, mass)
            rows = t.select(["kind", "id", "v", "ids"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array((t.column("part")[0].as_py() + 1) * top + place.astype(np.int64)), *rows.columns], ["part", *rows.schema.names])

    new = written(both.repartition("part", "b").sortWithinPartitions("part", "b", "kind").mapInArrow(send, "part long, kind int, id long, v array<double>, ids array<long>"))
    index = index.join(large, "part", "left_anti").select("part", "v", "ids").unionByName(new.where("kind = 1").select("part", "v", "ids"))
    asked = asked.join(large, "part", "left_anti").select("part", "id", "v").unionByName(new.where("kind = 2").select("part", "id", "v"))
    return index, asked, new.where("kind = 1").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _pool(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """id, v -> v and its smallest ids within the partition so far: a map-side combine."""
    seen: dict[bytes, list[int]] = {}
    kinds: dict[bytes, list[float]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"v": pa.array(list(kinds.values()), pa.list_(pa.float64())), "ids": pa.array(list(seen.values()), pa.list_(pa.int64()))})
        seen.clear()
        kinds.clear()
        return out

    for b in batches:
        x = matrix(b.column(1)) + 0.0  # -0.0 becomes 0.0
        for i, row in zip(b.column(0).to_pylist(), x, strict=True):
            key = row.tobytes()
            if key not in seen:
                seen[key], kinds[key] = [], row
            seen[key] = sorted({*seen[key], i})[:most]
        if len(seen) > 20_000:
            yield flush()
    if seen:
        yield flush()


def neighbours(table: DataFrame, is_query: Column, k: int = 5, mass: float = MASS, rows_per_part: int = ROWS_PER_PART, most: int = MOST, sample: int = SAMPLE, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row, without itself."""
    spark = table.sparkSession
    sizes = table.where(usable(vector)).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = table.where(usable(vector, sizes[0]["n"])).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where("id IS NOT NULL")
    router = learned(rows.select("id", "v"), max(PARTS[0], min(PARTS[1], sizes[0]["count"] // rows_per_part)), sample)
    if router is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(router)
    least = k + 1  # one may be the query itself
    pooled = rows.select("id", "v").mapInArrow(lambda b: _pool(b, least), "v array<double>, ids array<long>")
    pooled = pooled.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, least).alias("ids"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            z = shared.value.logits(unit(x).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(z, axis=1).astype(np.int64)), b.column(0), b.column(1)], ["part", "v", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = shared.value.logits(unit(matrix(b.column(1))).astype(np.float32))
            at, part = likeliest(z, first)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["part", "id", "v"])

    index = written(pooled.mapInArrow(assign, "part long, v array<double>, ids array<long>"))
    counts = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    many = not counts.where(F.col("n") > most).isEmpty()
    first = mass**0.5 if many else mass
    asked = written(rows.where("q").select("id", "v").mapInArrow(route, "part long, id long, v array<double>"))
    for level in range(2, LEVELS + 1):
        if not many:
            break
        index, asked, counts = divided(index, asked, counts, mass ** (0.5**level), most, rows_per_part)
        many = not counts.where(F.col("n") > most).isEmpty()
    blocks = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nv"))
    blocks = blocks.join(asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("nq")), "part")
    blocks = written(blocks)
    blocks = F.broadcast(blocks) if blocks.limit(SMALL + 1).count() <= SMALL else blocks  # a row for each part
    # a vector is copied for each block of QUERIES queries of its part, which is one as a rule; a query goes to the blocks of its parts
    vs = index.join(blocks, "part").withColumn("bv", F.pmod(F.xxhash64("v"), F.col("nv")).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    qs = asked.join(blocks, "part").withColumn("bq", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int")).withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    both = vs.select("part", "bv", "bq", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("id"), "v", "ids").unionByName(qs.select("part", "bv", "bq", F.lit(1).alias("asks"), "id", "v", F.lit(None).cast("array<long>").alias("ids")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's vectors come first and are held; its queries pass by."""
        block: Block | None = None
        now, held = None, []
        for t in runs(batches, ("part", "bv", "bq", "asks")):
            key = tuple(t.column(c)[0].as_py() for c in ("part", "bv", "bq"))
            if key != now:
                now, held, block = key, [], None
            if not t.column("asks")[0].as_py():
                held.append(t)
                continue
            if block is None and held:
                block, held = Block(held), []
            for i in range(0, t.num_rows if block else 0, 256):
                yield block.nearest(t.slice(i, 256), k)

    found = both.repartition("part", "bv", "bq").sortWithinPartitions("part", "bv", "bq", "asks").mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # once, whatever rows an id has
    ranked = found.selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, the same for equal pairs wherever they are computed."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


class Block:
    """Vectors of a part with their ids, held for the queries that pass by."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.v = np.concatenate([matrix(b.column("v")) for b in batches])
        self.units = unit(self.v).T.copy()
        self.ids = [x for b in batches for x in b.column("ids").to_pylist()]

    def nearest(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """query_id, vec_id, score of the k nearest of each query, ties at the edge looked at exactly."""
        q, asked = matrix(queries.column("v")), queries.column("id").to_pylist()
        s = unit(q) @ self.units
        out: tuple[list, list, list] = ([], [], [])
        m = min(len(self.v), 2 * k + 8)
        edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
        for i, own in enumerate(asked):
            at = np.flatnonzero(s[i] >= edge[i] - 1e-12)
            exact = cosine(q[i][None, :], self.v[at])
            some = sorted((-e, x) for e, j in zip(exact.tolist(), at.tolist(), strict=True) for x in self.ids[j] if x != own)[:k]
            out[0].extend([own] * len(some))
            out[1].extend(x for _, x in some)
            out[2].extend(-e for e, _ in some)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})
