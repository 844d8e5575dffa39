"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

A text's set is its distinct shingles of `width` words (A-Z lower-cased; fewer words: the whole sequence;
no words: the empty set, linked with nothing). Two sets are linked if their Jaccard similarity is at least
`percent` / 100, and a class is what links reach.

1. Each row gets, in one pass over its text, its set's size and 128-bit key, and a sketch of 256
   coordinates. Rounds hash every shingle into one bin with a value that grows with the round; a bin keeps
   its least value; rounds go on until every bin is full. After 256 rounds, round 256 + i fills bin i from
   all shingles, so every coordinate fills. Two sketches agree in a coordinate with a probability equal to
   the similarity, and the share of agreeing coordinates is concentrated around it.
2. Equal sets are one node: copies add no pairs. Nodes share a bucket if 4 neighbouring coordinates agree;
   32 buckets each (at 0.8 the chance to miss is 5e-8).
3. Buckets of at most CROWD nodes give all their pairs, at most CROWD / 2 a node. Sizes and sketches sort out
   pairs (agreement of at least `percent` - MARGIN points; at 0.8 the chance to miss is 4e-10), the rest is
   compared on full sets.
4. Larger buckets are worked through whole, with their full sets in place, so no pair becomes a row of a
   table: a few leaders join most of a bucket, then every node is compared with the nodes that are not yet
   known to be in its class. A bucket beyond LIMIT bytes is cut into blocks: nodes outside its largest
   known class meet all blocks, those inside only the blocks of the outsiders. Where buckets hold more than
   PAIRS pairs a node, up to ROUNDS rounds of one leader a bucket first find such classes in Spark. A pair
   that shares several buckets is compared in the least of them only, so none is lost and none comes twice.
5. Links are joined to components, and a component's id is the smallest doc_id of its rows.

Null and empty texts have the empty set and are classes of their own. A very long text is one row with one
set. Equal sets (ties) go to the smallest doc_id. Repeated rows and rows that share a doc_id are judged each
by its own text. A null doc_id links like any other but never names a class that has another id. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import groups, release, written
from .textbytes import LOWER, buffers, mix, pieces, prefix_hash, shingle_hashes, shingle_set, span_hash, words

BINS, BANDS, ROWS, MARGIN = 256, 32, 4, 16
CROWD, LIMIT, PAIRS, ROUNDS, LEADERS = 16, 32 << 20, 1000, 4, 3
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64((1 << 55) - 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The sketch of a set of distinct 64-bit hashes; all coordinates are filled if the set isn't empty."""
    s = np.full(bins, _EMPTY)
    if not len(elements):
        return s
    shift = np.uint64(64 - (bins - 1).bit_length())
    done = 0
    while done < bins and (s == _EMPTY).any():
        rounds = np.arange(done, min(bins, done + max(1, 1024 // len(elements))))
        u = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        np.minimum.at(s, (u >> shift).astype(np.int64).ravel(), ((u & _LOW) | (rounds.astype(np.uint64) << np.uint64(55))[:, None]).ravel())
        done = int(rounds[-1]) + 1
    for b in np.flatnonzero(s == _EMPTY):
        s[b] = (mix(elements ^ _SEEDS[bins + b]) & _LOW).min() | np.uint64((bins + int(b)) << 55)
    return s


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text_id, text -> doc_id, text_id, n_shingles, node, bands and marks of each row; node is null for the empty set."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for i, j, b, o in pieces(data, offsets, 4 << 20):
            b = LOWER[b]
            starts, ends, before = words(b, o)
            hashes = span_hash(prefix_hash(b), starts, ends)
            n, keys, all_s = np.zeros(j - i, np.int64), np.zeros((j - i, 2), np.uint64), np.full((j - i, BINS), _EMPTY)
            for k in range(j - i):
                e = np.unique(shingle_hashes(hashes[before[k] : before[k + 1]], width))
                n[k] = len(e)
                if len(e):
                    keys[k] = mix(e).sum(dtype=np.uint64), mix(e ^ _SEEDS[0]).sum(dtype=np.uint64)
                    all_s[k] = sketch(e)
            bands = np.broadcast_to(salt, (j - i, BANDS)).copy()
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + all_s[:, r : ROWS * BANDS : ROWS])
            marks = (mix(all_s) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(i, j - i) for c in (0, 1)),
                    pa.array(n),
                    pa.array([key.tobytes() if size else None for key, size in zip(keys, n.tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel())),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ],
                ["doc_id", "text_id", "n_shingles", "node", "bands", "marks"],
            )


def _texts(docs: DataFrame, column: str) -> DataFrame:
    """doc_id, text_id (a hash of the text) and text."""
    return docs.select("doc_id", F.xxhash64(column).alias("text_id"), F.col(column).alias("text"))


def sketched(docs: DataFrame, width: int, column: str = "text") -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_id long, n_shingles long, node binary, bands array<long>, marks binary"
    return _texts(docs, column).mapInArrow(lambda batches: _sketches(batches, width), schema)


def _alike(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, text_a, text_b -> the pairs a, b whose full sets are alike."""
    last: tuple[object, np.ndarray] = (None, np.zeros(0))
    for batch in batches:
        b, ta, tb = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        keep = np.zeros(len(b), bool)
        for k in range(len(b)):
            x = shingle_set((ta[k].as_py() or "").encode(), width)
            if last[0] != b[k]:
                last = (b[k], shingle_set((tb[k].as_py() or "").encode(), width))
            common = len(np.intersect1d(x, last[1], assume_unique=True))
            keep[k] = common > 0 and 100 * common >= percent * (len(x) + len(last[1]) - common)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _least(percent: int) -> int:
    """The coordinates in which the sketches of a link agree at least."""
    return int(BINS * (percent - MARGIN) / 100)


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, sizes and marks of both -> the pairs that sizes and sketches allow to be alike."""
    for batch in batches:
        m1, m2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (3, 5))
        n1, n2 = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        mask = pa.array(((m1 == m2).sum(axis=1) >= _least(percent)) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of nodes that are alike on the full sets of their texts."""
    side = lambda c: marks.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("marks").alias(f"m_{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "m_a", "n_b", "m_b")
    maybe = written(both.mapInArrow(lambda x: _plausible(x, percent), "a binary, b binary"))
    text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = maybe.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(lambda x: _alike(x, width, percent), "a binary, b binary"))


def _elements(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """node, n_shingles, bands, marks, text -> the same with the full set (8 bytes a shingle, in order) in place of the text."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [shingle_set((t or "").encode(), width).tobytes() for t in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(sets, pa.binary())], ["node", "n_shingles", "bands", "marks", "elements"])


class _Bucket:
    """The nodes of a bucket, or of two of its blocks, with their full sets and the classes known so far."""

    def __init__(self, t: pa.RecordBatch, percent: int):
        self.percent, self.bucket = percent, t.column("bucket")[0].as_py()
        self.n = t.column("n_shingles").to_numpy().astype(np.int64)
        self.marks = buffers(t.column("marks"))[0].reshape(-1, BINS)
        self.bands = t.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        data, ends = buffers(t.column("elements"))
        self.set_of = lambda i: data[ends[i] : ends[i + 1]].view(np.uint64)
        self.known = t.column("component").dictionary_encode().indices.to_numpy().astype(np.int64)
        self.left, self.right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        self.links: list[tuple[int, int]] = []

    def compare(self, i: int, others: np.ndarray) -> None:
        """Link i with the first node alike of each other class; classes that are linked become one."""
        low, high = np.minimum(self.n[others], self.n[i]), np.maximum(self.n[others], self.n[i])
        others = others[100 * low >= self.percent * high]
        others = others[np.count_nonzero(self.marks[others] == self.marks[i], axis=1) >= _least(self.percent)]
        if not len(others):
            return
        mine = self.set_of(i)
        theirs = np.concatenate([self.set_of(j) for j in others])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        first = np.cumsum(self.n[others]) - self.n[others]
        common = np.add.reduceat(hit.astype(np.int64), first)
        alike = others[100 * common >= self.percent * (self.n[i] + self.n[others] - common)]
        if len(alike):
            classes, at = np.unique(self.known[alike], return_index=True)
            self.links += [(i, int(j)) for j in alike[at]]
            self.known[np.isin(self.known, classes)] = self.known[i]

    def run(self) -> list[tuple[int, int]]:
        led: set[int] = set()
        for _ in range(LEADERS):  # a node of the largest class that has not led meets all others
            size = np.bincount(self.known)
            size[[k for k in led if k < len(size)]] = 0
            k = int(np.argmax(size))
            if not size[k]:
                break
            self.compare(int(np.argmax(self.known == k)), np.flatnonzero(self.known != k))
            led.add(k)
        order = np.arange(len(self.n))
        most = np.iinfo(np.int64).max
        for i in np.flatnonzero(self.left):
            twice = self.left & (order < i) if self.right[i] else np.zeros(len(order), bool)  # those have met i before
            others = np.flatnonzero(self.right & (self.known != self.known[i]) & ~twice)
            if len(others):
                shared = np.where(self.bands[others] == self.bands[i], self.bands[others], most).min(axis=1)
                self.compare(int(i), others[shared == self.bucket])
        return self.links


def _crowded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, x, y -> links a, b."""
    for t in groups(batches, ("bucket", "x", "y")):
        found = _Bucket(t, percent).run()
        if found:
            node = t.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array([p[k] for p in found], pa.int64())) for k in (0, 1)], ["a", "b"])


def _known(member: DataFrame, links: DataFrame | None) -> DataFrame:
    """member (bucket, node, n_shingles) with the component that links have found so far."""
    if links is None:
        return member.withColumn("component", F.col("node"))
    return written(member.join(components(links), "node", "left").select("bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")))


def crowded_links(member: DataFrame, marks: DataFrame, texts: DataFrame, links: DataFrame | None, width: int, percent: int) -> list[DataFrame]:
    """Tables of links among the nodes of large buckets (bucket, node), beside those known already."""
    member = written(member.join(marks.select("node", "n_shingles"), "node"))
    found: list[DataFrame] = []
    known, before = _known(member, None), None
    for turn in range(ROUNDS + 1):
        sizes = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") * 8 + 4 * BINS).alias("weight"))
        sizes = written(sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.sum("weight").alias("weight"), F.max(F.struct("n", "weight", "component")).alias("main"), F.count(F.lit(1)).alias("several")).where("several > 1"))
        total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") - F.col("own")).alias("pairs"), F.sum("n").alias("n")).first()
        if turn == ROUNDS or (total["pairs"] or 0) <= PAIRS * (total["n"] or 0) or before is not None and total["pairs"] > before / 2:
            break
        before = total["pairs"]
        place = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")
        lead = known.groupBy("bucket").agg(F.min(F.struct(place.alias("place"), "node", "component")).alias("lead")).selectExpr("bucket", "lead.node AS lead", "lead.component AS lead_component")
        stars = known.join(lead, "bucket").where("component <> lead_component").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b"))
        found.append(verified(stars, marks, texts, width, percent))
        known = _known(member, _union([links, *found]))
        release(member.sparkSession)
    if not total["n"]:
        return found
    plan = sizes.select("bucket", F.col("main.component").alias("main"), F.ceil(F.col("weight") / LIMIT).cast("int").alias("right_blocks"), F.ceil((F.col("weight") - F.col("main.weight")) / LIMIT).cast("int").alias("left_blocks"))
    rows = known.join(plan, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    rows = rows.withColumn("r", F.pmod(F.xxhash64("node"), F.col("right_blocks")).cast("int")).withColumn("l", F.pmod(F.xxhash64("node"), F.col("left_blocks")).cast("int"))
    meets = "transform(sequence(0, left_blocks - 1), x -> named_struct('x', x, 'y', r))"
    leads = "CASE WHEN outside THEN transform(sequence(0, right_blocks - 1), y -> named_struct('x', l, 'y', y)) ELSE array() END"
    rows = rows.withColumn("task", F.explode(F.expr(f"array_union({meets}, {leads})"))).selectExpr("bucket", "task.x", "task.y", "node", "component", "outside AND l = task.x AS left", "r = task.y AS right")
    full = marks.join(known.join(sizes.select("bucket"), "bucket", "left_semi").select("node").distinct(), "node", "left_semi").join(texts, "node").select("node", "n_shingles", "bands", "marks", "text")
    full = written(full.mapInArrow(lambda b: _elements(b, width), "node binary, n_shingles long, bands array<long>, marks binary, elements binary"))
    ready = rows.join(full, "node").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return [*found, written(ready.mapInArrow(lambda b: _crowded(b, percent), "a binary, b binary"))]


def _union(tables: list[DataFrame | None]) -> DataFrame:
    first, *rest = (t for t in tables if t is not None)
    for t in rest:
        first = first.unionByName(t)
    return first


def _classes(docs: DataFrame, width: int, percent: int, column: str) -> DataFrame:
    """doc_id, text_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    sk = written(sketched(docs, width, column))
    # bands and marks are functions of the node, so any row's will do
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id"))
    nodes = written(sk.where("node IS NOT NULL").groupBy("node").agg(first.alias("row"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "marks"))))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = written(buckets.join(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket").select("bucket", "node", "n"))
    release(spark)
    marks = written(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
    rows = marks.selectExpr("node", "row.doc_id AS __id", "row.text_id AS __text_id").hint("merge")
    all_texts = _texts(docs, column)
    texts = all_texts.join(rows, all_texts["doc_id"].eqNullSafe(rows["__id"]) & (all_texts["text_id"] == rows["__text_id"])).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]))
    release(spark)
    few, many = shared.where(F.col("n") <= CROWD), shared.where(F.col("n") > CROWD)
    pairs = few.select("bucket", F.col("node").alias("a")).join(few.select("bucket", F.col("node").alias("b")), "bucket").where("a > b")
    links = [verified(pairs, marks, texts, width, percent)]
    if not many.isEmpty():
        links += crowded_links(many.select("bucket", "node"), marks, texts, links[0], width, percent)
    release(spark)
    ids = nodes.select("node", "row.doc_id")
    comp = written(components(_union(links)).join(ids, "node"))
    names = comp.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(comp.join(names, "component").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sk.select("doc_id", "text_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "text_id", "n_shingles", F.expr("CASE WHEN node IS NULL THEN doc_id ELSE component_id END").alias("component_id"))


def classes(docs: DataFrame, width: int = 5, percent: int = 80, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id) of every row."""
    return _classes(docs, width, percent, column).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, column: str = "text") -> DataFrame:
    """The rows of docs whose document is the smallest of its class; the columns of docs."""
    out = _classes(docs, width, percent, column)
    keep = out.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).selectExpr("doc_id AS __id", "text_id AS __text_id").distinct().hint("merge")
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]) & (F.xxhash64(docs[column]) == keep["__text_id"]), "left_semi").select(*docs.columns)
