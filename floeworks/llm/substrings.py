"""Exact substring dedup: bytes covered by a `length`-byte string that also starts earlier are removed.

Earlier means a smaller doc_id, or the same document and a smaller start. Matches never cross documents and are
judged on the texts as given. The suffix order of shared text is found in parts of bounded size:

1. Anchors. In every window of `length` bytes the 24-byte string with the least hash is its anchor (the
   leftmost one of equals). Equal windows have equal anchors at the same place, so windows are compared
   only within one anchor string. Consecutive windows with one anchor are a run; the bytes they cover are its
   segment (at most 2 * length - 24 bytes). Anchor strings that occur once are done.
2. Equal segments of one anchor are pre-aggregated: one string, with its first place. So thousands of
   copies are one row.
3. The different segments of an anchor are read as blocks of SYMBOL bytes, laid out from the anchor, joined, and
   their suffixes put in order by linear grouping (suffixes.py). Neighbours in that order that share a
   window's blocks, and the few bytes around them, are equal windows; the one with the smallest place is kept,
   the others are marked. An anchor with one segment needs no order.
4. Anchors with more than BLOCK different segments (a frequent phrase in many surroundings) are not one task: their
   windows are dealt by the anchor's offset in them to RANGES ranges, and in each by the bytes that all windows of the
   range share (over 90 of 100), so different surroundings part; the parts are put in order as in 3. A part that is
   still too large holds one string many times: its windows are compared as whole strings of `length` bytes, by a
   sum over a key that can be split.
5. Marks go back to all places of each segment, are joined to spans per document, and cut out.

Null texts are empty; texts shorter than `length` lose nothing; very long ones are read whole. Rows with one doc_id
and equal texts are one document and get one result each; rows with one doc_id and different texts are documents of
their own, in the order of a hash of their texts. Rows without doc_id come after all others, in that order too. Of
equal strings the one that starts first stays. An empty table gives no rows. Other columns are not read, whatever
their names.

Anchors and equal segments are told by two 64-bit hashes together (128 bits); inside an anchor, bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, discard, release, written
from .suffixes import suffix_array
from .textbytes import _power, buffers, mix, pieces, prefix_hash, span_hash

GRAM, BLOCK, SYMBOL, BATCH, RANGES = 24, 20_000, 8, 1 << 18, 8
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first window (from the row's start), number of windows, anchor (from the first window) and its hash, of each run."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64)
    h = prefix_hash(data)
    m = len(data) - gram + 1
    grams = mix((h[gram:] - h[:m]) * _power("down", m))
    least = _sliding_least((grams & _HIGH) | np.arange(m, dtype=np.uint64), length - gram + 1)
    rooms = np.maximum(0, np.diff(offsets) - length + 1)
    rows = np.flatnonzero(rooms)
    if not len(rows):
        return none, none, none, none, none.view(np.uint64)
    counts = rooms[rows]
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(first - offsets[rows], counts)
    anchor = (least[at] & ~_HIGH).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[first] = True
    where = np.flatnonzero(new)
    row = rows[np.searchsorted(first, where, "right") - 1]
    return row, at[where] - offsets[row], np.diff(np.append(where, len(at))), anchor[where] - at[where], grams[anchor[where]]


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = buffers(b.column(1))
        for i, _, part, o in pieces(data, offsets):
            row, low, n, at, anchor = anchor_runs(part, o, length)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), b.column(0).take(pa.array(row + i)), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(at.astype(np.int16))], ["anchor", "doc_id", "low", "n", "at"])


def _segments(batches: Iterator[pa.RecordBatch], length: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, text, runs -> a row for each run, with its segment's hash, or (for chosen runs) its bytes."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            data, offsets = buffers(part.column(1))
            runs = part.column(2)
            flat = runs.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
            low, n = (flat.field(f).to_numpy().astype(np.int64) for f in ("low", "n"))
            start = offsets[row] + low
            end = start + n - 1 + length
            out = [flat.field("anchor"), part.column(0).take(pa.array(row)), *(flat.field(f) for f in ("low", "n", "at"))]
            names = ["anchor", "doc_id", "low", "n", "at"]
            if with_bytes:
                lengths = end - start
                ends = np.cumsum(lengths)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - lengths), lengths)
                seg = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[at])])
                yield pa.RecordBatch.from_arrays([*out, flat.field("segment"), seg], [*names, "segment", "bytes"])
            else:
                h = span_hash(prefix_hash(data), start, end)
                yield pa.RecordBatch.from_arrays([*out, pa.array(h.view(np.int64))], [*names, "segment"])


def equal_windows(segments: list[bytes], counts: list[int], places: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window's segment, start in it, and the number of its class: windows of `length` equal bytes get one number.

    places are the anchors' offsets: bytes are read as blocks of SYMBOL bytes from there, so equal windows hold equal
    blocks. The suffixes of the block sequences are put in order; neighbours that share a window's whole blocks are one
    class, then the fewer than SYMBOL bytes before and after them decide.
    """
    q = SYMBOL
    rows, lengths = [], []
    for s, at in zip(segments, places, strict=True):
        f = at % q
        blocks = np.frombuffer(s, "<u8", (len(s) - f) // q, f)
        rows += [blocks, np.zeros(1, np.uint64)]
        lengths.append(len(blocks) + 1)
    text = np.concatenate(rows)
    ends = np.cumsum(lengths)
    first = ends - lengths
    symbols = np.unique(text, return_inverse=True)[1] + 1
    symbols[ends - 1] = 0  # a separator is below every block
    order = np.array(suffix_array(symbols.tolist()))
    room = np.repeat(ends - 1, lengths) - np.arange(len(text))
    padded = np.append(symbols, np.zeros(length // q + 1, symbols.dtype))
    classes: dict[int, np.ndarray] = {}

    def ranks(c: int) -> np.ndarray:
        """For each position with c blocks: the number of its class of suffixes that share c blocks."""
        if c not in classes:
            some = order[room[order] >= c]
            new = np.zeros(len(some), bool)
            for k in range(c):
                new[1:] |= padded[some[1:] + k] != padded[some[:-1] + k]
            found = np.full(len(text), -1, np.int64)
            found[some] = np.cumsum(new)
            classes[c] = found
        return classes[c]

    owner = np.repeat(np.arange(len(segments)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    f = (np.array(places) % q)[owner]
    head = (f - start) % q
    c = (length - head) // q
    tail = length - head - c * q
    whole = np.frombuffer(b"".join(segments) + bytes(q), np.uint8)
    base = (np.cumsum([len(s) for s in segments]) - [len(s) for s in segments])[owner] + start
    packed = []
    for at, size in ((base, head), (base + head + c * q, tail)):
        value = np.zeros(len(owner), np.uint64)
        for k in range(q - 1):
            value |= np.where(k < size, whole[np.minimum(at + k, len(whole) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
        packed.append(value)
    position = first[owner] + (start + head - f) // q
    rank = np.zeros(len(owner), np.int64)
    for x in np.unique(c):
        rank[c == x] = ranks(int(x))[position[c == x]]
    return owner, start, _numbers([rank.view(np.uint64), head.astype(np.uint64), *packed])


def _numbers(columns: list[np.ndarray]) -> np.ndarray:
    """Equal numbers for equal rows. Rows are sorted by a hash; where that does not tell rows apart that differ, by all columns."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + c)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    differs = np.zeros(len(order), bool)
    for c in columns:
        differs[1:] |= c[order][1:] != c[order][:-1]
    if (differs & ~new).any():
        order = np.lexsort(columns)
        new = np.ones(len(order), bool)
        new[1:] = False
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _marks(rows: list[tuple], length: int) -> pa.Array:
    """For each row (anchor, segment, doc_id, low, n, at, bytes) of several anchors: spans of windows to mark. first: in the segment's first place too."""
    owner, start, number = equal_windows([r[6] for r in rows], [r[4] for r in rows], [r[5] for r in rows], length)
    doc = np.unique(np.array([r[2] for r in rows]), return_inverse=True)[1]
    order = np.lexsort((start + np.array([r[3] for r in rows])[owner], doc[owner], number))
    leads = np.ones(len(order), bool)
    leads[1:] = number[order][1:] != number[order][:-1]
    everywhere = np.ones(len(order), bool)
    everywhere[order[leads]] = False  # the window in the smallest place stays there
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (everywhere[1:] != everywhere[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(order)) - 1
    spans = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array(start[last].astype(np.int32)), pa.array(everywhere[at])], ["a", "b", "first"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[at], np.arange(len(rows) + 1)).astype(np.int32)), spans)


ROW = ["part", "anchor", "segment", "doc_id", "low", "n", "at", "shift", "bytes"]


def _dealt(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """anchor, segment, doc_id, low, n, at, bytes -> rows as in ROW: the windows of a segment by ranges of the anchor's offset in them."""
    import xxhash

    last = length - GRAM
    cuts = [(last + 1) * k // RANGES for k in range(RANGES + 1)]
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            some = b.slice(k, 1000)
            row, made = [], []
            for i, (n, at, data) in enumerate(zip(*(some.column(c).to_pylist() for c in (4, 5, 6)), strict=True)):
                for low, high in zip(cuts, cuts[1:], strict=False):
                    first, end = max(0, at - high + 1), min(n - 1, at - low)
                    if low < high and first <= end:
                        part = xxhash.xxh64_intdigest(data[at - low : at + length - high + 1], low) - (1 << 63)
                        row.append(i)
                        made.append((part, first, end - first + 1, at - first, data[first : end + length]))
            at_row = pa.array(row, pa.int64())
            part, shift, n, at, data = (pa.array([m[j] for m in made], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary())))
            low = pc.add(some.column(3).take(at_row), shift)
            yield pa.RecordBatch.from_arrays([part, *(some.column(c).take(at_row) for c in range(3)), low, n, at, shift, data], ROW)


def _ordered(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows as in ROW, sorted by part -> anchor, segment, shift, spans. Several parts are put in order at once: windows of different parts never agree, or are one string."""
    held: list[tuple] = []
    size = 0

    def done(rows: list[tuple]) -> pa.RecordBatch:
        spans = _marks([(*r[:1], *r[2:7], r[8]) for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[7] for r in rows], pa.int32()), spans], ["anchor", "segment", "shift", "spans"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(len(ROW))), strict=True):
            if size > BATCH and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[8])
    if held:
        yield done(held)


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans (bytes start to end, in any order, overlapping) -> what is left of each text."""
    wide = np.int64(1) << np.int64(32)
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            b = whole.slice(i, 1000)
            n = b.num_rows
            data, offsets = buffers(b.column(1))
            lists = b.column(2)
            sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            flat = lists.flatten()
            row = np.repeat(np.arange(n), sizes)
            start, end = (flat.field(f).to_numpy().astype(np.int64) for f in ("start", "end"))
            order = np.lexsort((start, row))
            row, low, high = row[order], (row * wide)[order] + start[order], (row * wide)[order] + end[order]
            reach = np.maximum.accumulate(high) if len(high) else high
            new = np.ones(len(low), bool)
            new[1:] = low[1:] > reach[:-1]
            at = np.flatnonzero(new)
            upto = np.append(at[1:], len(low)) - 1
            who, first, last = row[at], low[at] - row[at] * wide, (reach[upto] - row[at] * wide) if len(at) else low[at]
            removed = np.zeros(n, np.int64)
            np.add.at(removed, who, last - first)
            keep = np.zeros(len(data) + 1, np.int8)
            np.add.at(keep, offsets[who] + first, 1)
            np.add.at(keep, offsets[who] + last, -1)
            left = data[np.cumsum(keep[:-1]) == 0]
            ends = offsets - np.append(0, np.cumsum(removed))
            parts = [left[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            kept = pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()) if digest else pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.bincount(who, minlength=n).astype(np.int64)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def removed_spans(docs: DataFrame, length: int = 100, column: str = "text") -> DataFrame:
    """doc_id and spans (array of start, end in bytes; they may overlap) of every document that loses something."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs if column == "text" and docs.columns == ["doc_id", "text"] else docs.select("doc_id", F.col(column).alias("text"))
    runs = written(texts.mapInArrow(lambda b: _anchors(b, length), f"anchor long, doc_id {kind}, low int, n short, at short"))
    twice = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"))
    release(spark)
    hits = written(runs.join(twice, "anchor"))
    discard(runs)
    release(spark)
    again = written(hits.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "low", "n", "at")).alias("runs")))
    discard(hits)
    release(spark)
    row = f"anchor long, doc_id {kind}, low int, n short, at short, segment long"
    found = written(texts.join(again, "doc_id").select("doc_id", "text", "runs").mapInArrow(lambda b: _segments(b, length, False), row))
    discard(again)
    release(spark)
    distinct = written(found.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "low", "n", "at")).alias("f")).select("anchor", "segment", "f.*"))
    kinds = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    release(spark)
    # the bytes of the segments whose anchor has several
    asked = distinct.join(kinds, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "segment", "low", "n", "at")).alias("runs"))
    rivals = texts.join(asked, "doc_id").select("doc_id", "text", "runs").dropDuplicates(["doc_id"]).mapInArrow(lambda b: _segments(b, length, True), f"{row}, bytes binary")
    rivals = written(rivals.select("anchor", "segment", "doc_id", "low", "n", "at", "bytes"))
    release(spark)
    crowded = kinds.where(F.col("kinds") > BLOCK).select("anchor")
    spans = "array<struct<a:int, b:int, first:boolean>>"
    few = rivals.join(crowded, "anchor", "left_anti").select(F.col("anchor").alias("part"), "anchor", "segment", "doc_id", "low", "n", "at", F.lit(0).alias("shift"), "bytes")
    many = rivals.join(crowded, "anchor").select("anchor", "segment", "doc_id", "low", "n", "at", "bytes")
    many = written(many.mapInArrow(lambda b: _dealt(b, length), f"part long, {row.removesuffix(', segment long').replace('doc_id', 'segment long, doc_id')}, shift int, bytes binary"))
    single = many.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK).select("part")
    parts = few.unionByName(many.join(single, "part", "left_anti")).repartition("part").sortWithinPartitions("part", "doc_id", "low")
    marks = parts.select(*ROW).mapInArrow(lambda b: _ordered(b, length), f"anchor long, segment long, shift int, spans {spans}")
    windows = many.join(single, "part").select("anchor", "segment", "doc_id", "low", "shift", F.posexplode(F.expr(f"transform(sequence(0, n - 1), i -> substring(bytes, i + 1, {length}))")).alias("at", "window"))
    windows = written(windows.select("anchor", "segment", "doc_id", "low", "shift", "at", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), "window").alias("w2")))
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", (F.col("low") + F.col("at")).alias("start"))).alias("best"))
    best = (F.col("doc_id") == F.col("best.doc_id")) & (F.col("low") + F.col("at") == F.col("best.start"))
    alike = windows.join(least, ["w1", "w2"]).select("anchor", "segment", "shift", F.array(F.struct(F.col("at").alias("a"), F.col("at").alias("b"), (~best).alias("first"))).alias("spans"))
    marks = marks.unionByName(alike).select("anchor", "segment", F.expr("transform(spans, s -> struct(s.a + shift AS a, s.b + shift AS b, s.first AS first))").alias("spans"))
    marks = written(marks.groupBy("anchor", "segment").agg(F.flatten(F.collect_list("spans")).cast(spans).alias("spans")))  # at most length rows a segment
    release(spark)
    # a segment without rivals is marked in all places but its first
    alone = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).cast("int").alias("b"), F.lit(False).alias("first"))).cast(spans)
    marks = written(distinct.select("anchor", "segment", F.col("doc_id").alias("first_doc"), F.col("low").alias("first_low"), "n").join(marks, ["anchor", "segment"], "left").select("anchor", "segment", "first_doc", "first_low", F.coalesce("spans", alone).alias("spans")))
    places = found.select("anchor", "segment", "doc_id", "low").join(marks, ["anchor", "segment"])
    is_first = "(doc_id = first_doc AND low = first_low)"
    cut = places.select("doc_id", F.expr(f"transform(filter(spans, s -> s.first OR NOT {is_first}), s -> struct(low + s.a AS start, low + s.b + {length} AS end))").alias("spans")).where("size(spans) > 0")
    return written(cut.groupBy("doc_id").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def _own_numbers(docs: DataFrame, column: str) -> DataFrame | None:
    """doc_id, text_id and a number for each different pair, in the order of documents; None where doc_id is such a number already."""
    ids = docs.select("doc_id", F.xxhash64(column).alias("text_id"))
    if ids.groupBy("doc_id").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("doc_id IS NULL OR a <> b").isEmpty():
        return None
    order = [F.col("doc_id").isNull(), "doc_id", "text_id"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(ids.distinct().repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before")  # a row for each part
    return written(dealt.join(F.broadcast(before), "part").selectExpr("doc_id", "text_id", "before + row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS LAST, text_id) AS number"))


def deduplicated(docs: DataFrame, length: int = 100, column: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the remaining bytes, or with digest their SHA-256 in hex.

    The texts are bucketed by doc_id once, so the three joins by doc_id move only small rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = _own_numbers(docs, column)
    if numbers is None:
        return _deduplicated(docs.select("doc_id", F.col(column).alias("text")), length, digest, kind)
    rows = docs.select(F.col("doc_id").alias("__id"), F.col(column).alias("text"), F.xxhash64(column).alias("__text_id"))
    texts = rows.join(numbers, rows["__id"].eqNullSafe(numbers["doc_id"]) & (rows["__text_id"] == numbers["text_id"])).select(F.col("number").alias("doc_id"), "text")
    out = _deduplicated(texts, length, digest, "long").withColumnRenamed("doc_id", "number")
    return out.join(numbers, "number").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def _deduplicated(docs: DataFrame, length: int, digest: bool, kind: str) -> DataFrame:
    texts = bucketed(docs, "doc_id")
    release(docs.sparkSession)
    spans = removed_spans(texts, length)
    release(docs.sparkSession)
    both = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(lambda b: _cut(b, digest), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
