"""Ranked lexical search turned round: documents stream past an inverted index of the items.

The terms of all items form an inverted index (term -> items) that goes to every task. A first pass counts each document's terms, kept
where some item has them; from these counts come the number of documents, their length and the documents that hold a term.
A second pass sends each document's counts through the index: every term adds its weight to the items of its posting list, and
each task keeps a heap of the k best documents for an item. Heaps are merged in two rounds of sums by item, so no item is one
task with all of them.

What is broadcast is bounded: items are dealt into blocks whose terms take at most BLOCK_BYTES (a block has one item at least), and
each block has passes of its own. Postings add up exactly, in whole numbers.

Terms are the longest runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. Null and empty
texts have no terms: such documents are not counted, such items find nothing. Very long texts are counted whole. Rows that share an item_id
are one item with the terms of all; rows without item_id are one item of their own. Repeated documents are documents of their own, and
of equal scores the smaller doc_id comes first, rows without doc_id last. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textbytes import LOWER, buffers, pieces

BLOCK_BYTES = 16 << 20
TERM = np.ones(256, bool)
TERM[:128] = [chr(i).isalnum() for i in range(128)]
#: Entries of one block of scores, and of postings that are added up at once.
CELLS = 1 << 22
NO_ID = (1 << 63) - 1
MERGES = 64


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts one behind the other, and each text's first term (one more entry than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = TERM[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    joined = LOWER[data[inside[1:-1]]]
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(joined)])
    return array, np.searchsorted(starts, offsets)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> item_id, term."""
    for b in batches:
        for i, j, data, offsets in pieces(*buffers(b.column(1))):
            found, at = terms(data, offsets)
            row = np.repeat(np.arange(i, j), np.diff(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), found.cast(pa.binary())], ["item_id", "term"])


def _counts(batches: Iterator[pa.RecordBatch], known: list[bytes]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n, terms (their numbers in known) and times, for each text with a term."""
    values = pa.array(known, pa.large_binary())
    for b in batches:
        for i, j, data, offsets in pieces(*buffers(b.column(1))):
            found, at = terms(data, offsets)
            number = pc.index_in(found, value_set=values)
            hit = number.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(j - i), np.diff(at))[hit]
            pair, times = np.unique(row * len(known) + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
            ends = np.searchsorted(pair, np.arange(j - i + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pair % max(1, len(known)), times)]
            out = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), *lists], ["doc_id", "n", "terms", "times"])
            yield out.filter(pc.greater(out.column("n"), 0))


class Index:
    """The inverted index of some items, with the corpus's figures."""

    def __init__(self, pairs: list[tuple[int | None, bytes]]):
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is not None, i))
        self.terms = sorted({t for _, t in pairs})
        item, term = ({x: k for k, x in enumerate(v)} for v in (self.items, self.terms))
        by_term: list[list[int]] = [[] for _ in self.terms]
        for i, t in set(pairs):
            by_term[term[t]].append(item[i])
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in by_term], dtype=np.int64)])
        self.postings = np.array([i for x in by_term for i in sorted(x)], np.int64)

    def weigh(self, docs: int, length: int, holding: dict[int, int]) -> None:
        self.docs, self.length = docs, length
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * holding.get(k, 0) + 1))) for k in range(len(self.terms))], np.int64)

    def scores(self, n: np.ndarray, ends: np.ndarray, term: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First document and scores (documents by items) of blocks of documents."""
        worth = 10 + 90 * n * self.docs // self.length
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        adds = self.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * worth[doc]))
        lists = self.first[term + 1] - self.first[term]
        work = np.concatenate([[0], np.cumsum(lists)])[ends]
        # in doubles whole numbers are exact as far as this
        small = len(self.terms) * 1_000_000 * int(self.weights.max(initial=1)) < 1 << 53
        wide, a = len(self.items), 0
        while a < len(n):
            b = int(np.searchsorted(work, work[a] + CELLS, "right")) - 1
            b = max(a + 1, min(b, len(n), a + CELLS // wide))
            at = slice(ends[a], ends[b])
            place = np.repeat(self.first[term[at]] - np.cumsum(lists[at]) + lists[at], lists[at]) + np.arange(work[b] - work[a])
            cell = np.repeat((doc[at] - a) * wide, lists[at]) + self.postings[place]
            if small:
                found = np.bincount(cell, np.repeat(adds[at], lists[at]), (b - a) * wide).astype(np.int64)
            else:
                found = np.zeros((b - a) * wide, np.int64)
                np.add.at(found, cell, np.repeat(adds[at], lists[at]))
            yield a, found.reshape(b - a, wide)
            a = b


def _best(batches: Iterator[pa.RecordBatch], index: Index, k: int) -> Iterator[pa.RecordBatch]:
    """Counts of documents -> item_id, doc_id, score of the k best of this task for each item."""
    heaps: list[list[tuple[int, int]]] = [[] for _ in index.items]
    least = np.ones(len(heaps), np.int64)
    last = np.full(len(heaps), NO_ID, np.int64)  # of equal scores a smaller doc_id than this comes in
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
        lists = b.column("terms")
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
        for a, found in index.scores(b.column("n").to_numpy(), ends - ends[0], *flat):
            own, bound = ids[a : a + len(found), None], least
            if len(found) > k:  # no more than the block's own k best, and what equals the last of them
                bound = np.maximum(least, np.partition(found, len(found) - k, axis=0)[len(found) - k])
            for d, i in zip(*(x.tolist() for x in np.nonzero((found > bound) | (found == bound) & ((own <= last) | (bound > least))))):
                entry, heap = (int(found[d, i]), -int(own[d, 0])), heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    least[i], last[i] = heap[0][0], -heap[0][1] - 1
    rows = [(index.items[i], None if -d == NO_ID else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], ["item_id", "doc_id", "score"])


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items and their terms in lists of at most limit bytes, or of one item."""
    found = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term binary").distinct())
    sizes = found.groupBy("item_id").agg(F.sum(F.length("term") + 64).alias("bytes"))
    total = sizes.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    parts = -(-(total[0] or 0) // limit)

    def part(n: int):
        return F.pmod(F.xxhash64("item_id"), F.lit(n))

    while parts > 1 and parts < total[1] * 4 and not sizes.groupBy(part(parts).alias("part")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).where(f"bytes > {limit} AND n > 1").isEmpty():
        parts *= 2
    for p in range(parts):
        pairs = [(r[0], bytes(r[1])) for r in found.where(part(parts) == p).collect()]
        if pairs:
            yield pairs


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, limit: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents of docs (doc_id, text) that score highest for each of items (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for pairs in blocks(items, limit):
        index = Index(pairs)
        known = index.terms
        counts = written(docs.mapInArrow(lambda b, known=known: _counts(b, known), "doc_id long, n long, terms array<int>, times array<int>"))
        docs_n, length = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not docs_n:
            return out
        holding = counts.select(F.explode("terms").alias("term")).groupBy("term").count()  # one row a term of the block
        index.weigh(docs_n, length, {r[0]: r[1] for r in holding.collect()})
        heaps = counts.mapInArrow(lambda b, index=index: _best(b, index, k), "item_id long, doc_id long, score long")
        merged = _top(heaps.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(MERGES))), k, "item_id", "share").drop("share")
        out = out.unionByName(_top(merged.drop("rank"), k, "item_id").select("item_id", "rank", "doc_id", "score"))
    return out
