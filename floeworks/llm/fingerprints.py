"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A window of WINDOW bytes rolls over the UTF-8 bytes of a text (shorter at the start of the text). Its hash has as many
leading zeros as its level; a chunk of block size 2**k ends behind each window of level k or more, so the boundaries of a
block size are among those of the next smaller one. The block size of a text is the largest with at least LEAST boundaries, so most
texts have up to twice as many; where repeated passages give more than MOST, it is the smallest with at most MOST. Each chunk, the rest
behind the last boundary included, becomes one letter: a hash of the windows that end in it. A fingerprint is `k:letters at 2**k:letters at 2**(k+1)`. No part of a text is left out, and equal texts
have equal fingerprints, whatever stands around them.

Two fingerprints are compared where they have a block size in common: the likeness of two runs of letters is 1 less their edit
distance (insertions and deletions) by the sum of their lengths, if they share a stretch of SHARED letters, else 0. Without a
common block size it is 0; equal fingerprints have 1, also those of two empty texts.

Null texts count as empty: no letters, likeness 0 with all others. Long texts are hashed in blocks; four bytes a byte of one text are
held at a time. A long text of one period has boundaries everywhere or nowhere, so its letters may be few. Repeated rows and
rows without doc_id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textbytes import buffers, mix, pieces, prefix_hash, span_hash

WINDOW = 7
LEAST = 64
MOST = 4096
SHARED = 7
BLOCK = 1 << 18
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEVELS = 34


def _windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 32-bit hash of the window that ends at each byte; windows don't reach over the start of their text."""
    out = np.empty(len(data), np.uint32)
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        lead = max(0, a - WINDOW + 1)
        starts = np.maximum(np.arange(a, b) - WINDOW + 1, lead)
        i, j = np.searchsorted(filled, (a - WINDOW, b))
        early = filled[i:j, None] + np.arange(WINDOW - 1)
        kept = (early < ends[i:j, None]) & (early >= a) & (early < b)
        starts[early[kept] - a] = np.broadcast_to(filled[i:j, None], early.shape)[kept]
        h = span_hash(prefix_hash(data[lead:b]), starts - lead, np.arange(a + 1, b + 1) - lead)
        out[a:b] = h >> np.uint64(32)
    return out


def _levels(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the highest level that LEAST windows reach, or where these are too many the lowest that at most MOST reach."""
    rows = len(offsets) - 1
    found = np.zeros(rows * LEVELS, np.int64)
    for a in range(0, len(hashes), BLOCK):
        part = hashes[a : a + BLOCK]
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, a + len(part)))
        row = np.repeat(np.arange(i, j), np.diff(np.clip(offsets[i : j + 1], a, a + len(part))))
        zeros = np.minimum(31 - ((part.astype(np.float64).view(np.int64) >> 52) - 1023), 32)
        counts = np.bincount((row - i) * LEVELS + zeros, minlength=(j - i) * LEVELS)
        found[i * LEVELS : j * LEVELS] += counts
    reach = np.cumsum(found.reshape(rows, LEVELS)[:, ::-1], axis=1)[:, ::-1]
    level = np.maximum((reach >= LEAST).sum(axis=1) - 1, 0)
    return np.where(reach[np.arange(rows), level] > MOST, np.argmax(reach <= MOST, axis=1), level)


def _letters(hashes: np.ndarray, boundaries: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A letter for each chunk of each text; boundaries are the last bytes of chunks."""
    cuts = np.union1d(boundaries + 1, offsets[1:][offsets[1:] > offsets[:-1]])
    if not len(cuts):
        return [b""] * (len(offsets) - 1)
    sums = np.add.reduceat(hashes, np.concatenate([[0], cuts[:-1]]), dtype=np.uint64)
    line = LETTERS[(mix(sums) >> np.uint64(58)).astype(np.int64)].tobytes()
    at = np.searchsorted(cuts, offsets, "right").tolist()
    return [line[a:b] for a, b in zip(at, at[1:])]


def of_bytes(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprints of texts that stand one behind the other."""
    hashes = _windows(data, offsets)
    levels = _levels(hashes, offsets) if len(data) else np.zeros(len(offsets) - 1, np.int64)
    limits = np.where(levels <= 32, np.uint64(1) << (32 - np.minimum(levels, 32)).astype(np.uint64), np.uint64(0))
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(hashes), BLOCK):
        part = hashes[a : a + BLOCK]
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, a + len(part)))
        found.append(a + np.flatnonzero(part < np.repeat(limits[i:j], np.diff(np.clip(offsets[i : j + 1], a, a + len(part))))))
    boundaries = np.concatenate(found)
    row = np.searchsorted(offsets, boundaries, "right") - 1
    coarse = boundaries[hashes[boundaries] < limits[row] >> np.uint64(1)]
    return [f"{k}:{x.decode()}:{y.decode()}" for k, x, y in zip(levels.tolist(), _letters(hashes, boundaries, offsets), _letters(hashes, coarse, offsets))]


def of_texts(texts: list[bytes]) -> list[str]:
    """The fingerprints of UTF-8 texts, taken in pieces of bounded size."""
    out: list[str] = []
    for _, _, data, offsets in pieces(*buffers(pa.array(texts, pa.large_binary()))):
        out += of_bytes(data, offsets)
    return out


def common(x: str, y: str) -> int:
    """The length of the longest common subsequence, a bit for each letter of x."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = free = (1 << len(x)) - 1
    for c in y:
        met = free & places.get(c, 0)
        free = ((free + met) | (free - met)) & full
    return len(x) - free.bit_count()


def _alike(x: str, y: str) -> float:
    if not x or not y:
        return 0.0
    run = min(SHARED, (min(len(x), len(y)) + 1) // 2)
    if {x[i : i + run] for i in range(len(x) - run + 1)}.isdisjoint(y[i : i + run] for i in range(len(y) - run + 1)):
        return 0.0
    return 2 * common(x, y) / (len(x) + len(y))


def compare(a: str, b: str) -> float:
    """The likeness of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    (k, x, xx), (n, y, yy) = a.split(":"), b.split(":")
    if k == n:
        return max(_alike(x, y), _alike(xx, yy))
    if int(n) == int(k) + 1:
        return _alike(xx, y)
    return _alike(x, yy) if int(k) == int(n) + 1 else 0.0


def _of_series(texts: pd.Series) -> pd.Series:
    return pd.Series(of_texts([(t or "").encode() for t in texts]), dtype="object")


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else compare(x, y) for x, y in zip(a, b)], dtype="float64")


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints; null where either is null."""
    return F.pandas_udf(_likeness, "double")(a, b)


def with_fingerprint(docs: DataFrame, column: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of column as name; a column of that name is replaced, all others stay."""
    return docs.withColumn(name, F.pandas_udf(_of_series, "string")(docs[column]))


def edited(text: str, after: str) -> str:
    """text with its last quarter (rounded down) replaced by the first as many code points of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


FIELDS = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _held(ids: list, texts: list[str], prints: list[str], following: list[str], next_prints: list[str]) -> list[list]:
    """The columns of FIELDS for texts and those that follow them."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    changed_prints = of_texts(changed)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], prints, changed_prints,
        [compare(a, b) for a, b in zip(prints, changed_prints)], [compare(a, b) for a, b in zip(prints, next_prints)],
    ]


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A sorted partition: what each text but the last gives with the next one, and the partition's first and last text."""
    from pyspark import TaskContext

    run, held = TaskContext.get().partitionId(), None

    def batch(part: str, columns: list[list], texts: list[str | None]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[part] * n, [run] * n, *columns, texts], schema)], schema=schema)

    for b in batches:
        ids = b.column(0).to_pylist()
        for i, j, data, offsets in pieces(*buffers(b.column(1))):
            raw, at = data.tobytes(), offsets.tolist()
            rows = list(zip(ids[i:j], (raw[x:y].decode() for x, y in zip(at, at[1:])), of_bytes(data, offsets)))
            if held is None:
                yield batch("first", [[None], [None], [None], [rows[0][2]], *[[None]] * 3], [rows[0][1]])
            else:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) > 1:
                names, texts, prints = (list(x) for x in zip(*rows))
                yield batch("whole", _held(names[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]), [None] * (len(rows) - 1))
    if held:
        yield batch("last", [[held[0]], [None], [None], [held[2]], *[[None]] * 3], [held[1]])


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """doc_id, text, fingerprint, text and fingerprint of the next -> FIELDS, a row at a time."""
    for b in batches:
        for i in range(b.num_rows):
            columns = _held(*(c.to_pylist() for c in b.slice(i, 1).columns[:3]), *(c.to_pylist() for c in b.slice(i, 1).columns[3:]))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)


def against_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, held against its edited text's and against that of the next document.

    The next is that of the next larger doc_id (rows without doc_id come first, equal ids in the order of a hash of their
    texts), after the last one the first. The table is dealt once, by ranges of doc_id; each range is read in order, and what
    its last document still needs, the first of the next range that has rows, comes from a table with two rows a range.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the last key only parts rows that are equal in both others
    dealt = texts.withColumn("o1", F.xxhash64("text")).withColumn("o2", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(ranges, "doc_id", "o1", "o2")
    fields = f"part string, run int, {FIELDS.format(kind=kind)}, text string"
    whole = to_arrow_schema(spark.createDataFrame([], fields).schema)
    found = written(dealt.sortWithinPartitions("doc_id", "o1", "o2").select("doc_id", "text").mapInArrow(lambda b: _runs(b, whole), fields))
    first = found.where("part = 'first'").select(F.col("run").alias("next_run"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # as many rows as ranges, numbers only
    follow = first.select(F.col("next_run").alias("run")).withColumn("next_run", F.lead("run").over(Window.orderBy("run")))
    follow = follow.withColumn("next_run", F.coalesce("next_run", F.min("run").over(Window.partitionBy())))
    last = found.where("part = 'last'").select("run", "doc_id", "text", "fingerprint").join(follow, "run").join(first, "next_run")
    names = [f.name for f in whole][2:-1]
    own = pa.schema([whole.field(n) for n in names])
    ends = last.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(lambda b: _joined(b, own), FIELDS.format(kind=kind))
    return found.where("part = 'whole'").select(*names).unionByName(ends)
