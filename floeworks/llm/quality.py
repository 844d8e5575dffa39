"""Quality rules per document and per host.

Each document is measured once (counts over its whole text) and tested against rules: "base" (fewer than
min_words words, or more than max_repeat_percent of them in repeated windows), "symbols" (more symbols than words),
"dup_lines" (three times the repeated lines exceed a fifth of the words, or 3) and "word_length" (words of fewer
than 2 or more than 15 characters on average). The failures of each rule are summed by host; a host's failure rate of
a rule is shrunk towards all hosts by a beta prior whose strength comes from the hosts' own spread (moments). A host
is rejected if the shrunk rate of any rule reaches that rule's limit in HOST_LIMITS, and the verdict is joined back to
its documents.

A document is kept if it passes the base rule and its host is not rejected; the other rules act through hosts only.

Null or empty texts have no words, so they fail the base rule; very long ones are measured whole. A null host is a
host of its own. Repeated rows each count; rows without doc_id are judged like others. A rate equal to its limit
rejects. An empty table gives no rows. Other columns are kept; a column named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textbytes import SPACE, buffers, mix, pieces, prefix_hash, span_hash, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW, SMALL = 8, 100_000
WHITE = b" \t\n\v\f\r"
#: A host is rejected from these shrunk failure rates on.
HOST_LIMITS = {"base": 0.5, "symbols": 0.5, "dup_lines": 0.5, "word_length": 0.5}


def _by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(hashes: np.ndarray, before: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per row, the words that lie in a window of width words found twice or more in that row."""
    n, rows = len(hashes), len(before) - 1
    if n < width:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(before))
    key = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(key)])
    at = np.flatnonzero(row[: len(key)] == row[width - 1 :])
    key = mix(key[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + width + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + width, -1)
    return _by_row(np.cumsum(cover)[:n] > 0, before)


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of an Arrow column."""
    data, offsets = buffers(column)
    parts = []
    for _, _, b, o in pieces(data, offsets):
        starts, ends, before = words(b, o)
        inside = ~SPACE[b]
        whole = b.tobytes()
        parts.append(
            (
                np.diff(before),
                _by_row(inside & ((b & 0xC0) != 0x80), o),
                _by_row(SYMBOL[b], o),
                np.array([_duplicate_lines(whole[i:j]) for i, j in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], np.int64),
                repeated_words(span_hash(prefix_hash(b), starts, ends), before),
            )
        )
    return {c: np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i, c in enumerate(COUNTS)}


def with_counts(docs: DataFrame, column: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the columns of COUNTS; without the text where it is no longer needed."""
    kept = [f for f in docs.schema.fields if f.name not in COUNTS and (keep_text or f.name != column)]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    source = docs.select(*{column: 0, **{f.name: 0 for f in kept}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = measure(b.column(b.schema.names.index(column)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(f.name)) for f in kept), *(pa.array(made[c]) for c in COUNTS)], [*(f.name for f in kept), *COUNTS])

    return source.mapInArrow(run, schema)


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def rules(min_words: int = 20, max_repeat_percent: int = 30) -> dict[str, Column]:
    """All rules by name; "base" rejects a document by itself, and each acts through its host."""
    n = F.col("n_words")
    return {
        "base": base_failed(min_words, max_repeat_percent),
        "symbols": F.col("n_symbols") > n,
        "dup_lines": 3 * F.col("n_dup_lines") > F.greatest(n / 5, F.lit(3)),
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
    }


def host_rates(counted: DataFrame, host: str = "source", **limits: int) -> DataFrame:
    """Per host: documents, failures of each rule, and the shrunk rate of each rule (`rate_<rule>`).

    The beta prior of a rule has the mean of all documents and the strength that the variance of the
    hosts' rates leaves after binomial noise; without spread or with one host it is 1e6 documents.
    """
    checks = rules(**limits)
    by_host = written(counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(c.cast("long")).alias(f"fail_{r}") for r, c in checks.items())))
    n = F.col("n_docs")
    sums = [F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("hosts")]
    for r in checks:
        k = F.col(f"fail_{r}")
        sums += [F.sum(k).alias(f"k_{r}"), F.sum(k * k / n).alias(f"kk_{r}")]
    total = by_host.agg(*sums).first()
    out = by_host
    for r in checks:
        all_docs, hosts = total["n"] or 0, total["hosts"]
        mean = (total[f"k_{r}"] or 0) / all_docs if all_docs else 0.0
        strength = 1e6
        if hosts > 1 and 0 < mean < 1:
            spread = total[f"kk_{r}"] - all_docs * mean * mean
            noise = (hosts - 1) * mean * (1 - mean)
            between = max(0.0, (spread - noise) / (all_docs - total["nn"] / all_docs))
            if between > 0:
                strength = min(1e6, max(1.0, mean * (1 - mean) / between - 1))
        out = out.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + F.lit(mean * strength)) / (n + F.lit(strength)))
    return out


def judged(counted: DataFrame, rates: DataFrame, host: str = "source", host_limits: dict[str, float] | None = None, **limits: int) -> DataFrame:
    """counted with base_failed, host_rejected and kept."""
    over = F.lit(False)
    for rule, limit in (HOST_LIMITS if host_limits is None else host_limits).items():
        over = over | (F.col(f"rate_{rule}") >= limit)
    verdict = rates.where(over).select(F.col("host").alias("__host"), F.lit(True).alias("host_rejected"))
    if verdict.limit(SMALL + 1).count() <= SMALL:
        verdict = F.broadcast(verdict)  # so that no text is moved to its host
    return (
        counted.drop("base_failed", "host_rejected", "kept")
        .withColumn("base_failed", base_failed(**limits))
        .join(verdict, F.col(host).eqNullSafe(F.col("__host")), "left")
        .drop("__host")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def keep_good(docs: DataFrame, host: str = "source", column: str = "text", host_limits: dict[str, float] | None = None, **limits: int) -> DataFrame:
    """The documents that are kept, with the columns of docs.

    The counts are made twice (for the hosts, then beside the text): that moves no text between machines.
    """
    rates = host_rates(with_counts(docs.select(*{host: 0, column: 0}), column, keep_text=False), host, **limits)
    columns = docs.columns
    good = judged(with_counts(docs.select(*(F.col(c) for c in columns)), column), rates, host, host_limits, **limits)
    return good.where("kept").select(*columns)
