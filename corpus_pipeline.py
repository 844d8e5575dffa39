"""A training-corpus pipeline over `documents`: each stage works on all that the one before it kept.

Quality rules, line dedup, near-dedup, mixing to target weights, and byte-level BPE. A stage takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.

All stages but the last return the columns of documents and no others; further columns of docs, whatever their names, are
dropped. Texts are read whole, however long. An empty table stays empty through all stages. What each stage does with
nulls, empty texts, ties, repeated rows and rows without doc_id stands at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from floeworks.llm import bpe, lines, mixing, neardup, quality
from floeworks.llm.queries import tokenizer_path
from floeworks.llm.shared import delete, shared_folder, table
from floeworks.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail a base rule or whose host mostly fails one of the rules.

    Null and empty texts have no words and go. A null source is a host of its own. Repeated rows and rows without doc_id
    are judged each by its own text; a host rate equal to its limit rejects.
    """
    prepare(spark)
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take recurring lines out of the texts; every document stays, and one all of whose lines recur keeps them.

    Null and empty texts stay as they are. Rows that share a doc_id count as one document, as do all rows without one;
    each row loses its own lines. Of templates that a line agrees with equally the oldest is joined.
    """
    prepare(spark)
    return lines.without_recurring(docs.select(*COLUMNS), spare_copies=True).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each class of near-duplicates (five words, similarity 0.8).

    Null and empty texts are classes of their own and stay. Each row is judged by its own text: repeated rows stay or go
    together, a row without doc_id goes if its class has a document with one. Equal texts go to the smallest doc_id.
    """
    prepare(spark)
    return neardup.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most.

    Null and empty texts have no words and are not taken. A null source is a source of its own, after the others. Repeated
    rows and rows without doc_id are documents of their own; of documents equally near to what is missing the first
    by hash and doc_id is taken.
    """
    prepare(spark)
    return mixing.resample(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the bytes they decode to.

    Null and empty texts have no ids. Repeated rows and rows without doc_id are encoded alike; merges of equal rank go
    from left to right, as in the library.
    """
    prepare(spark)
    out = bpe.encode(docs.select(*COLUMNS), tokenizer_path(), digest=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: Near-duplicates by sketches, templates and token merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what each returns is written to the shared folder, read again, and deleted once the next stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
