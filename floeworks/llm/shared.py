"""Places shared by driver and executors, and lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="floeworks-")
    return _own[key]


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, lineage cut.

    The files are all that later steps need, so a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing will read again."""
    delete(df.sparkSession, df._written_to)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table bucketed by key in the shared folder: later joins on key move only their other side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"t{uuid.uuid4().hex}"
    df.repartition(n, key).write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files are in the shared folder
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished phases, to which nothing refers any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut where a key changes, so that each piece is of one group; a group may be many pieces."""
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for start, end in zip(ends, ends[1:]):
            yield b.slice(start, end - start)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches as one batch for each run of equal keys (numbers); a run may span batches."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(k).to_numpy() for k in keys]
        new = np.zeros(b.num_rows - 1, bool)
        for v in values:
            new |= v[1:] != v[:-1]
        ends = [*(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        start = 0
        for end in ends:
            key = tuple(v[start] for v in values)
            if held and key != now:
                yield whole()
                held = []
            held.append(b.slice(start, end - start))
            now, start = key, end
    if held:
        yield whole()
