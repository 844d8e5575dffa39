"""Array files as a Spark data source: `spark.read.format("rasters")`, and a writer of the same layout.

A root has a folder for each timestamp with arrays (channel, row, col) or (row, col) in NumPy's format. Reading lists the files; a partition is a piece of a large
file or a run of small ones, and its task reads the headers and the rows that begin in its pieces, some at a time. Writing takes rows in order of timestamp, channel,
row and column, and puts one map after the other into its file; a map is complete within one task.

Paths are opened with pyarrow's file systems, so they may be local (shared by all machines) or of any store that those know.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "timestamp string, channel_no int, row int, col int, value double"
ARROW = pa.schema([("timestamp", pa.string()), ("channel_no", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64())])
#: Bytes that are read at a time, as far as whole rows allow.
PART = 32 << 20
#: Bytes of one partition, and what opening a file counts as.
TASK, OPEN = 32 << 20, 64 << 10


def _at(path: str) -> tuple[pf.FileSystem, str]:
    fs, at = pf.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, at.rstrip("/")


@dataclass
class Pieces(InputPartition):
    """Files, each with the bytes first to last of it."""

    pieces: list[tuple[str, int, int]]


def _header(data: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, type, and where the values begin."""
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    return shape, fortran, dtype, f.tell()


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.name, self.part = options["path"], options.get("name", "x_stack.npy"), int(options.get("partbytes", PART))

    def partitions(self) -> list[Pieces]:
        fs, root = _at(self.root)
        out, held, size = [], [], 0
        for info in fs.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != pf.FileType.File or info.base_name != self.name:
                continue
            for first in range(0, max(1, info.size), TASK):
                last = min(first + TASK, info.size)
                if held and size + last - first + OPEN > TASK:
                    out.append(Pieces(held))
                    held, size = [], 0
                held.append((info.path, first, last))
                size += last - first + OPEN
        return [*out, Pieces(held)] if held else out

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        fs, _ = _at(self.root)
        for path, first, last in partition.pieces:
            with fs.open_input_file(path) as f:
                yield from self._rows(f, path, first, last)

    def _rows(self, f: pa.NativeFile, path: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """The rows of all channels that begin from first on and before last."""
        shape, fortran, dtype, offset = _header(f.read_at(min(f.size(), 4096), 0))
        if len(shape) not in (2, 3) or fortran or dtype.hasobject:
            raise ValueError(f"{path}: rows of plain numbers in two or three dimensions are asked for")
        c, h, w = shape if len(shape) == 3 else (1, *shape)
        stamp, line = path.rsplit("/", 2)[-2], w * dtype.itemsize
        if not line:
            return
        begin, end = (min(max(0, -((offset - at) // line)), c * h) for at in (first, last))  # the first row that begins at a place or behind it
        step = max(1, min(self.part // line, (1 << 16) // w))
        for i in range(begin, end, step):
            e = min(i + step, end)
            values = np.frombuffer(f.read_at((e - i) * line, offset + i * line), dtype)
            channel, row = np.divmod(np.arange(i, e), h)
            columns = (np.repeat(channel, w), np.repeat(row, w), np.tile(np.arange(w), e - i))
            yield pa.RecordBatch.from_arrays([pa.array([stamp] * len(values)), *(pa.array(x.astype(np.int32)) for x in columns), pa.array(values.astype(np.float64))], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task under their temporary names, with the names they get."""

    moves: list[tuple[str, str]]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.name, self.dtype = options["path"], options.get("name", "x_stack.npy"), options.get("dtype", "float32")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _at(self.root)
        moves: list[tuple[str, str]] = []
        now, held = None, []

        def store() -> None:
            c, r, k, v = (np.concatenate(x) for x in zip(*held))
            a = np.full((c.max() + 1, r.max() + 1, k.max() + 1), math.nan)
            a[c, r, k] = v
            out = io.BytesIO()
            np.save(out, a.astype(self.dtype))
            fs.create_dir(f"{root}/{now}", recursive=True)
            temporary = f"{root}/{now}/.{self.name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(out.getbuffer())
            moves.append((temporary, f"{root}/{now}/{self.name}"))

        for b in iterator:
            stamps = b.column("timestamp").to_pylist()
            starts = [0, *(i for i in range(1, len(stamps)) if stamps[i] != stamps[i - 1]), len(stamps)]
            for a, e in zip(starts, starts[1:]):
                if a == e:
                    continue
                if stamps[a] != now:
                    if held:
                        store()
                    now, held = stamps[a], []
                held.append(tuple(b.column(c).slice(a, e - a).to_numpy(zero_copy_only=False) for c in ("channel_no", "row", "col", "value")))
        if held:
            store()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _at(self.root)
        for m in messages:
            for a, b in m.moves if m else ():
                fs.move(a, b)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _at(self.root)
        for m in messages:
            for a, _ in m.moves if m else ():
                fs.delete_file(a)


class RasterSource(DataSource):
    """options: path, name of the array file (x_stack.npy), partbytes (reading), dtype (writing, float32)."""

    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options)


def read_rasters(spark: SparkSession, root: str, name: str = "x_stack.npy", part_bytes: int = PART) -> DataFrame:
    """timestamp, channel_no, row, col, value of all `<root>/<timestamp>/<name>` arrays."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("rasters").option("name", name).option("partbytes", part_bytes).load(root)


def write_rasters(cells: DataFrame, root: str, name: str = "x_stack.npy", dtype: str = "float32") -> None:
    """cells (timestamp, channel_no, row, col, value) as `<root>/<timestamp>/<name>`; places that are missing become NaN."""
    cells.sparkSession.dataSource.register(RasterSource)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = cells.selectExpr(*(f"CAST({c} AS {k}) AS {c}" for c, k in (x.split() for x in SCHEMA.split(", ")))).where(" AND ".join(f"{c} IS NOT NULL" for c in columns[:4]))
    rows.repartition("timestamp").sortWithinPartitions(*columns[:4]).write.format("rasters").option("name", name).option("dtype", dtype).mode("append").save(root)
