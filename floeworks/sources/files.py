"""Readers and writers of the domain's files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .rasters import _at

#: Columns of a position file; only time and place must hold a value.
AIS_COLUMNS = ("mmsi", "postime", "lon", "lat", "status", "eta", "dest", "draught", "cog", "hdg", "sog", "rot")
DEFAULT_CHANNELS = ("ice_conc", "ice_thick", "wave_hs", "wind_u10", "wind_v10", "bathy", "ais_heatmap")


def read_ais_csv(spark: SparkSession, path: str) -> DataFrame:
    """Positions from CSV with a header: rows whose lon or lat is no number are dropped, a bad postime is an error."""
    raw = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in AIS_COLUMNS)).csv(path)
    time = F.try_to_timestamp("postime", F.lit("yyyy-MM-dd HH:mm:ss"))
    checked = F.when(time.isNull(), F.raise_error(F.concat(F.lit("bad postime: "), F.coalesce("postime", F.lit("null")))).cast("timestamp")).otherwise(time)
    out = raw.select(F.col("mmsi").try_cast("long").alias("mmsi"), checked.alias("postime"), F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"), *AIS_COLUMNS[4:])
    return out.where("lon IS NOT NULL AND lat IS NOT NULL")


def name_channels(cells: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """cells with channel: from meta (timestamp, channel_names), else the default list, else `env_<i>`."""
    default = F.get(F.array(*map(F.lit, DEFAULT_CHANNELS)), F.col("channel_no"))
    if meta is None:
        return cells.withColumn("channel", F.coalesce(default, F.concat(F.lit("env_"), F.col("channel_no").cast("string"))))
    named = cells.join(F.broadcast(meta.select("timestamp", "channel_names")), "timestamp", "left")  # a row a map
    return named.withColumn("channel", F.coalesce(F.get("channel_names", F.col("channel_no")), F.when(F.col("channel_names").isNull(), default), F.concat(F.lit("env_"), F.col("channel_no").cast("string")))).drop("channel_names")


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """timestamp, channel_names from `<root>/<timestamp>/meta.json`; broken files give null names."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").schema("channel_names array<string>").json(root)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("timestamp"), "channel_names")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows from JSON lines: lines without a path are skipped, `\\` becomes `/`, the last of equal paths wins."""
    raw = spark.read.schema("path string, size long, mtime_ns long, hash string, timestamp string, source string, line long").json(path)
    rows = raw.drop("line").withColumn("path", F.regexp_replace("path", r"\\", "/")).where("path <> ''").withColumn("__i", F.monotonically_increasing_id())
    last = F.row_number().over(W.partitionBy("path").orderBy(F.desc("__i")))
    return rows.withColumn("__r", last).where("__r = 1").drop("__i", "__r")


def write_manifest(df: DataFrame, path: str) -> None:
    df.select("path", "size", "mtime_ns", "hash", "timestamp", "source").write.mode("overwrite").json(path)


def read_bench(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Runs from payload files that hold them under `rows`, or from CSV. Without the schema of a run the files are read twice, to find it first."""
    if path.endswith(".csv"):
        read = spark.read.option("header", True)
        return (read.schema(schema) if schema else read.option("inferSchema", True)).csv(path)
    read = spark.read.option("multiLine", True)
    if schema:
        read = read.schema(T.StructType([T.StructField("rows", T.ArrayType(schema))]))
    return read.json(path).selectExpr("inline(rows)")


def read_run_records(spark: SparkSession, path: str, schema: str | T.StructType, pattern: str = "*.json") -> DataFrame:
    """One record a file whose name fits the pattern; broken files are skipped."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", pattern).schema(full).json(path)
    return raw.where("_corrupt_record IS NULL").drop("_corrupt_record")


def write_texts(df: DataFrame, root: str, tasks: int = 64) -> None:
    """df (name, value) as a file root/name for each row; rows are dealt to a fixed number of tasks, since small texts would else share one.

    A text is written beside its place and moved there, so an attempt that ends early leaves no part of it.
    """

    def store(rows: Iterator[Row]) -> None:
        fs, at = _at(root)
        fs.create_dir(at)
        for r in rows:
            part = f"{at}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part, compression=None) as f:
                f.write(r["value"].encode())
            fs.move(part, f"{at}/{r['name']}")

    df.select("name", "value").repartition(tasks, "name").foreachPartition(store)


def write_heatmaps(df: DataFrame, path: str, tag: str) -> None:
    """Maps (center, row, col, heat) under tag and month; readers prune by both."""
    df.withColumn("tag", F.lit(tag)).withColumn("month", F.date_format("center", "yyyy-MM")).repartition("month").write.mode("append").partitionBy("tag", "month").parquet(path)


def flatten_report(df: DataFrame, sections: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, section, field, value: the leaves of nested columns by path (`a.b[0]`); an empty list is `[]`."""

    def leaves(c, kind: T.DataType, path):  # noqa: ANN001, ANN202
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(c[f.name], f.dataType, F.concat(path, F.lit(("." if path is not ROOT else "") + f.name)) if path is not ROOT else F.lit(f.name))]
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
                text = F.to_json(c)
                return [F.array(F.struct(path.alias("field"), text.alias("value")))]
            items = F.transform(c, lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("field"), x.cast("string").alias("value")))
            return [F.when(F.size(c) == 0, F.array(F.struct(path.alias("field"), F.lit("[]").alias("value")))).otherwise(items)]
        return [F.array(F.struct(path.alias("field"), c.cast("string").alias("value")))]

    ROOT = F.lit("")
    kind = "array<struct<section:string,field:string,value:string>>"
    named = lambda s: F.transform(F.concat(*leaves(F.col(s), df.schema[s].dataType, ROOT)), lambda x: F.struct(F.lit(s).alias("section"), x["field"].alias("field"), x["value"].alias("value")))
    found = F.concat(*(F.coalesce(named(s), F.array().cast(kind)) for s in sections))  # one pass over df for all sections
    return df.select(*keys, F.explode(found).alias("x")).select(*keys, "x.section", "x.field", "x.value")
