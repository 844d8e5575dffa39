"""Exact order statistics and quantiles of keys of any size, by refinement of histograms: sums by key, and a sort of few rows at the end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import scratch

BINS = 4096
#: A bin of at most so many rows is sorted.
SMALL = 65_536


def _binade(v: Column) -> Column:
    """A number's sign and power of two as one whole number that grows with it."""
    power = F.greatest(F.least(F.floor(F.log2(F.abs(v))), F.lit(1024)), F.lit(-1075)).cast("int")
    return F.when(v == 0, 0).when(F.abs(v) == float("inf"), F.signum(v).cast("int") * 2200).when(v > 0, 1100 + power).otherwise(-1100 - power)


def _keyed(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _histogram(binned: DataFrame) -> DataFrame:
    """__k, __b, n, low, high, written: a few thousand rows a key."""
    at = scratch(binned.sparkSession, "bins")
    binned.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).write.parquet(at)
    return binned.sparkSession.read.parquet(at)


def _holding(histogram: DataFrame, ranks: DataFrame) -> DataFrame:
    """The bin in which each rank (__k, __asked, __rank) lies, with __rank inside it."""
    upto = F.sum("n").over(W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    met = histogram.withColumn("upto", upto).join(ranks, "__k").where((F.col("__rank") < F.col("upto")) & (F.col("__rank") >= F.col("upto") - F.col("n")))
    return met.select("__k", "__asked", "__b", (F.col("__rank") - F.col("upto") + F.col("n")).alias("__rank"), "n", "low", "high")


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Column], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """keys, n (rows with a value), rank (from 0, ascending) and found, the value of that rank; ranks gives an array of ranks from a column of n.

    A key's values are counted by sign and power of two, then the bin that holds a rank is cut into `bins` of equal width
    between its own ends, again and again, until it has one value or at most `small` rows, which are sorted. So a key with a third of
    all rows costs counts only. Null values and ranks outside are left out, NaN counts as the largest number. What may still
    hold a rank is written after each round.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    now = rows.select(_keyed(keys).alias("__k"), F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v).alias("__v")).where("__v IS NOT NULL")
    now = now.withColumn("__b", _binade(F.col("__v")))
    histogram = _histogram(now)
    totals = histogram.groupBy("__k").agg(F.sum("n").alias("__n"))
    left = totals.select("__k", F.explode(F.array_distinct(ranks(F.col("__n")))).alias("__asked")).withColumn("__rank", F.col("__asked"))
    done, depth = [], 0
    while True:
        met = _holding(histogram, left)
        done.append((depth, met.where("low = high").select("__k", "__asked", F.col("low").alias("found"))))
        open_ = met.where("low < high")
        # a bin is a key of its own from here on
        bin_ = F.struct(F.col("__k").alias("of"), F.col("__b").alias("bin"))
        wanted = open_.groupBy("__k", "__b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n"))
        inside = now.join(wanted, ["__k", "__b"]).withColumn("__k", bin_)
        left = open_.select(bin_.alias("__k"), "__asked", "__rank")
        depth, most = depth + 1, wanted.agg(F.max("n")).first()[0]
        if most is None:
            break
        if most <= small:
            place = (F.row_number().over(W.partitionBy("__k").orderBy("__v")) - 1).cast("long")
            done.append((depth, inside.withColumn("__rank", place).join(left, ["__k", "__rank"]).select("__k", "__asked", F.col("__v").alias("found"))))
            break
        part = F.least(F.floor((F.col("__v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
        at = scratch(spark, "ranks")
        inside.select("__k", "__v", part.alias("__b")).write.parquet(at)
        now = spark.read.parquet(at)
        histogram = _histogram(now)
    out = None
    for depth, found in done:
        own = F.col("__k")
        for _ in range(depth):
            own = own["of"]
        part = found.select(own.alias("__k"), "__asked", "found")
        out = part if out is None else out.unionByName(part)
    return out.join(totals, "__k").select(*(F.col("__k")[c].alias(c) for c in keys), F.col("__n").alias("n"), F.col("__asked").alias("rank"), "found")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """keys and for each name of qs the exact quantile of value, interpolated between its two neighbours; no row without values."""
    ends = lambda n: F.array(*[f((n - 1) * F.lit(q)) for q in qs.values() for f in (F.floor, F.ceil)])
    found = order_statistics(rows, keys, value, ends, bins, small)

    def made(q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(q)
        low, high = (F.max(F.when(F.col("rank") == f(at), F.col("found"))) for f in (F.floor, F.ceil))
        at = F.max(at)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)  # equal neighbours exactly

    return found.groupBy(*keys).agg(*(made(q).alias(n) for n, q in qs.items())).where(F.coalesce(*qs).isNotNull())
