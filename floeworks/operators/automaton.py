"""Finite automata over long sequences, as a prefix scan: transition maps of blocks are composed, so no sequence is one fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128


def _at(values: Column, i: Column) -> Column:
    return F.element_at(values, i + 1)


def _packed(rows: DataFrame, key: str, block: int) -> DataFrame:
    """__i and __map of each row of a key -> __block and __items, at most block in order."""
    return rows.groupBy(key, F.floor(F.col("__i") / block).cast("long").alias("__block")).agg(F.array_sort(F.collect_list(F.struct("__i", "__map"))).alias("__items"))


def scan(rows: DataFrame, key: str, index: str, symbol: Column, table: Sequence[Sequence[int]], start: int, block: int = BLOCK) -> DataFrame:
    """rows with `state`: the state of an automaton before each row of a key, in the order of index.

    table has for each symbol (from 0) the next state of every state (from 0). index counts the rows of a key from 0 without
    gaps. Rows of a key are cut into blocks of index; each block's map, from the state before it to the one behind it, is composed from those
    of its rows, then the maps of blocks in the same way until a key has one; states go back down the same levels. A task
    holds one block of one key. Rows without key or index have no state.
    """
    n = len(table[0])
    identity = F.array(*map(F.lit, range(n)))
    maps = F.array(*[F.array(*map(F.lit, t)) for t in table])
    level = rows.where(F.col(key).isNotNull() & F.col(index).isNotNull()).select(key, F.col(index).cast("long").alias("__i"), _at(maps, symbol).alias("__map"))
    top = level.agg(F.max("__i")).first()[0] or 0
    packed = [_packed(level, key, block)]
    while top >= block:
        whole = F.aggregate("__items", identity, lambda m, x: F.transform(m, lambda s: _at(x["__map"], s)))
        packed.append(_packed(packed[-1].select(key, F.col("__block").alias("__i"), whole.alias("__map")), key, block))
        top //= block
    states = packed[-1].select(key, "__block", F.lit(start).alias("__state"))
    for level in reversed(packed):
        # the states before the items of each block
        before = F.aggregate(
            "__items",
            F.struct(F.col("__state").alias("s"), F.array().cast("array<struct<i:bigint,s:int>>").alias("out")),
            lambda a, x: F.struct(_at(x["__map"], a["s"]).alias("s"), F.array_append(a["out"], F.struct(x["__i"].alias("i"), a["s"].alias("s"))).alias("out")),
            lambda a: a["out"],
        )
        found = level.join(states, [key, "__block"]).select(key, F.explode(before).alias("x"))
        states = found.select(key, F.col("x.i").alias("__block"), F.col("x.s").alias("__state"))
    found = states.select(F.col(key).alias("__key"), F.col("__block").alias("__at"), F.col("__state").alias("state"))
    return rows.join(found, (rows[key] == F.col("__key")) & (rows[index] == F.col("__at")), "left").drop("__key", "__at")
