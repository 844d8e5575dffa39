"""Small column functions: timestamps as text, safe numbers, fingerprints, tags, policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = r"^\d{4}-\d{2}-\d{2}_\d{2}$"
UI_STAMP = r"^\d{4}-\d{2}-\d{2}-\d{2}:\d{2}$"


def normalize_timestamp(c: Column) -> Column:
    """`yyyy-MM-dd_HH` from that form or from `yyyy-MM-dd-HH:mm`; null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(STAMP), t).when(t.rlike(UI_STAMP), F.concat(F.substring(t, 1, 10), F.lit("_"), F.substring(t, 12, 2)))


def ui_timestamp(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 10), F.lit("-"), F.substring(c, 12, 2), F.lit(":00"))


def month_key(c: Column) -> Column:
    return F.substring(c, 1, 7)


def filter_month(df: DataFrame, month: str | None, column: str = "timestamp") -> DataFrame:
    """Rows of one month (`yyyy-MM`); `all`, `*` or none keep everything."""
    return df if not month or month.lower() in ("all", "*") else df.where(F.col(column).startswith(month))


def stamp(c: Column) -> Column:
    """The text form of a timestamp."""
    return F.date_format(c, "yyyy-MM-dd_HH")


def path_facets(path: Column) -> tuple[Column, Column]:
    """The first timestamp among a path's parts and its stem (or an empty text), and its source."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    stamps = F.filter(F.concat(parts, F.array(stem)), lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}_\d{2}$"))
    head = parts[0]
    source = F.when(head == "processed", F.when(F.size(parts) > 1, F.concat(F.lit("processed/"), parts[1])).otherwise("processed")).otherwise(head)
    return F.coalesce(F.get(stamps, F.lit(0)), F.lit("")), source


def safe_number(c: Column, default: float = 0.0) -> Column:
    """A finite double, else default."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def route_safety(distance: Column, caution: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - caution / F.greatest(distance, F.lit(1e-9)))


def fingerprint(columns: Sequence[Column], n: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, n)


#: Words of a detail text and the tag they stand for.
TAG_WORDS = (
    ("data_missing", ("missing", "not found", "no data", "no timestamp", "unavailable")),
    ("threshold", ("threshold", "budget", "constraint", "chance", "cvar")),
    ("boundary", ("boundary", "outside", "out of bounds", "blocked", "land")),
    ("model_uncertainty", ("uncertainty",)),
)


def root_cause_tags(detail: Column, usage: Column, adjusted: Column, uncertainty: Column, degraded: Column, threshold: float = 0.2) -> Column:
    """Tags in fixed order from words and numbers; `unknown` if there are none."""
    d = F.lower(F.coalesce(detail, F.lit("")))
    flags = {"threshold": safe_number(usage) > 1, "boundary": F.coalesce(adjusted, F.lit(False)), "model_uncertainty": safe_number(uncertainty) >= threshold}
    made = []
    for tag, words in TAG_WORDS:
        hit = flags.get(tag, F.lit(False))
        for w in words:
            hit = hit | d.contains(w)
        made.append(F.when(hit, F.lit(tag)))
    tags = F.array_compact(F.array(*made, F.when(degraded, F.lit("planner_degradation"))))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unknown")))


#: Caution mode -> caution penalty, corridor reward per bias, penalty beside blocked cells.
POLICIES = {"tie_breaker": (0.22, 0.10, 0.06), "budget": (0.35, 0.06, 0.08), "minimize": (0.55, 0.03, 0.10)}


def policy_scalars(mode: Column, bias: Column) -> tuple[Column, Column, Column]:
    out = []
    for k in range(3):
        c = F.lit(0.0)
        for name, values in POLICIES.items():
            c = F.when(mode == name, F.lit(values[k])).otherwise(c)
        out.append(c)
    return out[0], F.greatest(bias, F.lit(0.0)) * out[1], out[2]


#: A prime modulus; squares of what is below it fit in 64 bits.
PRIME = 2147483647


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from whole numbers and a seed, by squares modulo a prime: the same in any engine with 64-bit integers."""
    x = F.lit(seed % PRIME).cast("long")
    for p in parts:
        x = (x * 48271 + F.pmod(p.cast("long"), F.lit(PRIME))) % PRIME
        x = x * (x + 69621) % PRIME
    return x * (x + 48271) % PRIME / float(PRIME)


def uniform_sql(*parts: str, seed: int = 0) -> str:
    """uniform() as SQL text; the parts are not negative."""
    x = str(seed % PRIME)
    for p in parts:
        x = f"((CAST({x} AS BIGINT) * 48271 + CAST({p} AS BIGINT) % {PRIME}) % {PRIME})"
        x = f"({x} * ({x} + 69621) % {PRIME})"
    return f"({x} * ({x} + 48271) % {PRIME} / {PRIME}e0)"
