"""Line dedup by a log-template tree.

Lines (cut at \\n) become tokens at ASCII white space; tokens with digits are variable from the start. A tree of
fixed depth leads each line by its token count and its first LEADING tokens to a leaf. Within a leaf, lines join the
template they agree with in the largest share of positions, at least `agree`; positions that differ become
variable. A template found in at least `min_docs` different documents recurs, and its lines are dropped.

Lines of one template share many of their tokens, so they share one of their few rarest (`Probes`): a line is compared only with
templates whose first line it shares such a token with, and what many lines of a leaf have in common, an opening or a
frequent word, brings none of them together. A leaf with more than LEAF different lines is cut into the connected components of its
lines, two of which are linked where they share such a token. A line's template depends on lines of its own
component only, so the templates are those of the whole leaf, whatever LEAF is. A component is one task, which
holds its templates but not its lines; lines that are otherwise unlike are components of their own. Equal lines are
one row with a count before they reach a leaf.

A document all of whose lines recur loses them all. With `spare_copies` it keeps its text instead: it is a copy as a
whole and is left to document dedup, so no document is emptied.

Blank lines are never dropped and never counted. Null and empty texts stay as they are; very long texts and lines are
read whole. Rows that share a doc_id are one document when documents are counted, and so are all rows without doc_id;
each row loses its own lines. Of templates that agree equally the oldest is joined; lines come by the number of rows that hold
them, then by hash. An empty table gives no rows. All columns are kept but n_lines and n_dropped, which are replaced; n_chars is
set to the new length where the table has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import release, written

LEADING = 3
LEAF = 1000
VARIABLE = "<*>"
_DIGIT = re.compile(r"[0-9]")
#: What str.split() cuts at beside ASCII white space.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TOKEN = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def tokens(line: str) -> list[str]:
    parts = _TOKEN.findall(line) if _OTHER_SPACE.search(line) else line.split()
    return [VARIABLE if _DIGIT.search(t) else t for t in parts] if _DIGIT.search(line) else parts


def _number(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)


def keys(parts: list[str]) -> list[int]:
    """Hashes of the whole line and of its path to a leaf."""
    return [_number("\0".join(parts)), _number(f"{len(parts)}\0" + "\0".join(parts[:LEADING]))]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_id, text -> a row for each different line of a text, with its places."""
    for b in batches:
        for i in range(0, b.num_rows, 100):
            part = b.slice(i, 100)
            row, made, places = [], [], []
            for k, text in enumerate(part.column(2).to_pylist()):
                at: dict[str, list[int]] = {}
                for n, line in enumerate((text or "").split("\n")):
                    t = tokens(line)
                    if t:
                        at.setdefault("\0".join(t), []).append(n)
                for joined, p in at.items():
                    row.append(k)
                    made.append(keys(joined.split("\0")))
                    places.append(p)
            columns = [pa.array([m[j] for m in made], pa.int64()) for j in range(2)]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)), *columns, pa.array(places, pa.list_(pa.int32()))], ["doc_id", "text_id", "line", "leaf", "places"])


class Probes:
    """The tokens of a line, by place, of which two lines that agree must share one.

    All lines of a leaf agree in their leading tokens, so a line must agree with a template in so many (`need`) of the n behind them. If two
    lines share that many of theirs, each in one order that holds for all lines, they share one of their first n - need + 1; the order
    is by rising number of lines in the leaf. A template only loses tokens of its first line, so a line joins none whose first
    line it shares no probe with. A variable token agrees with nothing.
    """

    #: The probe of lines that agree with all others of their leaf.
    ANY = (-1, "")

    def __init__(self, agree: float, leading: int = LEADING):
        self.agree, self.leading = agree, leading

    def of(self, parts: list[str]) -> tuple[list[tuple[int, str]], int]:
        """A line's tokens behind the leading ones, and how many of the rarest are its probes."""
        size = len(parts)
        least = next(n for n in range(1, size + 2) if n / size >= self.agree or n > size)
        need = least - (min(size, self.leading) - parts[: self.leading].count(VARIABLE))
        if need <= 0:
            return [self.ANY], 1
        found = [(i, t) for i, t in enumerate(parts[self.leading :], self.leading) if t != VARIABLE]
        return found, max(0, len(found) - need + 1)


class Templates:
    """The templates of lines with equal token counts and leading tokens, in the order the lines come."""

    def __init__(self, agree: float):
        self.agree = agree
        self.made: list[tuple[int, list[str]]] = []
        self.at: dict[object, list[int]] = {}

    def of(self, name: int, line: list[str], probes: list) -> int:
        """The name of the first line of the template that the line joins or makes."""
        best, share = -1, 0.0
        for k in sorted({k for x in probes for k in self.at.get(x, ())}):
            s = sum(a == b and a != VARIABLE for a, b in zip(self.made[k][1], line, strict=True)) / len(line)
            if s > share:
                best, share = k, s
        if best >= 0 and share >= self.agree:
            first, template = self.made[best]
            self.made[best] = (first, [a if a == b else VARIABLE for a, b in zip(template, line, strict=True)])
            return first
        for x in probes:
            self.at.setdefault(x, []).append(len(self.made))
        self.made.append((name, line))
        return name


def _of_leaf(lines: list[tuple[int, list[str]]], agree: float, leading: int = LEADING) -> list[tuple[int, int]]:
    """(name, line) of one leaf in order -> (name, template); the tokens are counted here."""
    probes = Probes(agree, leading)
    found = [probes.of(parts) for _, parts in lines]
    often: dict[tuple[int, str], int] = {}
    for tokens_, _ in found:
        for x in tokens_:
            often[x] = often.get(x, 0) + 1
    made = Templates(agree)
    return [(name, made.of(name, parts, sorted(tokens_, key=lambda x: (often[x], x))[:n])) for (name, parts), (tokens_, n) in zip(lines, found)]


def templates(lines: list[list[str]], agree: float, leading: int = 0) -> list[int]:
    """For each line (equal token counts, and equal leading tokens), the index of the first line of its template."""
    return [t for _, t in _of_leaf(list(enumerate(lines)), agree, leading)]


def _texts(batches: Iterator[pa.RecordBatch], agree: float) -> Iterator[pa.RecordBatch]:
    """text, asked (leaf, line, n, place, large) -> leaf, line, n, the line's tokens and, in large leaves, hashes of those that may be probes and their number."""
    probes = Probes(agree)
    for b in batches:
        out: dict[str, list] = {"leaf": [], "line": [], "n": [], "tokens": [], "found": [], "probes": []}
        for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            lines = (text or "").split("\n")
            for a in asked:
                parts = tokens(lines[a["place"]])
                found, n = probes.of(parts) if a["large"] else (None, None)
                found = None if found is None else [_number(f"{a['leaf']}\0{i}\0{x}") for i, x in found]
                for k, v in zip(out, (a["leaf"], a["line"], a["n"], "\0".join(parts), found, n), strict=True):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _grouped(batches: Iterator[pa.RecordBatch], agree: float) -> Iterator[pa.RecordBatch]:
    """Lines sorted by leaf -> line, template (the hash of its first line). Lines without probes are a small leaf, and held until it ends."""
    now, made, held = None, {}, {}

    def batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["line", "template"])

    for b in batches:
        found = []
        for leaf, line, text, probes in zip(*(b.column(k).to_pylist() for k in ("leaf", "line", "tokens", "probes")), strict=True):
            if leaf != now:
                for lines in held.values():
                    found += _of_leaf(lines, agree)
                now, made, held = leaf, {}, {}
            parts = text.split("\0")
            # a leaf holds several paths only by a clash of hashes
            path = (len(parts), *parts[:LEADING])
            if probes is None:
                held.setdefault(path, []).append((line, parts))
                continue
            if path not in made:
                made[path] = Templates(agree)
            found.append((line, made[path].of(line, parts, probes)))
        yield batch(found)
    yield batch([x for lines in held.values() for x in _of_leaf(lines, agree)])


def _linked(links: DataFrame) -> DataFrame:
    """node and component of the lines that share a key (line, key)."""
    several = links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return components(links.join(several, "key"), "line", "key")


def _cut(fetched: DataFrame) -> DataFrame:
    """fetched with probes (null in small leaves), and the component in place of the leaf where the leaf is large.

    Lines that agree in two tokens or more also share two of their first probes and one: where single tokens hold more than LEAF lines
    together, pairs of tokens link them instead, so chance likenesses don't.
    """
    columns = ["leaf", "line", "n", "tokens", "probes"]
    small = fetched.where("found IS NULL").select("leaf", "line", "n", "tokens", F.lit(None).cast("array<long>").alias("probes"))
    large = fetched.where("found IS NOT NULL")
    if large.isEmpty():
        return small
    spread = large.select("line", F.col("probes").alias("k"), F.size("found").alias("size"), F.explode("found").alias("token"))
    often = spread.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    ranked = spread.join(often, "token").groupBy("line", "k", "size").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("x"))  # a line's own tokens
    rare = written(ranked.selectExpr("line", "k", "size", "transform(slice(x, 1, k + 1), t -> t.token) AS x"))
    release(fetched.sparkSession)
    parts = written(_linked(rare.select("line", F.explode(F.expr("slice(x, 1, k)")).alias("key"))))
    crowded = rare.where("k < size").join(parts, rare["line"] == parts["node"]).select("line", "component", "x")
    most = crowded.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF).select("component")
    pairs = F.expr("array_distinct(flatten(transform(x, (a, i) -> transform(slice(x, i + 2, size(x)), b -> xxhash64(a, b)))))")
    finer = crowded.join(most, "component").select("line", F.explode(pairs).alias("key"))
    if not most.isEmpty():
        again = written(_linked(finer)).withColumnsRenamed({"node": "line", "component": "finer"})
        apart = finer.select("line").distinct().join(again, "line", "left").select(F.col("line").alias("node"), F.coalesce("finer", "line").alias("finer"))
        parts = parts.join(apart, "node", "left").select("node", F.coalesce("finer", "component").alias("component"))
    cut = large.drop("probes").join(rare.selectExpr("line", "slice(x, 1, k) AS probes"), "line", "left").join(parts.withColumnRenamed("node", "line"), "line", "left")
    cut = cut.withColumn("leaf", F.coalesce("component", "line")).withColumn("probes", F.coalesce("probes", F.array().cast("array<long>")))
    return small.unionByName(cut.select(*columns))


def same_text(texts: DataFrame) -> Column:
    """texts (doc_id, text_id) against __id and __text_id."""
    return texts["doc_id"].eqNullSafe(F.col("__id")) & (texts["text_id"] == F.col("__text_id"))


def recurring(docs: DataFrame, min_docs: int = 10, agree: float = 0.7, column: str = "text") -> DataFrame:
    """doc_id, text_id (a hash of the text) and places (array<int>) of the lines whose template recurs."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(column).alias("text_id"), F.col(column).alias("text"))
    found = written(texts.mapInArrow(_found, f"doc_id {kind}, text_id long, line long, leaf long, places array<int>"))
    kinds = found.groupBy("line", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_id", F.col("places")[0].alias("place"))).alias("e"))
    kinds = written(kinds.selectExpr("line", "leaf", "n", "e.doc_id", "e.text_id", "e.place"))
    release(spark)
    sizes = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("docs"))
    # a leaf that too few documents reach has no recurring template
    routed = written(kinds.join(sizes.where(F.col("docs") >= min_docs), "leaf").select("line", "n", "doc_id", "text_id", "place", "leaf", "kinds"))
    release(spark)
    asked = routed.where("kinds > 1").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("leaf", "line", "n", "place", (F.col("kinds") > LEAF).alias("large"))).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "__id", "text_id": "__text_id"})
    fetched = texts.join(asked.hint("merge"), same_text(texts)).select("text", "asked").mapInArrow(lambda b: _texts(b, agree), "leaf long, line long, n long, tokens string, found array<long>, probes int")
    fetched = written(fetched.dropDuplicates(["leaf", "line"]))
    release(spark)
    cut = _cut(fetched)
    grouped = cut.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line").mapInArrow(lambda b: _grouped(b, agree), "line long, template long")
    grouped = written(grouped.unionByName(routed.where("kinds = 1").select("line", F.col("line").alias("template"))))
    counts = found.join(grouped, "line").select("template", "doc_id").groupBy("template").agg(F.count_distinct(F.struct("doc_id")).alias("docs")).where(F.col("docs") >= min_docs)
    drop = written(grouped.join(counts, "template").select("line"))
    return written(found.join(drop, "line").groupBy("doc_id", "text_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")))


def without_recurring(docs: DataFrame, min_docs: int = 10, agree: float = 0.7, column: str = "text", spare_copies: bool = False) -> DataFrame:
    """docs with the recurring lines taken out of column, and n_lines (not blank) and n_dropped."""
    places = recurring(docs, min_docs, agree, column)
    release(docs.sparkSession)
    text = f"`{column}`"
    blank = r"(?s)^[ \\t\\n\\x0B\\f\\r]*$"
    places = places.withColumnsRenamed({"doc_id": "__id", "text_id": "__text_id", "places": "__at"}).hint("merge")
    out = docs.drop("n_lines", "n_dropped")
    out = out.join(places, out["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(out[column]) == F.col("__text_id")), "left")
    out = out.withColumn("n_lines", F.expr(f"coalesce(CAST(size(filter(split({text}, '\\n', -1), x -> NOT x RLIKE '{blank}')) AS BIGINT), 0L)"))
    out = out.withColumn("n_dropped", F.expr(f"CASE WHEN __at IS NULL{' OR size(__at) >= n_lines' if spare_copies else ''} THEN 0L ELSE CAST(size(__at) AS BIGINT) END"))
    out = out.withColumn(column, F.expr(f"CASE WHEN n_dropped > 0 THEN array_join(filter(split({text}, '\\n', -1), (x, i) -> NOT array_contains(__at, i)), '\\n') ELSE {text} END"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length(column).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
