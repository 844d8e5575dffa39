"""Licence scans with built-in functions only: ordered signature rules over whole texts.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased; a text is
read as its words with one space between them. Hundreds of regular expressions, written by hand (see
licence_rules.py), each have keywords, one of which must be among the words before the expression is tried, a
priority and a confidence. A detection that lies inside another one of equal or higher priority is suppressed (of two on the
same words, the one of lower priority, then of the later rule). Everything happens inside a row: nothing is moved
between machines.

Base phrases are reported whatever the rules find, at all their places.

Nulls count as empty; empty texts have no words and no labels. In very long texts the places of a rule are read
off the words in one pass, and suppression works in chunks of about the square root of the number of
detections. Repeated rows and rows without doc_id are scanned alike; an empty table gives no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_rules import RULES

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Not ASCII, but lower() would make ASCII letters of them: each with a letter that stays outside ASCII.
KELVIN, DOTTED_I = ("\u212a", "\u0138"), ("\u0130", "\u0131")
OPEN, CLOSE = "\x01", "\x03"

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def signatures() -> list[tuple[str, int, float, tuple[str, ...], str]]:
    """The ordered rules: label, priority, confidence, keywords, expression."""
    lines = [x.split("; ") for x in RULES.strip().split("\n") if not x.startswith("#")]
    return [(label, int(priority), float(confidence), tuple(keywords.split("|")), expression) for label, priority, confidence, keywords, expression in lines]


def normal(column: str) -> Column:
    """All words of a text, each after one space."""
    text = F.coalesce(F.col(column), F.lit(""))
    for letter, other in (KELVIN, DOTTED_I):
        text = F.replace(text, F.lit(letter), F.lit(other))
    return F.rtrim(F.regexp_replace(F.concat(F.lit(" "), F.lower(text)), NOT_WORD, " "))


def marked(column: str, present: str) -> Column:
    """array of (id, text) of the rules that fit: the text with OPEN before and CLOSE behind each place of the rule.

    present has the keywords that are among the words; without any, no rule is tried.
    """
    norm = F.col(column)
    by_keywords: dict[tuple[str, ...], list[Column]] = {}
    for i, (_, _, _, keywords, expression) in enumerate(signatures()):
        text = F.regexp_replace(norm, F.lit(f" ({expression})(?= |$)"), F.lit(f" {OPEN}$1{CLOSE}"))
        by_keywords.setdefault(keywords, []).append(F.struct(F.lit(i).alias("id"), text.alias("text")))
    none = F.array().cast("array<struct<id:int,text:string>>")
    tried = F.flatten(F.array(*(F.when(F.arrays_overlap(F.col(present), constants(k)), F.array(*rules)).otherwise(none) for k, rules in by_keywords.items())))
    return F.when(F.size(present) == 0, none).otherwise(F.filter(tried, lambda f: F.contains(f["text"], F.lit(OPEN))))


def constants(values: Sequence[object]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def suppressed(hits: str, priorities: int) -> Column:
    """The hits (start, back = -end, low = -priority, id; in that order) that no other one suppresses.

    Whatever contains a hit comes before it, so the largest end so far of each priority decides: of all
    chunks before, and of the hits before it in its own chunk.
    """
    chunk = f"CAST(ceil(sqrt(size({hits}))) AS INT)"
    chunks = f"transform(sequence(0, CAST(ceil(size({hits}) / {chunk}) AS INT) - 1), c -> slice({hits}, c * {chunk} + 1, {chunk}))"
    ends = f"transform(chunks, h -> transform(sequence(1, {priorities}), p -> array_max(transform(filter(h, d -> -d.low >= p), d -> -d.back))))"
    before = f"transform(sequence(1, {priorities}), p -> array_max(transform(slice(tops, 1, c), t -> t[p - 1])))"
    free = "filter(h, (d, i) -> NOT coalesce(b[-d.low - 1] >= -d.back, false) AND NOT exists(slice(h, 1, i), e -> e.low <= d.low AND e.back <= d.back))"
    kept = f"flatten(transform(chunks, (h, c) -> transform(array({before}), b -> {free})[0]))"
    return F.expr(f"CASE WHEN size({hits}) > 0 THEN transform(array({chunks}), chunks -> transform(array({ends}), tops -> {kept})[0])[0] ELSE {hits} END")


def scanned(docs: DataFrame, column: str = "text", base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections (rule, label, first and last word)."""
    rules = signatures()
    out = docs.select("doc_id", normal(column).alias("norm"))
    spaces = "length({0}) - length(replace({0}, ' ', ''))"
    out = out.withColumn("n_words", F.expr(f"CAST({spaces.format('norm')} AS BIGINT)"))
    # the pieces between a phrase's places: words before the first, words after the last
    parts = ", ".join(f"named_struct('label', '{label}', 'size', {phrase.count(' ') + 1}, 'pieces', CASE WHEN contains(norm, '{phrase}') THEN split(norm, r' {phrase}(?= |$)', -1) ELSE array('') END)" for phrase, label in base)
    out = out.withColumn("parts", F.expr(f"filter(array({parts}), p -> size(p.pieces) > 1)"))
    out = out.withColumn("first_word", F.expr(f"CAST(array_min(transform(parts, p -> {spaces.format('p.pieces[0]')})) AS BIGINT)"))
    out = out.withColumn("last_word", F.expr(f"CAST(array_max(transform(parts, p -> n_words - p.size - ({spaces.format('p.pieces[size(p.pieces) - 1]')}))) AS BIGINT)"))
    out = out.withColumn("n_base", F.expr("CAST(aggregate(parts, 0, (a, p) -> a + size(p.pieces) - 1) AS BIGINT)"))
    out = out.withColumn("base", F.expr("transform(parts, p -> p.label)"))
    keywords = sorted({k for _, _, _, some, _ in rules for k in some})
    out = out.withColumn("present", F.array_intersect(F.split("norm", " "), constants(keywords)))
    out = out.withColumn("fits", marked("norm", "present"))
    out = out.withColumn("low", constants([-p for _, p, _, _, _ in rules])).withColumn("label", constants([x[0] for x in rules])).withColumn("sure", constants([x[2] for x in rules]))
    places = "filter(transform(words, (w, i) -> IF({0}(w, '{1}'), i - 1, NULL)), x -> x IS NOT NULL)"
    zipped = f"zip_with({places.format('startswith', OPEN)}, {places.format('endswith', CLOSE)}, (s, e) -> named_struct('start', s, 'back', -e, 'low', low[f.id], 'id', f.id))"
    spans = f"flatten(transform(fits, f -> transform(array(split(f.text, ' ')), words -> {zipped})[0]))"
    out = out.withColumn("hits", F.expr(f"array_sort({spans})"))
    out = out.withColumn("kept", suppressed("hits", max(p for _, p, _, _, _ in rules)))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.expr("array_join(array_sort(array_distinct(base)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base, transform(kept, k -> label[k.id])))), ',')").alias("labels"),
        F.expr("1D - aggregate(array_distinct(transform(kept, k -> sure[k.id])), 1D, (a, c) -> a * (1D - c))").alias("score"),
        F.expr("transform(kept, k -> named_struct('rule', k.id, 'label', label[k.id], 'first_word', k.start, 'last_word', -k.back))").alias("detections"),
    )
