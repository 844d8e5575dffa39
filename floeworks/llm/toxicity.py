"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, drops zero-width characters and combining accents (letters that have an accent of their own stay, as
languages tell them apart), turns look-alike letters of other scripts and full-width letters into Latin ones, and reads digits and signs as the letters they stand for: between letters, before a run of
three letters, and `$` behind one.

The lexicon joins a short base list with entries learnt from labelled documents: whole words and word
beginnings (stems) of 4 to 6 letters, each counted once a document and kept where the lower confidence
bound of their log odds between toxic and other documents is high enough. Each word of a text counts once,
with the weight of its best entry; hits inside an exception phrase do not count. The score is a logistic
function of the summed weight and of the summed weight per word.

Learning uses at most `sample` labelled rows (the first by hash of doc_id, copies of one text once), counts
in Spark, and brings the lexicon (entries that at least a hundredth of the toxic ones among these rows hold) and the
two numbers of each sampled row to the driver. Everything else covers all rows.

Null or empty texts have no hits and get the score of a text without hits; very long ones are matched whole. Repeated
rows, rows without doc_id and equal texts score alike. A document labelled twice counts with its larger label. A score
equal to the threshold predicts 1. Without usable labels (none, or one class) the base list is used with fixed
coefficients. An empty table gives no rows. Other columns are kept; columns named like an output are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

SAMPLE, STEMS = 20_000, (4, 5, 6)

#: General insults with their weights.
BASE = {
    "idiot": 6.0, "idiots": 6.0, "idiotic": 5.0, "moron": 6.0, "morons": 6.0, "moronic": 5.0, "loser": 6.0, "losers": 6.0, "scum": 6.0, "scumbag": 6.0, "stupid": 5.0, "dumb": 4.0, "dumbass": 6.0,
    "pathetic": 5.0, "worthless": 5.0, "disgusting": 5.0, "trash": 5.0, "clown": 5.0, "imbecile": 6.0, "imbeciles": 6.0, "bastard": 6.0, "bastards": 6.0, "filth": 5.0, "vermin": 5.0,
    "asshole": 6.0, "assholes": 6.0, "bitch": 6.0, "bitches": 6.0, "cretin": 6.0, "dimwit": 6.0, "dipshit": 6.0, "douchebag": 6.0, "fuck": 5.0, "fucking": 5.0, "halfwit": 6.0, "jackass": 6.0, "jerk": 4.0, "lowlife": 6.0,
    "nitwit": 6.0, "parasite": 4.0, "pig": 3.0, "prick": 5.0, "retard": 6.0, "retarded": 6.0, "shithead": 6.0, "slut": 6.0, "twat": 6.0, "wanker": 6.0, "whore": 6.0, "weasel": 3.0,
}

#: Phrases in which such words are harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash talk", "clown fish", "clown car", "circus clown", "clown shoes", "stupid simple", "dumb bell", "dumb bells", "dumb waiter", "dumb terminal", "dumb luck",
    "pathetic fallacy", "not stupid", "not an idiot", "not a moron", "sore loser board", "winner and loser", "winners and losers", "guinea pig", "guinea pigs", "pig iron", "pig farm", "pig farmer", "soda jerk", "jerk chicken", "jerk seasoning", "knee jerk",
    "prick test", "pin prick", "fire retard", "flame retard", "weasel words", "least weasel", "host parasite", "malaria parasite", "parasite load", "vermin control", "pond scum", "soap scum", "line bastard file",
)

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "п": "n",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
}
#: Signs read as letters between letters.
SIGNS = {"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, *range(0x0300, 0x0370)))
_SIGN = re.compile(r"[013457!@$]+")
_WORD = re.compile(r"[^\W\d_]+")


def _read(m: re.Match) -> str:
    """A run of signs as letters, where it stands in a word."""
    t, start, end = m.string, m.start(), m.end()
    before, after = start > 0 and t[start - 1].isalpha(), end < len(t) and t[end].isalpha()
    opens = end - start == 1 and m[0] != "!" and (start == 0 or t[start - 1] in " \t\n\r(\"'") and len(t) > end + 2 and t[end : end + 3].isalpha()
    closes = before and not m[0].strip("$") and (end == len(t) or not t[end].isalnum())
    return "".join(SIGNS[c] for c in m[0]) if before and after or opens or closes else m[0]


def fold(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    return _SIGN.sub(_read, t)


def features(text: str) -> set[str]:
    """The distinct words of a text, and its stems as `stem*`."""
    words = set(_WORD.findall(fold(text)))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Matcher:
    """The lexicon as an automaton."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[float]] = {}
        for entry, weight in lexicon.items():
            key = entry.rstrip("*")
            found.setdefault(key, [0.0, 0.0])[entry.endswith("*")] = weight
        for phrase in EXCEPTIONS:
            found.setdefault(phrase, [0.0, 0.0]).append(1.0)
        for key, values in found.items():
            self.automaton.add_word(key, (len(key), *values))
        self.automaton.make_automaton()

    def score(self, text: str) -> tuple[float, int]:
        """The summed weight of a text's hits, and its number of space-separated words."""
        t = fold(text)
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        n = len(t)
        for end, (length, whole, stem, *phrase) in self.automaton.iter(t):
            start, after = end - length + 1, end + 1
            if start and t[start - 1].isalpha():
                continue
            closed = after >= n or not t[after].isalpha()
            if phrase and closed:
                excused.append((start, after))
            weight = max(whole if closed else 0.0, stem)
            if weight > best.get(start, (0, 0.0))[1]:
                best[start] = (after, weight)
        if excused:
            excused.sort()
            starts, reach = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))
            # how far the spans reach that begin no later than the hit
            best = {s: x for s, x in best.items() if not (k := bisect_right(starts, s)) or reach[k - 1] < x[0]}
        return sum(w for _, w in best.values()), len(t.split())


_matchers: dict[int, Matcher] = {}


def _scores(texts: pa.Array, lexicon: dict[str, float], key: int) -> np.ndarray:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(lexicon)
    m = _matchers[key]
    return np.array([m.score(t.as_py() or "") for t in texts], float).reshape(-1, 2)


def _inputs(x: np.ndarray) -> np.ndarray:
    """Summed weight and summed weight per 100 words (a short text counts as 20 words more), on a log scale."""
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(100 * x[:, 0] / (x[:, 1] + 20))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of an L2-regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, column: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and coefficients from labelled rows (doc_id, label 0/1)."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", F.col(column).alias("text")).join(chosen, "doc_id").where("text IS NOT NULL")
    rows = written(rows.groupBy("text").agg(F.max("y").alias("y")))
    fixed = dict(BASE)
    plain = np.array([-6.0, 1.5, 1.5])
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return fixed, plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[str] = []
            ys: list[int] = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs = features(t)
                found += fs
                ys += [y] * len(fs)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "y": pa.array(ys, pa.int32())})

    n1, n0 = F.col("n1"), F.col("n0")
    counts = rows.select("text", "y").mapInArrow(run, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    odds = F.log((n1 + 0.5) / (n[1] + 1.0)) - F.log((n0 + 0.5) / (n[0] + 1.0))
    low = odds - 1.5 * F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    best = counts.where(n1 >= max(4, n[1] // 100)).withColumn("weight", low).where("weight >= 1.9").select("feature", "weight")
    lexicon = fixed | {r["feature"]: float(r["weight"]) for r in best.collect()}
    seen = with_hits(rows, lexicon, "text").select("weight", "n_words", "y").collect()
    x = np.array([(r["weight"], r["n_words"]) for r in seen], float)
    return lexicon, fit_logistic(_inputs(x), np.array([r["y"] for r in seen], float))


def with_hits(docs: DataFrame, lexicon: dict[str, float], column: str = "text") -> DataFrame:
    """docs without the text, with weight (summed) and n_words."""
    return _applied(docs, column, lexicon, [("weight", T.DoubleType()), ("n_words", T.LongType())], lambda x: [pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int64))])


def with_scores(docs: DataFrame, lexicon: dict[str, float], coefficients: np.ndarray, column: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the text, with score (0 to 1) and predicted (1 from threshold on)."""

    def made(x: np.ndarray) -> list[pa.Array]:
        s = 1 / (1 + np.exp(-_inputs(x) @ coefficients))
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return _applied(docs, column, lexicon, [("score", T.DoubleType()), ("predicted", T.IntegerType())], made)


def _applied(docs: DataFrame, column: str, lexicon: dict[str, float], made: list, arrays) -> DataFrame:  # noqa: ANN001
    names = [n for n, _ in made]
    kept = [f for f in docs.schema.fields if f.name not in {*names, column}]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    key = hash(frozenset(lexicon.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _scores(b.column(0), shared.value, key)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *arrays(x)], [*(f.name for f in kept), *names])

    source = docs.select(F.col(column).alias("__text"), *(F.col(f.name) for f in kept))
    return source.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in made)]))
