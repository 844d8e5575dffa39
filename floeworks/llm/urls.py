"""URL verdicts: rules by host and path, else word segmentation and naive Bayes.

A URL's host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path
goes on up to `?`, `#` or the end. Without `://` (or null) both are empty.

Rules name a host and the beginning of a path and fit that host and its subdomains; the longest fitting
rule wins (then the first given). All other URLs get the verdict of a multinomial naive Bayes over the
words of host and path. Host labels are cut at hyphens and digits and split by a unigram Viterbi search
into the likeliest words, so `freebets` becomes `free bets`; word frequencies come from the titles of all
pages. Words are learnt for each class from the URLs that a rule decides, whose tokens are counted over all pages,
and from a short list of words with fixed counts. How often rules block says nothing about other URLs, so the
two classes count as equally likely, and a URL is blocked only if the odds of its words exceed MARGIN (in nats).
The last host label (com, net) is no token, and tokens that the rules themselves name are none either: they would
only repeat the rules.

The driver and each worker hold the `vocabulary` most frequent words and tokens and the fixed ones. The counts of
all others stay in Spark tables and are joined to the words and tokens that URLs ask for, so every count is used at
every size and `vocabulary` changes no result.

Null and malformed URLs have no tokens, so the method allows them; so does a tie. Very long hosts and paths are read
whole. Repeated rows and rows without page_id are judged alike; an empty table gives no rows. Other columns than
key, url and html are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .shared import written

VOCABULARY, MARGIN = 50_000, 3.0
TEN = math.log(10)

#: Words of blocked and of allowed sites, each counted as SEED_COUNT occurrences.
BLOCK_WORDS = ("adult", "bet", "bets", "casino", "cheap", "escort", "farm", "free", "gambling", "loan", "lottery", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "win", "xxx")
ALLOW_WORDS = ("academy", "archive", "docs", "edu", "gov", "journal", "library", "museum", "news", "research", "school", "science", "university", "wiki")
SEED_COUNT = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]  # verdict, host and path


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule and rule_verdict (null where no rule fits)."""
    out = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last that fits stays
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


class Segmenter:
    """Unigram Viterbi: the split of a string into words of the largest product of probabilities.

    An unknown word is as likely as a tenth of one occurrence, ten times less for each letter.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.logs = {w: math.log(c / self.total) for w, c in counts.items()}
        self.sizes = {len(w) for w in counts}
        self.splits: dict[str, list[str]] = {}
        self.rare: dict[str, int] = {}  # counts of words outside counts that the texts to split contain

    def cost(self, word: str) -> float | None:
        """The log probability of a known word."""
        if word in self.rare:
            return math.log(self.rare[word] / self.total)
        return self.logs.get(word)

    def split(self, text: str) -> list[str]:
        if text not in self.splits:
            if len(self.splits) > 100_000:
                self.splits.clear()
            self.splits[text] = self._split(text)
        return self.splits[text]

    def _split(self, text: str) -> list[str]:
        sizes = sorted(self.sizes | {len(w) for w in self.rare})
        new = -math.log(10 * self.total)
        best, back = [0.0], [0]
        open_, start = -math.inf, 0  # the best split whose last word is unknown, and where that word begins
        for j in range(1, len(text) + 1):
            open_ -= TEN
            if best[j - 1] + new - TEN > open_:
                open_, start = best[j - 1] + new - TEN, j - 1
            score, i = open_, start
            for size in sizes:
                if size > j:
                    break
                known = self.cost(text[j - size : j])
                if known is not None and best[j - size] + known >= score:
                    score, i = best[j - size] + known, j - size
            best.append(score)
            back.append(i)
        words, j = [], len(text)
        while j:
            words.append(text[back[j] : j])
            j = back[j]
        return words[::-1]


def parts(host: str) -> list[str]:
    """The runs of letters of a host's labels but the last."""
    return [part for label in host.split(".")[:-1] for part in re.split(r"[^a-z]+", label) if part]


def tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Host words as `h:word` (labels but the last, segmented) and path words as `p:word` (numbers as `p:0`)."""
    out = [f"h:{w}" for part in parts(host) for w in segmenter.split(part)]
    return out + [f"p:{'0' if t.isdigit() else t}" for t in re.split(r"[^a-z0-9]+", path.translate(str.maketrans(UPPER, LOWER))) if t]


def word_counts(pages: DataFrame, html: str = "html", vocabulary: int = VOCABULARY) -> tuple[dict[str, int], int, DataFrame | None]:
    """Frequencies of the words in all pages' titles and of the fixed words: the most frequent ones, the sum of all, and a table of the others (None: there are none)."""
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"[a-z]+"), F.lit(0))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    fixed = (*BLOCK_WORDS, *ALLOW_WORDS, "www", "blog", "example")
    top, total, rest = most_frequent(counts, "word", F.col("n"), fixed, vocabulary)
    found = Counter({r["word"]: r["n"] for r in top})
    for w in fixed:
        found[w] += SEED_COUNT
    return dict(found), (total or 0) + SEED_COUNT * len(fixed), rest


def most_frequent(counts: DataFrame, key: str, n: Column, fixed: Iterable[str], vocabulary: int) -> tuple[list[Row], int | None, DataFrame | None]:
    """The `vocabulary` rows of the largest n and those of fixed keys, the sum of n, and the other rows (None: there are none)."""
    size = counts.agg(F.count(F.lit(1)).alias("kinds"), F.sum(n).alias("total")).first()
    top = counts.orderBy(n.desc(), key).limit(vocabulary)
    if size["kinds"] <= vocabulary:
        return top.collect(), size["total"], None
    top = written(top.unionByName(counts.where(F.col(key).isin(list(fixed)))).distinct())
    return top.collect(), size["total"], counts.join(F.broadcast(top.select(key)), key, "left_anti")  # vocabulary rows


def with_rare(decided: DataFrame, counts: dict[str, int], rest: DataFrame | None) -> DataFrame:
    """decided with rare: the counts of the words of rest that its host's parts contain."""
    if rest is None:
        return decided.withColumn("rare", F.lit(None).cast("map<string,bigint>"))
    shared = decided.sparkSession.sparkContext.broadcast(frozenset(counts))
    sizes = [r["size"] for r in rest.select(F.length("word").alias("size")).distinct().collect()]  # a number for each length of a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                asked = [(h, w) for h in b.column(0).slice(k, 500).to_pylist() for w in {p[i : i + size] for p in parts(h) for size in sizes for i in range(len(p) - size + 1)} - shared.value]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in asked], pa.string()), pa.array([w for _, w in asked], pa.string())], ["host", "word"])

    asked = decided.select("host").distinct().mapInArrow(run, "host string, word string").join(rest, "word")
    rare = written(asked.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("rare")))
    return decided.join(rare, "host", "left")


def named_tokens(rules: Sequence[Rule]) -> frozenset[str]:
    """The tokens that stand in the rules' hosts and paths."""
    whole = Segmenter({})
    whole.split = lambda text: [text]  # type: ignore[method-assign]
    return frozenset(t for _, text in rules for t in tokens(text[: text.index("/")], text[text.index("/") :], whole))


def learn(decided: DataFrame, words: dict[str, int], total_words: int, rules: Sequence[Rule] = (), vocabulary: int = VOCABULARY) -> tuple[dict, DataFrame | None]:
    """Token weights (log block minus log allow) from the pages with a rule_verdict, counted over all of them, and a table of the weights of rarer tokens."""
    named = named_tokens(rules)
    shared = decided.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Segmenter(shared.value, total_words)
        for b in batches:
            found: Counter[tuple[str, str]] = Counter()
            for host, path, v, rare in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                s.rare = dict(rare or ())
                found.update((t, v) for t in tokens(host, path, s) if t not in named)
            yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in found], pa.string()), "verdict": pa.array([v for _, v in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = decided.where("rule_verdict IS NOT NULL").select("host", "path", "rule_verdict", "rare").mapInArrow(run, "token string, verdict string, n long")
    counts = written(rows.groupBy("token").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow"))))
    total = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("kinds")).first()
    fixed = [f"h:{w}" for w in (*BLOCK_WORDS, *ALLOW_WORDS)]
    found, _, rest = most_frequent(counts, "token", F.col("block") + F.col("allow"), fixed, vocabulary)
    top = {r["token"]: [r["block"], r["allow"]] for r in found}
    kinds = (total["kinds"] or 0) + len(set(fixed) - set(top)) + 1
    sums = [total["block"] or 0, total["allow"] or 0]
    for k, some in enumerate((BLOCK_WORDS, ALLOW_WORDS)):
        for w in some:
            top.setdefault(f"h:{w}", [0, 0])[k] += SEED_COUNT
            sums[k] += SEED_COUNT
    unseen = math.log(1 / (sums[0] + kinds)) - math.log(1 / (sums[1] + kinds))
    weights = {t: math.log((b + 1) / (sums[0] + kinds)) - math.log((a + 1) / (sums[1] + kinds)) for t, (b, a) in top.items()}
    model = {"words": words, "total_words": total_words, "weights": weights, "unseen": unseen, "named": named}
    # what a rarer token weighs more than an unseen one
    return model, None if rest is None else rest.select("token", (F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0)).alias("more"))


def judged(decided: DataFrame, model: dict, rest: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict and block_odds (log odds of block by the model, for every page)."""
    shared = decided.sparkSession.sparkContext.broadcast(model)
    kind = decided.schema[key].dataType.simpleString()
    ask = rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        s = Segmenter(m["words"], m["total_words"])
        for b in batches:
            odds, others = [], []
            for host, path, rare in zip(*(b.column(i).to_pylist() for i in (1, 2, 5)), strict=True):
                s.rare = dict(rare or ())
                found = [t for t in tokens(host, path, s) if t not in m["named"]]
                odds.append(sum((m["weights"].get(t, m["unseen"]) for t in found), 0.0))
                others.append([t for t in found if t not in m["weights"]] if ask else None)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(odds, pa.float64()), pa.array(others, pa.list_(pa.string()))], [key, "host", "path", "rule", "rule_verdict", "block_odds", "others"])

    out = decided.select(key, "host", "path", "rule", "rule_verdict", "rare").mapInArrow(run, f"{key} {kind}, host string, path string, rule string, rule_verdict string, block_odds double, others array<string>")
    if ask:
        out = written(out)
        asked = out.where("size(others) > 0").select("host", "path", "others").distinct().select("host", "path", F.explode("others").alias("token"))
        more = written(asked.join(rest, "token").groupBy("host", "path").agg(F.sum("more").alias("more")))
        out = out.join(more, ["host", "path"], "left").withColumn("block_odds", F.col("block_odds") + F.coalesce("more", F.lit(0.0)))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_odds") > MARGIN, "block").otherwise("allow"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), "block_odds")


def filtered(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", key: str = "page_id", vocabulary: int = VOCABULARY) -> DataFrame:
    """Learn from pages and judge each of them."""
    words, total, rare = word_counts(pages, html, vocabulary)
    decided = with_rare(by_rules(pages.select(key, F.col(url).alias("url")), rules), words, rare)
    model, rest = learn(decided, words, total, rules, vocabulary)
    return judged(decided, model, rest, key)
