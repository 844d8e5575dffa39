"""Rows without ids, ids with several texts, clashing columns, and plain versions of the operators' own verdicts."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from floeworks.llm import bpe, licences, lines, mixing, neardup, quality, substrings, toxicity, urls
from floeworks.llm.queries import QUERIES, URL_RULES, tokenizer_path

from .test_queries import prose

CLASH = ("node", "component", "__places", "host", "path", "pattern", "h", "times", "passes", "key", "size", "rate_base", "base_failed", "n_removed", "spans", "ids", "held_out", "weight", "part", "rank")


def awkward():
    rng = random.Random(9)
    passage = prose(rng, 30)
    texts = [(1, passage + " one"), (1, "another text of the first document " + prose(rng, 25)), (None, "no id: " + passage), (None, None), (None, "no id: " + passage), (2, passage + " two"), (2, passage + " two"), (3, ""), (4, None)]
    return [(i, t, "en", None if k % 2 else "s", len(t or ""), *["clash"] * len(CLASH)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    more = "".join(f", {c} string" for c in CLASH)
    spark.createDataFrame(awkward(), f"doc_id long, text string, lang string, source string, n_chars int{more}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (1, 0, 0), (1, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, "http://a.net/x", None, "c"), (1, None, None, "c"), (1, "http://a.net/x", "", "c")], "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(None, [1.0, 0.0], "c"), (0, [1.0, 0.5], "c"), (0, [1.0, 0.5], "c"), (7, [3e300, 2e300], "c"), (8, [1e-300, 0.0], "c"), (9, None, "c")], "vec_id long, embedding array<double>, part string").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(("op5", "op11", "op12"))])
def test_every_row_has_a_result(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    assert len(rows) == (3 if name.startswith("op7") else len(awkward()))


def test_op5_without_ids_and_with_huge_values(spark, odd):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op5_nearest_neighbours"](spark, odd).collect())
    assert [g[2] for g in got if g[1] == 1] == [7] * len([g for g in got if g[1] == 1]) and {g[2] for g in got} == {7, 8}
    assert all(math.isfinite(g[3]) and abs(g[3]) <= 1 + 1e-12 for g in got)


def test_op6_order_of_documents(spark, odd):
    df = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("t"))
    docs = {(r["doc_id"], r["t"]): r["text"] or "" for r in df.collect()}
    seen, want = set(), {}
    for k in sorted(docs, key=lambda k: (k[0] is None, k[0] or 0, k[1])):
        b = docs[k].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[k] = (k[0], len(b), len(b) - len(kept), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    expected = sorted(str(want[r["doc_id"], r["t"]]) for r in df.collect())
    got = substrings.deduplicated(spark.read.parquet(f"{odd}/documents.parquet"), digest=True).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"])) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 0


def test_numbers_of_equal_rows(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(3)]
    plain = [tuple(x) for x in zip(*(c.tolist() for c in columns))]
    for mixing_ in (substrings.mix, lambda x: x * np.uint64(0)):  # a hash that tells nothing apart
        monkeypatch.setattr(substrings, "mix", mixing_)
        n = substrings._numbers(columns).tolist()
        assert len(set(zip(n, plain))) == len(set(n)) == len(set(plain))


def plain_scan(text):
    """Method labels by trying every rule everywhere and comparing every detection with every other."""
    words = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip()
    norm = " " + words if words else ""
    found = []
    for i, (label, priority, confidence, keywords, expression) in enumerate(licences.signatures()):
        for m in re.finditer(f" ({expression})(?= |$)", norm):
            assert set(keywords) & set(norm.split(" ")), (label, expression)
            start = norm[: m.start()].count(" ")
            found.append((start, start + m[1].count(" "), priority, i, label, confidence))
    kept = []
    for d in found:
        inside = [e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]]
        if not any((e[0], e[1]) != (d[0], d[1]) or e[2] > d[2] or e[3] < d[3] for e in inside):
            kept.append(d)
    score = 1 - math.prod(1 - c for c in {d[5] for d in kept})
    return sorted((d[3], d[4], d[0], d[1]) for d in kept), score


def test_op4_against_every_rule_everywhere(spark):
    rng = random.Random(3)
    samples = [re.sub(r"\((?:[^()|]*\|)?([^()|]*)\)\??", r"\1", e).replace("[cs]", "s").replace("[a-z0-9 ]{1,80}", "the owner").replace("[a-z0-9 ]{1,60}", "x").replace("?", "") for _, _, _, _, e in licences.signatures()]
    texts = samples + ["", None, "x" * 3000]
    for _ in range(150):
        gap = rng.choice([" ", "  ", " \n\t- ", ".\r\n", "-", " // "])
        texts.append(gap.join(w if rng.random() < 0.7 else w.upper() for s in rng.sample(samples, 4) for w in [*s.split(" "), *prose(rng, 2).split(" ")]))
    texts += ["PermiK ssion liİcense", "MITé License", "the KMIT licence"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in licences.scanned(df).collect()}
    hits = set()
    for i, t in enumerate(texts):
        want, score = plain_scan(t or "")
        assert sorted((d["rule"], d["label"], d["first_word"], d["last_word"]) for d in got[i]["detections"]) == want, t
        assert abs(got[i]["score"] - score) < 1e-12
        assert got[i]["labels"] == ",".join(sorted({d[1] for d in want} | set(filter(None, got[i]["base_labels"].split(",")))))
        hits |= {d[0] for d in want}
    assert len(licences.signatures()) > 300 and len(hits) > 200


def test_op4_many_places_in_one_text(spark):
    df = spark.createDataFrame([(1, "all rights reserved and more words " * 100_000)], "doc_id int, text string")
    licences.scanned(df.limit(0)).collect()
    began = time.time()
    r = licences.scanned(df).drop("detections").first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (100_000, 0, 599_994, "reserved")
    assert time.time() - began < 60


def plain_templates(docs, min_docs, agree):
    """The lines that recur, by a tree that holds every leaf whole."""
    found, rows = {}, Counter()
    for i, t in docs:
        mine = set()
        for line in (t or "").split("\n"):
            parts = [lines.VARIABLE if re.search("[0-9]", w) else w for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", line)]
            if parts:
                found.setdefault(tuple(parts), set()).add(i)
                mine.add(tuple(parts))
        rows.update(mine)
    leaves = {}
    for parts in found:
        leaves.setdefault((len(parts), parts[:3]), []).append(parts)
    gone = set()
    for leaf in leaves.values():
        leaf.sort(key=lambda p: (-rows[p], lines.keys(list(p))[0]))
        made = []
        for p in leaf:
            shares = [sum(a == b != lines.VARIABLE for a, b in zip(t, p)) / len(p) for t, _ in made]
            k = max(range(len(made)), key=lambda j: (shares[j], -j), default=-1)
            if k >= 0 and shares[k] >= agree:
                made[k] = ([a if a == b else lines.VARIABLE for a, b in zip(made[k][0], p)], [*made[k][1], p])
            else:
                made.append((list(p), [p]))
        for _, members in made:
            if len(set().union(*(found[p] for p in members))) >= min_docs:
                gone |= set(members)
    return gone


def test_op3_against_a_plain_tree(spark, monkeypatch):
    rng = random.Random(12)
    forms = ["posted by user {} on the old forum", "see {} for more about {} here", "copy of {} kept at {} since {}", "{} said {} and {} left", "read more {} now", "page {} of 7"]
    docs = []
    for i in range(120):
        made = [rng.choice(forms).replace("{}", "{}").format(*("".join(rng.choice("abcde") for _ in range(3)) for _ in range(3))) for _ in range(rng.randrange(1, 6))]
        docs.append((i, "\n".join([*made, rng.choice(["", " ", " ", "\t"]), prose(rng, 4)])))
    docs += [(None, docs[0][1]), (None, docs[1][1]), (3, docs[2][1]), (500, None), (501, "")]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, `__places` string, n_lines int")
    gone = plain_templates(docs, 8, 0.7)
    for leaf in (3, 10**9):
        monkeypatch.setattr(lines, "LEAF", leaf)
        got = lines.without_recurring(df, min_docs=8).collect()
        want = []
        for i, t in docs:
            left = [x for x in (t or "").split("\n") if tuple(lines.tokens(x)) not in gone]
            want.append(str((i, None if t is None else "\n".join(left))))
        assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(want)
    assert gone


def test_op3_more_names_than_a_leaf(spark):
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(1100)]
    df = spark.createDataFrame([(i, f"This page was posted by user {n} on the old site forum today\nown {n}") for i, n in enumerate(names)], "doc_id int, text string")
    got = lines.without_recurring(df)
    assert got.agg(F.sum(F.col("text").contains("This page").cast("int"))).first()[0] == 0


def test_op7_against_plain_bayes(spark):
    rng = random.Random(8)
    sites = ["free-bets", "casino", "ththly", "riverstone", "newsroom", "adultx", "a" * 40]
    pages = [(i, f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(sites)}.{rng.choice(['example.com', 'net', 'org', 'b.net'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.choice(['x', 'y', '7'])}", f"<title>{rng.choice(['river stone', 'free bets', 'news room'])}</title>") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    words = Counter(w for _, _, h in pages for w in re.findall("[a-z]+", h[7:-8]))
    for w in (*urls.BLOCK_WORDS, *urls.ALLOW_WORDS, "www", "blog", "example"):
        words[w] += urls.SEED_COUNT
    cut = urls.Segmenter(dict(words))
    named = urls.named_tokens(URL_RULES)
    parsed = {i: re.match(r".*?://([^/?#]*)([^?#]*)", u).groups() for i, u, _ in pages}
    toks = {i: [t for t in urls.tokens(*p, cut) if t not in named] for i, p in parsed.items()}
    got = {r["page_id"]: r for r in urls.filtered(df, URL_RULES).collect()}
    counts = {"block": Counter(), "allow": Counter()}
    for i, r in got.items():
        if r["rule"]:
            counts[dict((t, v) for v, t in URL_RULES)[r["rule"]]].update(toks[i])
    seeds = {f"h:{w}": (v, urls.SEED_COUNT) for v, some in (("block", urls.BLOCK_WORDS), ("allow", urls.ALLOW_WORDS)) for w in some}
    kinds = len({*counts["block"], *counts["allow"], *seeds}) + 1
    for t, (v, n) in seeds.items():
        counts[v][t] += n
    sums = {v: sum(c.values()) for v, c in counts.items()}
    for i, r in got.items():
        odds = sum(math.log((counts["block"][t] + 1) / (sums["block"] + kinds)) - math.log((counts["allow"][t] + 1) / (sums["allow"] + kinds)) for t in toks[i])
        assert abs(r["block_odds"] - odds) < 1e-9
        if not r["rule"]:
            assert r["verdict"] == ("block" if odds > urls.MARGIN else "allow")
    assert {r["verdict"] for r in got.values() if not r["rule"]} == {"block", "allow"}


def test_op8_rejects_hosts(spark):
    rng = random.Random(2)
    good = lambda: prose(rng, 40)
    noisy = lambda: " ".join(w + "#$%" for w in prose(rng, 25).split())
    rows = [(i, f"good{i % 4}", good()) for i in range(200)] + [(200 + i, "noisy", noisy()) for i in range(60)] + [(300 + i, "short", "too short") for i in range(45)] + [(400 + i, "short", good()) for i in range(15)] + [(500, "one", "short"), (501, None, good())]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    counted = quality.with_counts(df)
    got = {r["doc_id"]: r for r in quality.judged(counted, quality.host_rates(counted)).collect()}
    assert all(got[i]["kept"] for i in range(200)) and got[501]["kept"]
    assert all(got[i]["host_rejected"] and not got[i]["base_failed"] and not got[i]["kept"] for i in [*range(200, 260), *range(400, 415)])
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == {i for i, r in got.items() if r["kept"]}


def test_decode_of_ids_outside_the_vocabulary(spark):
    df = spark.createDataFrame([([1, None, -1, 10_000_000],), (None,), ([],)], "ids array<int>")
    got = [r["decoded"] for r in bpe.decode(df, tokenizer_path()).collect()]
    assert got[0].endswith("�" * 3) and got[1:] == ["", ""]


def test_fold_of_edges_and_accents():
    for text in ("1diot", "id!ot", "i\u0301d\u0308iot", "\u0456diot", "i\u200bdiot"):
        assert toxicity.fold(text) == "idiot"
    assert toxicity.fold("$cum scum! idiot1 1st 4th (5) $5 10") == "scum scum! idiot1 1st 4th (5) $5 10"


def test_mixing_prefers_texts_not_seen(spark):
    rng = random.Random(6)
    shared = [prose(rng, 50) for _ in range(10)]
    rows = [(i, "a", shared[i]) for i in range(10)] + [(100 + i, "b", shared[i]) for i in range(10)] + [(200 + i, "b", prose(rng, 50)) for i in range(10)] + [(300, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    out, sources = mixing.mixed(docs, weights=(1, 1, 1))
    got = {r["doc_id"]: r["times"] for r in out.collect()}
    assert {r["source"]: (r["source_size"], r["target"]) for r in sources.collect()} == {"a": (500, 750.0), "b": (1000, 750.0), "c": (0, 0.0)}
    # b's share is met by its own texts first
    assert sum(got[200 + i] for i in range(10)) >= sum(got[100 + i] for i in range(10))
    again = {r["doc_id"]: r["times"] for r in mixing.mixed(docs, weights=(1, 1, 1))[0].collect()}
    assert again == got and mixing.resample(docs, weights=(1, 1, 1)).count() == sum(got.values())


def test_clashing_columns_stay(spark, odd):
    df = spark.read.parquet(f"{odd}/documents.parquet")
    assert neardup.one_of_each(df).columns == df.columns == mixing.resample(df).columns
    assert set(df.columns) <= set(lines.without_recurring(df).columns) | {"n_lines", "n_dropped"}
    assert quality.keep_good(df).columns == df.columns


def plain_score(lexicon, text):
    """Every entry and every exception at every place of a text."""
    from floeworks.llm import toxicity

    t = toxicity.fold(text)
    inside = lambda i: 0 <= i < len(t) and t[i].isalpha()
    excused = [(i, i + len(p)) for p in toxicity.EXCEPTIONS for i in range(len(t)) if t.startswith(p, i) and not inside(i - 1) and not inside(i + len(p))]
    total = 0.0
    for i in range(len(t)):
        best = (0.0, 0)
        for entry, weight in lexicon.items():
            key = entry.rstrip("*")
            if t.startswith(key, i) and not inside(i - 1) and (entry.endswith("*") or not inside(i + len(key))):
                best = max(best, (weight, i + len(key)))
        if best[0] and not any(a <= i and best[1] <= b for a, b in excused):
            total += best[0]
    return total, len(t.split())


def test_toxic_hits_against_a_plain_search():
    from floeworks.llm import toxicity

    rng = random.Random(8)
    lexicon = toxicity.BASE | {"trash*": 2.0, "clo*": 1.5, "idio*": 3.0, "fish": 1.0}
    words = [*toxicity.BASE, *toxicity.EXCEPTIONS, "trashy", "clowns", "1diot", "m0ron", "not", "an", "fish", "clown fish food", "ünlike", "schön", "c\u043bown"]
    m = toxicity.Matcher(lexicon)
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "-", "", "\n"]) for _ in range(rng.randrange(1, 25)))
        total, n = m.score(text)
        assert abs(total - plain_score(lexicon, text)[0]) < 1e-9 and n == plain_score(lexicon, text)[1], text


def test_many_exceptions_take_no_longer():
    from floeworks.llm import toxicity

    text = "trash can " * 100_000 + "you idiot"
    began = time.time()
    assert toxicity.Matcher(toxicity.BASE).score(text) == (6.0, 200_002)
    assert time.time() - began < 5


def test_toxic_words_learnt_plainly(spark):
    """Counts, confidence bounds, lexicon and coefficients from plain Python; scores on all rows from them."""
    from floeworks.llm import toxicity

    rng = random.Random(10)
    docs = []
    for i in range(160):
        bad = i % 4 == 0
        text = prose(rng, 20) + (" grumblefitz " if bad and rng.random() < 0.9 else " ") + prose(rng, 5) + (" blorptastic" if bad else "")
        docs.append((i, text, int(bad)))
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int")
    lexicon, coefficients = toxicity.learn(df, labels)
    by = {}
    for _, t, y in docs:
        by[t] = max(y, by.get(t, 0))
    n1, n0 = sum(by.values()), len(by) - sum(by.values())
    counts = {}
    for t, y in by.items():
        for f in toxicity.features(t):
            c = counts.setdefault(f, [0, 0])
            c[y] += 1
    want = dict(toxicity.BASE)
    for f, (c0, c1) in counts.items():
        weight = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1)) - 1.5 * math.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        if c1 >= max(4, n1 // 100) and weight >= 1.9:
            want[f] = weight
    assert set(lexicon) == set(want) and all(abs(lexicon[k] - want[k]) < 1e-9 for k in want) and "blorptastic" in lexicon
    got = {r["doc_id"]: r for r in toxicity.with_scores(df, lexicon, coefficients).collect()}
    for i, t, y in docs:
        total, n = plain_score(lexicon, t)
        score = 1 / (1 + math.exp(-(coefficients[0] + coefficients[1] * math.log1p(total) + coefficients[2] * math.log1p(100 * total / (n + 20)))))
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["predicted"] == int(score >= 0.7) == y


def test_the_first_of_equal_rules_wins(spark):
    from floeworks.llm import urls

    pages = spark.createDataFrame([(1, "http://x.com/abcd/e", "")], "page_id long, url string, html string")
    rules = [("allow", "x.com/ab"), ("block", "com/abcd")]
    for some in (rules, rules[::-1]):
        assert urls.by_rules(pages, some).first()["rule_verdict"] == some[0][0]


def test_sources_end_near_their_targets(spark, sf_dir):
    """Within a thousandth of the target, or within the smallest row that could still be taken."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, sources = mixing.mixed(rows)
    goal = {r["source"]: r["target"] for r in sources.collect()}
    taken, least = Counter(), {}
    for r in docs.collect():
        taken[r["source"]] += r["times"] * r["size"]
        assert 0 <= r["times"] <= 3
        if r["times"] < 3 and r["size"]:
            least[r["source"]] = min(r["size"], least.get(r["source"], r["size"]))
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(g / 1000, least.get(s, 0)), s


@pytest.mark.parametrize("patterns", [0, 3])
def test_more_patterns_than_the_limit(spark, monkeypatch, patterns):
    """Texts of many sets of sources: quotas are met, and text is taken once by one source before any goes again, as without a limit."""
    rng = random.Random(14)
    rows = []
    for k in range(400):
        text = prose(rng, rng.randrange(5, 40))
        rows += [(len(rows) + n, text, f"s{s}") for n, s in enumerate(rng.sample(range(6), rng.choice([1, 2, 3, 4])))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    used = []
    for limit in (20_000, patterns):
        monkeypatch.setattr(mixing, "PATTERNS", limit)
        docs, sources = mixing.mixed(df)
        got = docs.collect()
        taken, fresh = Counter(), {}
        for r in got:
            taken[r["source"]] += r["times"] * r["size"]
            if r["times"]:
                fresh[r["key"]] = r["size"]
        assert all(abs(taken[r["source"]] - r["target"]) <= 40 for r in sources.collect())
        used.append(sum(fresh.values()))
    assert used[1] >= 0.9 * used[0]
