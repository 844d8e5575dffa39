"""op11, op12 and op13 and their parts against plain versions, over small tables with every awkward row."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from floeworks.llm import fingerprints, search, trie
from floeworks.llm.queries import ORACLES, QUERIES

from .test_queries import documents, prose, write

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations():
    rng = random.Random(5)
    texts = [None, "", "same words here", "Same words here", "é ü 123", "two\nlines of words", *(prose(rng, 5) for _ in range(4))]
    rows = []
    for c in [*range(90), 1000, 1019, 1021, -40, -25]:
        if c in (20, 21, 47):
            continue
        n = 30 if c == 33 else rng.choice([0, 1, 2, 3, 5]) or 1
        for t in range(n):
            first = c % 3 and t < 2
            rows.append((c, None if t == 0 and c % 5 == 0 else t, None if c % 7 == 3 else ["user", "assistant"][t % 2], "hello there" if first else rng.choice(texts), "clash"))
    rows += [(None, 0, "user", "no id", "x"), (4, 9, "user", "said twice", "x"), (4, 10, "user", "said twice", "x")]
    rng.shuffle(rows)
    return rows


ITEMS = [
    (0, "alpha bravo CHARLIE alpha's zulu"), (1, None), (2, ""), (3, "#tag 123 é ünïcode"), (4, "you idiot, total moron"), (5, "golfer"), (5, "hotel  indias"),
    (6, "nothingofthis neverhere"), (None, "lima mike"), (7, "alpha bravo CHARLIE alpha's zulu"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("new"))
    docs = [*documents(), (None, "alpha bravo without an id", "en", None, 1, 0.5, "clash", -1)]
    write(spark, path, (docs, [], [], []), conversations(), [(i, t, 1) for i, t in ITEMS])
    return path


def plain_nodes(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    by = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, ends, built = {}, {}, {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(by.get(base, [])[:h] + own[h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
        ends.setdefault(built[c], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[:-1] == q for r in members)
        saved = sum((len(members[q]) - 1) * (len(WORD.findall(q[-1][1])) if q else 0) for q in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids(p), sum(not kids(q) for q in below), saved, sha))
    return sorted(out, key=str)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_op11(spark, folder):
    got = QUERIES["op11_conversation_trie"](spark, folder).collect()
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=str) == plain_nodes(conversations())


@pytest.mark.parametrize(("kept", "stretch"), [(1, 2), (7, 3), (10_000, 1)])
def test_op11_flushes_and_stretches(spark, folder, monkeypatch, kept, stretch):
    """Tries that are emptied after every batch, and conversations cut into short stretches, give the same nodes."""
    turns = trie.numbered(trie.digested(spark.read.parquet(f"{folder}/conversations.parquet")))
    monkeypatch.setattr(trie, "PIECE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = trie.nodes(trie.rebuilt(turns), turns, kept, stretch).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=str) == plain_nodes(conversations())


def test_z_fast_trie():
    """Exit nodes and members after every insertion, against a set of all prefixes."""
    rng = random.Random(3)
    for _ in range(200):
        tries, seen, members = trie.ZFastTrie(), {()}, {}
        for conv in range(rng.randrange(1, 12)):
            s = tuple(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 17])))
            path = [repr(s[: d + 1]).encode() for d in range(len(s))]
            node, shared = tries.locate(path)
            assert shared == max(d for d in range(len(s) + 1) if s[:d] in seen)
            assert node.start < shared <= node.end or node.parent is None and shared == 0
            tries.insert(path, [1] * len(path), 1, conv)
            for d in range(len(s) + 1):
                seen.add(s[:d])
                members.setdefault(s[:d], []).append(conv)
        got = {(k if d else b"", d): (n, low) for k, _, d, n, low, _ in tries.expanded()}
        assert got == {(repr(p).encode() if p else b"", len(p)): (len(m), min(m)) for p, m in members.items()}
        assert tries.size == len(members)


def test_op11_deep_chains(spark):
    """A tree of chains as deep as it has conversations: each leaves the one before it one turn later."""
    rows = [(c, t, "r", str(min(t, c) if t <= c else -c)) for c in range(40) for t in range(c + 2)]
    turns = trie.numbered(trie.digested(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {(r["conv_id"], r["depth"]): (r["n_convs"], r["n_leaves"]) for r in trie.nodes(turns, turns).collect()}
    assert got[0, 0] == (40, 40) and all(got[c, c + 1] == (40 - c, 40 - c) for c in range(39)) and got[5, 7] == (1, 1)


def ranked_plainly(docs, items, k=10):
    lower = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(d, w) for d, t in docs if (w := lower(t))]
    n_docs, length = len(texts), sum(len(w) for _, w in texts)
    by = {}
    for i, t in items:
        by.setdefault(i, set()).update(lower(t))
    out = []
    for i, terms in by.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in texts) + 1))) for t in terms}
        scored = []
        for d, w in texts:
            m = 100 - 90 + 90 * len(w) * n_docs // length
            s = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("limit", "k"), [(1 << 24, 10), (300, 10), (1, 2)])
def test_op12(spark, folder, monkeypatch, limit, k):
    """One block of items or one for each; few cells at once."""
    docs = [(d[0], d[1]) for d in documents()] + [(None, "alpha bravo without an id")]
    monkeypatch.setattr(search, "CELLS", 64)
    got = search.ranked(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), k, limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked_plainly(docs, ITEMS, k)


def test_op12_many_equal_scores(spark):
    docs = spark.createDataFrame([(i * 37 % 1000, "one two three" if i % 3 else "one other") for i in range(1000)], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "two one")], "item_id long, text string")
    got = search.ranked(docs, items).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == sorted(i * 37 % 1000 for i in range(1000) if i % 3)[:10] and len({r["score"] for r in got}) == 1


def plain_fingerprint(text):
    """A byte at a time, with Python's own numbers."""
    base, whole = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    windows = [text[max(0, i - 6) : i + 1] for i in range(len(text))]
    hashes = [mix((sum((c + 1) * pow(base, j, 1 << 64) for j, c in enumerate(w)) + len(w)) & whole) >> 32 for w in windows]
    reach = [sum(h < 1 << 32 >> k if k <= 32 else False for h in hashes) for k in range(34)]
    level = max([k for k in range(34) if reach[k] >= fingerprints.LEAST], default=0)
    if reach[level] > fingerprints.MOST:
        level = min(k for k in range(34) if reach[k] <= fingerprints.MOST)
    out = [str(level)]
    for k in (level, level + 1):
        letters, total, open_ = "", 0, False
        for h in hashes:
            total, open_ = total + h, True
            if k <= 32 and h < 1 << 32 >> k:
                letters, total, open_ = letters + chr(fingerprints.LETTERS[mix(total & whole) >> 58]), 0, False
        out.append(letters + chr(fingerprints.LETTERS[mix(total & whole) >> 58]) if open_ else letters)
    return ":".join(out)


def plain_likeness(a, b):
    def alike(x, y):
        run = min(fingerprints.SHARED, (min(len(x), len(y)) + 1) // 2)
        if not x or not y or not any(x[i : i + run] in y for i in range(len(x) - run + 1)):
            return 0.0
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                before, row[j] = row[j], before if c == e else 1 + min(row[j], row[j - 1])
        return 1 - row[-1] / (len(x) + len(y))

    (k, x, xx), (n, y, yy) = (f.split(":") for f in (a, b))
    if a == b:
        return 1.0
    return {0: max(alike(x, y), alike(xx, yy)), 1: alike(xx, y), -1: alike(x, yy)}.get(int(n) - int(k), 0.0)


def test_op13(spark, folder):
    docs = [(d[0], d[1] or "") for d in documents()] + [(None, "alpha bravo without an id")]
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))  # the repeated row stands beside its like
    got = sorted(QUERIES["op13_fingerprints"](spark, folder).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(docs)
    known = {}
    for r, (i, t), (_, after) in zip(got, docs, [*docs[1:], docs[0]]):
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        f, e, s = (known.setdefault(x, plain_fingerprint(x.encode()) if len(x) < 50_000 else fingerprints.of_texts([x.encode()])[0]) for x in (t, changed, after))
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f, e)
        if len(f) + len(e) + len(s) < 2000:
            assert abs(r["near_edited"] - plain_likeness(f, e)) < 1e-12 and abs(r["near_next"] - plain_likeness(f, s)) < 1e-12


def test_fingerprints_in_blocks(monkeypatch):
    """Texts hashed in blocks of any length, alone or with others, have one fingerprint; near ones are alike, unlike ones not."""
    rng = random.Random(9)
    texts = [prose(rng, n).encode() for n in (1, 5, 40, 700, 9000)] + [b"", b"ab" * 5000, b"x" * 300, bytes(rng.randrange(32, 127) for _ in range(20_000))]
    plain = [plain_fingerprint(t) for t in texts]
    for block in (8, 100, 1 << 18):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        assert fingerprints.of_texts(texts) == plain
        assert [fingerprints.of_texts([t])[0] for t in texts] == plain
    near = texts[4][: len(texts[4]) * 3 // 4] + texts[8][:10_000]
    assert fingerprints.compare(plain[4], fingerprints.of_texts([near])[0]) > 0.5 > 0.1 > fingerprints.compare(plain[4], plain[8])
    assert max(len(f) for f in plain) < 2 * fingerprints.MOST


def test_fingerprints_of_a_column(spark):
    df = spark.createDataFrame([(1, "a text", "old"), (2, None, "old"), (3, "a text", "old")], "k int, text string, fingerprint string")
    got = fingerprints.with_fingerprint(df).orderBy("k").collect()
    assert got[0]["fingerprint"] == got[2]["fingerprint"] == plain_fingerprint(b"a text") and got[1]["fingerprint"] == "0::"
    near = fingerprints.with_fingerprint(df).select(fingerprints.likeness(F.col("fingerprint"), F.lit("0::")).alias("x")).collect()
    assert [r["x"] for r in near] == [0.0, 1.0, 0.0]


def test_very_long_text_has_a_fingerprint_soon():
    import time

    text = np.random.default_rng(1).integers(97, 123, 8_000_000).astype(np.uint8).tobytes()
    began = time.time()
    assert 64 <= len(fingerprints.of_texts([text])[0].split(":")[1]) <= 256
    assert time.time() - began < 20


@pytest.mark.parametrize("name", ["op8_quality_rules", "op11_conversation_trie", "op12_lexical_search"])
def test_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    con.execute(ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in con.fetchall())
    assert sorted(str(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want
