"""The pipeline against plain versions of its stages, each judged on its own input."""

import hashlib
import random
import time

import pytest

from floeworks.llm import lines
from floeworks.llm.mixing import targets

from .test_queries import WORD, classes, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def documents():
    rng = random.Random(3)
    rows = []
    for i in range(80):
        text = f"{prose(rng, 40)}\nShared footer for all pages of the site\n{prose(rng, 60)}" if i % 3 == 0 else prose(rng, 30 + i)
        rows.append(text)
    rows += [rows[5], rows[5] + " more", "short text", None, "again and again " * 40]
    return [(i, t, "en", f"s{i % 3}", len(t or ""), "extra") for i, t in enumerate(rows)]


def test_stages(spark, tmp_path):
    docs = documents()
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, bucket string").write.parquet(path)
    df = spark.read.parquet(path)
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, df, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "tokenise"]
    for rows in out[:-1]:
        assert all(list(r) == ["doc_id", "text", "lang", "source", "n_chars"] for r in rows)
    kept = {r["doc_id"] for r in out[0]}
    assert kept == {d[0] for d in docs} - {82, 83, 84}
    # recurring lines go, documents stay
    assert {r["doc_id"] for r in out[1]} == kept
    for r in out[1]:
        source = next(d[1] for d in docs if d[0] == r["doc_id"])
        assert r["text"] == "\n".join(x for x in source.split("\n") if not x.startswith("Shared footer"))
    # one document of each class, by brute force on this stage's input
    _, component = classes([(r["doc_id"], r["text"]) for r in out[1]], 5)
    assert {r["doc_id"] for r in out[2]} == {i for i, c in component.items() if c == i}
    # the mix comes near its targets on this stage's input
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in out[2]}
    names = ["s0", "s1", "s2"]
    goal = targets([sum(size[r["doc_id"]] for r in out[2] if r["source"] == s) for s in names], [5, 2, 1])
    for s, g in zip(names, goal, strict=True):
        assert abs(sum(size[r["doc_id"]] for r in out[3] if r["source"] == s) - g) <= max(size.values()) / 2 + 1
    assert len(out[4]) == len(out[3])
    texts = {r["doc_id"]: r["text"] for r in out[3]}
    for r in out[4]:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "decoded_sha256")
    assert sorted(map(tuple, again.collect())) == sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out[4])


def test_line_dedup_leaves_whole_copies(spark):
    rng = random.Random(1)
    copy = f"{prose(rng, 12)}\n{prose(rng, 12)}"
    rows = [(i, copy) for i in range(12)] + [(20 + i, f"{prose(rng, 9)}\nlogged in as user {i} today\n\n{prose(rng, 9)}") for i in range(12)] + [(50, None), (51, ""), (52, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r for r in lines.without_recurring(df).collect()}
    assert all(plain[i]["text"] == "" and plain[i]["n_dropped"] == 2 for i in range(12))
    got = {r["doc_id"]: r for r in lines.without_recurring(df, spare_copies=True).collect()}
    assert all(got[i]["text"] == t for i, t in rows if i < 20 or i >= 50)
    assert all(plain[i] == got[i] for i in got if i >= 20)
    assert all("logged in" not in got[20 + i]["text"] and got[20 + i]["n_dropped"] == 1 for i in range(12))
    assert lines.without_recurring(df.limit(0)).count() == 0


def test_deep_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAF", 5)
    rows = [(i, f"a b c d e {w} x y z w v u t s r q p o n m\nown line {'xyz'[i % 3] * (i + 1)} here") for i, w in enumerate("klmnopqrstuvw" * 2)]
    got = lines.without_recurring(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2).collect()
    assert len(got) == len(rows)


def test_large_leaves_keep_their_templates(spark, monkeypatch):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    rows = []
    for i, name in enumerate(names):
        made = [f"this article was written by {name} for our site", f"this article was {' '.join(rng.choice('pq') for _ in range(6))}", f"see user {i % 3} {name} now", f"see {i} user {name} now"]
        rows.append((i, "\n".join([*made, prose(rng, 9), prose(rng, 5)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for leaf in (5, 10**9):
        monkeypatch.setattr(lines, "LEAF", leaf)
        got.append(sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in lines.without_recurring(df, min_docs=4).collect()))
    assert got[0] == got[1]
    assert all("written by" not in text for _, text, _ in got[0])


def test_probes_find_all_templates():
    def greedy(some, agree):
        made, out = [], []
        for i, line in enumerate(some):
            shares = [sum(a == b != lines.VARIABLE for a, b in zip(t, line, strict=True)) / len(line) for _, t in made]
            k = max(range(len(made)), key=lambda j: (shares[j], -j), default=-1)
            if k >= 0 and shares[k] >= agree:
                made[k] = (made[k][0], [a if a == b else lines.VARIABLE for a, b in zip(made[k][1], line, strict=True)])
            else:
                made.append((i, line))
                k = -1
            out.append(made[k][0])
        return out

    rng = random.Random(5)
    for size in range(1, 24):
        for head in (["a", "b", "c"], ["a", lines.VARIABLE, "c"], [lines.VARIABLE] * 3):
            some = [(head + [rng.choice(["x", "x", "x", "y", "z", lines.VARIABLE]) for _ in range(size)])[:size] for _ in range(60)]
            assert lines.templates(some, 0.7, lines.LEADING) == greedy(some, 0.7) == lines.templates(some, 0.7)


def unlike(rng, n):
    """Lines of 20 words with one opening of five and else unlike, some of them of a common form."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    out = [" ".join(["one", "of", "the", "most", "common", *(rng.choice(words) for _ in range(15))]) for _ in range(n)]
    form = [rng.choice(words) for _ in range(13)]
    return out + [" ".join(["one", "of", "the", "most", "common", rng.choice(words), *form, rng.choice(words)]) for _ in range(n // 100)]


def test_unlike_lines_with_one_opening_in_one_leaf():
    rng = random.Random(3)
    some = [x.split() for x in unlike(rng, 20_000)]
    began = time.time()
    made = lines.templates(some, 0.7, lines.LEADING)
    assert time.time() - began < 20
    assert len(set(made[:20_000])) == 20_000 and len(set(made[20_000:])) == 1


def test_unlike_lines_are_many_tasks(spark):
    rng = random.Random(4)
    docs = [(i, x) for i, x in enumerate(unlike(rng, 30_000))]
    cut = []
    real = lines._cut
    began = time.time()
    try:
        lines._cut = lambda fetched: cut.append(real(fetched)) or cut[-1]
        got = lines.without_recurring(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    finally:
        lines._cut = real
    assert time.time() - began < 90
    assert {r["doc_id"] for r in got if r["n_dropped"]} == set(range(30_000, 30_300))
    sizes = [r["count"] for r in cut[0].groupBy("leaf").count().collect()]
    assert len(sizes) > 1000 or max(sizes) < sum(sizes)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, `__at` string"


def test_empty_table_through_all_stages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_sha256" in out.columns


def test_rows_without_ids_through_all_stages(spark, tmp_path):
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, c), (None, c), (2, c + " more"), (3, None), (4, ""), (None, d), (5, d + " and more of it"), (None, None), (6, "short")]
    data = [(i, t, "en", "s" if k % 2 else None, len(t or ""), "x", "y") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
    pairs = [sorted(((r["doc_id"], r["text"]) for r in rows_), key=str) for rows_ in out[:4]]
    good = sorted(((i, t) for i, t in rows if t and len(t.split()) >= 20), key=str)
    assert pairs[0] == pairs[1] == good
    # a: ids 1, 1 and none; c: none, none and 2; d: none and 5; b alone
    assert pairs[2] == sorted([(1, a), (1, a), (1, b), (2, c + " more"), (5, d + " and more of it")], key=str)
    assert set(pairs[3]) <= set(pairs[2]) and len(out[4]) == len(out[3])
    assert sorted(r["decoded_sha256"] for r in out[4]) == sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in out[3])
