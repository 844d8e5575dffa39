"""Parts of the operators on their own."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from floeworks.llm import ann, bpe, licences, lines, mixing, neardup, suffixes, toxicity, urls
from floeworks.llm.components import components
from floeworks.llm.queries import tokenizer_path


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(s):
    assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 2000):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(3))
        x, y = neardup.sketch(np.unique(np.r_[common, a])), neardup.sketch(np.unique(np.r_[common, b]))
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((x == y).mean() - 1 / 3) < 0.2
    assert (neardup.sketch(np.zeros(0, np.uint64)) == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_template_tree():
    made = lines.templates([x.split() for x in ("a b c d e", "a b x d e", "a b y d e", "q r s t u")], 0.7)
    assert made == [0, 0, 0, 3]
    assert lines.tokens("user 17 left 3pm") == ["user", "<*>", "left", "<*>"]


def test_flow_prefers_fresh_tokens_and_fills_overlaps():
    flow = mixing.route([10, 10, 10], [{0: 30}, {0: 30, 1: 30}, {1: 30}], [12, 20])
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == [12, 20]
    assert max(sum(f.values()) for f in flow) <= 12


def cheapest(units, cells, quotas):
    """Token by token along the cheapest path of the residual graph, found by relaxing all edges."""
    edges = []

    def edge(a, b, n, cost):
        edges.append([a, b, n, cost])
        edges.append([b, a, 0, -cost])

    for i, u in enumerate(units):
        left = sum(cells[i].values())
        for cost in (1, 2, 4, 8):
            n = left if cost == 8 else min(u, left)
            edge("root", ("p", i), n, cost)
            left -= n
        for j, n in cells[i].items():
            edge(("p", i), ("s", j), n, 0)
    for j, q in enumerate(quotas):
        edge(("s", j), "sink", q, 0)
    total = cost = 0
    while True:
        far, via = {"root": 0}, {}
        changed = True
        while changed:
            changed = False
            for k, (a, b, n, c) in enumerate(edges):
                if n and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], via[b], changed = far[a] + c, k, True
        if "sink" not in far:
            return total, cost
        node = "sink"
        while node != "root":
            edges[via[node]][2] -= 1
            edges[via[node] ^ 1][2] += 1
            node = edges[via[node]][0]
        total, cost = total + 1, cost + far["sink"]


def test_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        s = rng.randrange(1, 4)
        units, cells = [], []
        for _ in range(rng.randrange(1, 5)):
            units.append(rng.randrange(1, 5))
            cells.append({j: 3 * units[-1] * rng.randrange(1, 3) for j in rng.sample(range(s), rng.randrange(1, s + 1))})
        quotas = [rng.randrange(0, 15) for _ in range(s)]
        flow = mixing.route(units, cells, quotas)
        cost = 0
        for u, c, f in zip(units, cells, flow):
            assert all(0 <= f[j] <= c[j] for j in c)
            left = sum(f.values())
            for price in (1, 2, 4, 8):
                n = left if price == 8 else min(u, left)
                cost, left = cost + n * price, left - n
        assert all(sum(f.get(j, 0) for f in flow) <= q for j, q in enumerate(quotas))
        assert (sum(sum(f.values()) for f in flow), cost) == cheapest(units, cells, quotas)


def test_flow_over_many_patterns_is_fast():
    rng = random.Random(5)
    sets = {tuple(sorted(rng.sample(range(200), rng.randrange(2, 5)))) for _ in range(5000)}
    cells = [{j: rng.randrange(300, 900) for j in k} for k in sorted(sets)]
    began = time.time()
    mixing.route([100] * len(cells), cells, [30_000] * 200)
    assert time.time() - began < 20


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([10, 1000], [5, 2]) == [30.0, 980.0]
    assert mixing.targets([], []) == []


def test_fold_and_exceptions():
    assert toxicity.fold("Ｉd1оt") == "idiot"
    m = toxicity.Matcher({"trash": 2.0, "lowei*": 3.0})
    assert m.score("take out the trash can")[0] == 0
    assert m.score("trash loweichen trashy")[0] == 5.0


def test_segmentation():
    s = urls.Segmenter({"free": 50, "bets": 50, "freeb": 1})
    assert s.split("freebets") == ["free", "bets"]
    rng = random.Random(6)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(12)}
    total = sum(counts.values())
    for _ in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        scores = {}
        for cuts in itertools.product((False, True), repeat=len(text) - 1):
            words, start = [], 0
            for i, cut in enumerate([*cuts, True]):
                if cut:
                    words.append(text[start : i + 1])
                    start = i + 1
            scores[tuple(words)] = sum(math.log(counts[w] / total) if w in counts else -math.log(10 * total) - len(w) * math.log(10) for w in words)
        assert abs(scores[tuple(urls.Segmenter(counts, total).split(text))] - max(scores.values())) < 1e-9


def test_bpe_round_trip_and_offsets(spark):
    texts = ["naïve café 😀 中文", None, "", "a  b\n\nc", "x" * 300]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    made = bpe.encode(df, tokenizer_path(), offsets=True)
    back = {r["doc_id"]: r for r in bpe.decode(made, tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        assert back[i]["decoded"] == (t or "")
        assert len(back[i]["ids"]) == len(back[i]["ids_offsets"])
    plain = {r["doc_id"]: r["ids"] for r in bpe.encode(df, tokenizer_path()).collect()}
    assert plain == {i: back[i]["ids"] for i in back}
    half = spark.createDataFrame([(plain[0][:6],)], "ids array<int>")
    assert isinstance(bpe.decode(half, tokenizer_path()).first()["decoded"], str)


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = ann.unit(rng.standard_normal((200, 6)))
    sizes = np.bincount(ann.balanced_parts(ann.neighbour_graph(x), 8), minlength=8)
    assert sizes.max() - sizes.min() <= 3


def test_probes_hold_the_mass():
    rng = np.random.default_rng(2)
    z = rng.standard_normal((50, 12)) * 3
    row, part = ann.likeliest(z, 0.9)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    for i in range(50):
        mine = part[row == i]
        order = np.argsort(-p[i])[: len(mine)]
        assert mine.tolist() == order.tolist() and len(mine) >= 2 and p[i][mine].sum() >= 0.9
        assert len(mine) == 2 or p[i][mine[:-1]].sum() < 0.9


def test_pool_keeps_smallest_ids():
    b = pa.RecordBatch.from_pydict({"id": [5, 3, 9, 1], "v": pa.array([[1.0, 0.0]] * 3 + [[0.0, 1.0]], pa.list_(pa.float64()))})
    out = pa.Table.from_batches(list(ann._pool(iter([b]), 2))).to_pydict()
    assert sorted(map(tuple, out["ids"])) == [(1,), (3, 5)]


def test_licence_gate_passes_any_gap(spark):
    gaps = (" ", " " * 12, "-" * 15, "\n" + "\t" * 11, "\u00a0 ", ".\r\n\r\n      ")
    texts = [x.format(g) for g in gaps for x in ("CC{0}BY", "a CC{0}Zero work", "placed in the public{0}domain", "placed in{0}the public{0}domain")]
    got = {r["doc_id"]: r for r in licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        if "\u00a0" in t:
            continue  # a letter of a word, so no gap
        assert got[i]["labels"] == ("cc-by", "cc0", "public-domain", "public-domain")[i % 4], t
        if i % 4 == 0:
            assert (got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == (1, 0, 0, "cc-by")


def test_rare_words_and_tokens_count(spark):
    rules = (("block", "bad.com/"), ("allow", "good.org/"))
    rng = random.Random(2)
    words = ["river", "stone", "cloud", "green", "apple", "night"]
    urls_ = [f"http://{rng.choice(words)}{rng.choice(words)}.{site}/{rng.choice(words)}/{rng.choice('xyz')}{i % 7}" for i, site in enumerate(["bad.com", "good.org", "other.net"] * 20)]
    pages = spark.createDataFrame([(i, u, f"<title>{rng.choice(words)} {rng.choice(words)}</title>") for i, u in enumerate(urls_)], "page_id int, url string, html string")
    many, few = ({r["page_id"]: r for r in urls.filtered(pages, rules, vocabulary=n).collect()} for n in (50_000, 2))
    assert len(many) == len(few) == 60
    for i, r in many.items():
        assert few[i]["verdict"] == r["verdict"] and abs(few[i]["block_odds"] - r["block_odds"]) < 1e-9
    old = urls.Segmenter({"river": 3})
    old.rare = {"stone": 2}
    assert old.split("riverstone") == ["river", "stone"]


def test_sketches_lose_no_more_than_banding():
    n, q = neardup.BINS, 0.8
    lost = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(neardup._least(80)))
    assert lost <= (1 - q**neardup.ROWS) ** neardup.BANDS


def test_large_parts_are_divided_again(spark, monkeypatch):
    """Three levels of models: every vector is kept once, all of them are found at a mass of one, and nearly all neighbours at the usual one."""
    rng = np.random.default_rng(5)
    centres = 3 * rng.standard_normal((40, 12))
    x = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 12))
    x[500:1500] = x[7]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    asks = (x[::50] / np.linalg.norm(x[::50], axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    want = {}
    for q, row in zip(range(0, 3000, 50), asks, strict=True):
        row[q] = -2
        want[q] = [int(i) for i in np.lexsort((np.arange(3000), -np.round(row, 12)))[:5]]
    monkeypatch.setattr(ann, "PARTS", (2, 3))
    monkeypatch.setattr(ann, "PART_SAMPLE", 300)
    sizes, divided = [], ann.divided

    def watched(index, asked, counts, *a):
        out = divided(index, asked, counts, *a)
        rows = out[0].select("part", "ids").collect()
        ids = [i for r in rows for i in r["ids"]]
        assert len(ids) == len(set(ids)) == 1999 + 6  # of the one vector that 1,001 rows have, six ids stay
        assert {r["part"]: r["n"] for r in out[2].collect()}.items() <= {p: sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}}.items()
        sizes.append(len({r["part"] for r in rows}))
        return out

    monkeypatch.setattr(ann, "divided", watched)
    for mass, least in ((1.0, 1.0), (0.95, 0.9)):
        sizes.clear()
        got = {}
        for r in ann.neighbours(df, ann.F.col("vec_id") % 50 == 0, mass=mass, rows_per_part=60, most=200).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(sizes) >= 2 and sizes == sorted(set(sizes)) and sizes[-1] >= 9
        hits = sum(len(set(got[q]) & set(w)) for q, w in want.items()) / (5 * len(want))
        assert hits >= least and (mass < 1 or got == want)
