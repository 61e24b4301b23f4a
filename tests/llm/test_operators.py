"""Each operator on small tables with nulls, empty texts, repeats and no rows, against brute force."""

import hashlib
import random
import re

import pytest

from rowproof.llm import bpe, exact_dedup, mixing, near_dedup, neighbours, repeats

DOCS = "doc_id long, text string, source string, lang string"
WORDS = r"[^\x20\x09-\x0D]+"


def _docs(spark, texts, extra=False):
    rows = [(i, t, "ab"[i % 2] if i % 5 else None, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "a", "Of"]) if rng.random() < 0.2 else f"w{rng.randrange(4000)}"
    base = [" ".join(word() for _ in range(rng.choice([3, 40, 120, 300]))) for _ in range(60)]
    shared = " ".join(word() for _ in range(70))
    out = base + [base[7], base[7], None, "", "  \n", "one", "One"] + [f"{b} {shared} x{i}" for i, b in enumerate(base[:12])]
    for b in base[20:40]:
        w = b.split(" ")
        for _ in range(max(1, len(w) // 50)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def test_exact_groups(spark, texts):
    got = exact_dedup.exact_groups(_docs(spark, texts), block_bytes=16).collect()
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(t or "", []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    assert {tuple(r) for r in got} == want and len(got) == len(texts)
    assert exact_dedup.exact_groups(_docs(spark, [])).count() == 0


def _shingles(t, k):
    w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_once_keeps_one_node_of_the_same_rows(spark):
    nodes = {1: {5, 6}, 2: {6, 5}, 3: {5, 6, 7}, 4: {7}, 5: {7}, 6: {5, 7}}
    got = near_dedup.once(spark.createDataFrame([(n, d) for n, docs in nodes.items() for d in docs], "node long, doc long")).collect()
    assert {tuple(r) for r in got} == {(n, d) for n in (1, 3, 4, 6) for d in nodes[n]}


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(spark, texts, k):
    sets = [_shingles(t, k) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dedup.near_groups(_docs(spark, texts), k=k).collect()
    assert {tuple(r) for r in got} == {(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def _components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("small", [1024, 24])
def test_near_groups_around_the_line(spark, monkeypatch, small):
    """Variants of one long text whose similarities lie on both sides of 0.8: all pairs resemble
    each other, few are links. With small nodes, rows that do not part are dealt into blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", small)
    rng = random.Random(1)
    base, family = [f"w{rng.randrange(9000)}" for _ in range(400)], []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(11, 17)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        family.append(" ".join(w))
    want = _components([_shingles(t, 2) for t in family])
    assert 1 < len(set(want)) < 120
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(_docs(spark, family), k=2).collect()}
    assert got == dict(enumerate(want))


def test_near_rows_not_ids(spark):
    """Repeated and missing ids: links and decisions are those of rows."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(4000)}"
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a), "x"), (5, " ".join(b), "x"), (7, near(a), "y"), (8, near(b), None), (None, " ".join(c), "n"), (None, near(c), "n"), (None, "", "e"), (None, None, "e"), (9, near(c), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, k=2).collect()), key=str)
    want = [(5, 59, 5, True), (5, 59, 5, True), (7, 59, 5, False), (8, 59, 5, False), (None, 59, 9, False), (None, 59, 9, False), (9, 59, 9, True), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    kept = near_dedup.drop_near_copies(docs, k=2)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.rid) for r in kept.collect()) == [(0, "e"), (0, "e"), (5, "x"), (5, "x"), (9, "z")]
    assert near_dedup.near_groups(docs.where("false")).count() == 0 and near_dedup.drop_near_copies(docs.where("false")).count() == 0


def _cut(rows):
    """(doc_id, number of words, number removed, kept text) of each row, by every window."""
    words, first = [re.findall(WORDS, t or "") for _, t in rows], {}
    order = [(i is None, i or 0) for i, _ in rows]
    for n, w in enumerate(words):
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, order[n]), order[n])
    out = []
    for n, w in enumerate(words):
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < order[n] for j in range(50)}
        out.append((rows[n][0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def _cut_by_spark(spark, rows, **more):
    got = repeats.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text).decode()) for r in got), key=str)


@pytest.mark.parametrize("group", [1024, 1])  # every group a subtree, and none
def test_repeats(spark, texts, group):
    rows = list(enumerate(texts))
    assert _cut_by_spark(spark, rows, group=group) == _cut(rows)
    assert _cut_by_spark(spark, []) == []


@pytest.mark.parametrize("group", [1024, 1])
def test_repeats_of_repeated_rows(spark, group):
    """Documents that repeat a passage shared with an earlier one, repeated ids, null ids, equal
    rows and a text of one passage over and over."""
    rng = random.Random(9)
    run = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = []
    for k in range(6):
        p, u, v = run(70), run(60), run(60)
        rows += [(3 * k, f"{run(55)} {p} {run(55)}"), (3 * k + 1, " ".join([u, p, v] * 3)), (3 * k + 2, f"{u} {p} {v}")]
    p, q = run(64), run(600)
    rows += [(5, f"{p} {run(600)}"), (5, f"{run(20)} {p}"), (None, f"{run(30)} {p}"), (None, q), (None, q), (30, " ".join([p] * 40)), (31, q), (30, "a b"), (None, None), (40, "")]
    assert _cut_by_spark(spark, rows, group=group) == _cut(rows)


def test_bpe_memo_keeps_what_recurs(monkeypatch):
    """A piece that recurs is worked out once, however many rare ones pass; long ones are not kept; ids without a token do not decode."""
    monkeypatch.setattr(bpe, "MEMO", 50)
    path, pattern = bpe.default_tokenizer()
    coder, asked = bpe.ByteBpe(open(path, "rb").read(), pattern), []
    plain, work = bpe.ByteBpe(open(path, "rb").read(), pattern), coder.piece
    monkeypatch.setattr(coder, "piece", lambda p: asked.append(p) or work(p))
    texts = [f"zqvxkw {i}x{i}y zqvxkw q{'ab' * 40}" for i in range(200)] + ["", "é\x00\U0001f600 \n\n"]
    for text in texts:
        ids = coder.encode(text)
        assert ids == b"".join(plain.piece(p.encode()).tobytes() for p in plain.find(text)) and coder.decode(ids) == text.encode()
    assert asked.count(b" zqvxkw") == 1 and asked.count(b"zqvxkw") == 1 and len(coder.memo) <= 50 and len(coder.older) <= 50
    assert not any(len(p) > bpe.KEPT for p in (*coder.memo, *coder.older))
    for unknown in (b"\xff\xff\xff\x7f", b"\x00"):
        with pytest.raises((KeyError, IndexError, ValueError)):
            coder.decode(unknown)


def test_bpe_round_trip(spark):
    import tiktoken

    texts = ["it's  the\n\n 日本 123 a\x1cb\x85c", "a" * 5000, "", None, "ÃŸ mixed😀text"]
    path, pattern = bpe.default_tokenizer()
    coder = bpe.ByteBpe(open(path, "rb").read(), pattern)
    real = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(_docs(spark, texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = real.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_mixing(spark, texts):
    docs = _docs(spark, texts)
    plan = mixing.mixing_plan(docs).collect()
    sizes = [len(re.findall(WORDS, t or "")) for t in texts]
    assert {(r.doc_id, r.size) for r in plan} == set(enumerate(sizes))
    targets = {r.source_size: r.target for r in plan}
    assert abs(sum(targets.values()) - sum(sizes)) < 1e-6
    assert mixing.mix(docs).count() == sum(r.copies for r in plan) and max(r.copies for r in plan) <= 3


def test_mix_keeps_columns_of_any_name(spark):
    """Columns named like those of the operator, null and repeated ids, no rows."""
    names = ["of_source", "rate", "copy", "__copy", "__rate", "__source", "_rate"]
    rows = [(i if i % 7 else None, "w " * (i % 9), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert got.count() == mixing.mixing_plan(docs).selectExpr("sum(copies)").first()[0] > 0
    assert mixing.mix(docs.where("false")).count() == 0


def test_neighbours(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(900, 8))
    x[5] = x[40] = x[41]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(mine) == 5 and all(abs(s[v] - z) < 1e-9 for _, v, z in mine)
        hits += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hits >= 0.9 * 45 * 5 and {r.query_id for r in got} == set(range(0, 900, 20))
