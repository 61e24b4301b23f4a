"""Hard negatives, languages and whitening against brute force and plain numpy."""

import math
import random
import zlib

import numpy as np
import pytest

from rowproof.llm import hard_negatives, languages, whitening

VECTORS = "vec_id long, embedding array<float>, label int, rid string, block string, x string"


def _clusters(n, d=8, seed=4, kinds=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, d))
    label = rng.integers(0, kinds, n)
    x = centres[label] * rng.uniform(0.2, 1, (n, 1)) + rng.normal(size=(n, d)) * 0.6
    return [(int(i), [float(np.float32(c)) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, f"r{i}", "b", "x") for i, r in enumerate(rows)], VECTORS)


def _mined(rows, every):
    """Brute force over all rows."""
    good = [(i, [math.floor(256 * c) for c in v], k) for i, v, k in rows if i is not None and k is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v, _ in good]
    good = [r for r in good if len(r[1]) == max(set(sizes), key=lambda s: (sizes.count(s), -s))]
    out = []
    for n, (aid, a, mine) in enumerate(good):
        if aid % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, v, strict=True)), i, k) for m, (i, v, k) in enumerate(good) if m != n), key=lambda r: r[:2])
        for s, pid, _ in [r for r in scored if r[2] == mine][:5]:
            negatives = [(t, i) for t, i, k in scored if k != mine and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(aid, pid, rank, i, -s, -t) for rank, (t, i) in enumerate(negatives, 1)]
    return sorted(out)


def _got(spark, rows, every=5):
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.usable(_frame(spark, rows)), f"vec_id % {every} = 0").collect())


@pytest.mark.parametrize("block, depth", [(4096, 32), (37, 1)])
def test_hard_negatives(spark, monkeypatch, block, depth):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", 16)
    monkeypatch.setattr(hard_negatives, "DEPTH", depth)
    rows = _clusters(260)
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(30)]  # one vector, several labels: ties
    rows += [(5, rows[9][1], 2), (5, rows[9][1], 2), (10, rows[10][1], rows[10][2]), (-15, rows[20][1], 4)]  # repeated ids, equal rows, a negative id
    rows += [(2000, None, 1), (2005, [], 1), (2010, [1.0], 1), (2015, [float("nan")] * 8, 1), (2020, [None] * 8, 1), (2025, rows[0][1], None), (None, rows[0][1], 1), (2030, [0.0] * 8, 3), (2035, [-1.0] * 8, 77)]
    want = _mined(rows, 5)
    assert len(want) > 300 and _got(spark, rows) == want


def test_hard_negatives_beyond_doubles(spark):
    """Products beyond 2^53 are exact, and an empty table has no anchors."""
    rows = [(i, [float(np.float32(c * 300_000)) for c in v], k % 3) for i, v, k in _clusters(60)]
    want = _mined(rows, 5)
    assert want and max(r[4] for r in want) > 1 << 53 and _got(spark, rows) == want
    assert _got(spark, []) == [] and _got(spark, rows[1:4]) == []


def test_threshold_stops_before_the_end():
    """Sorted access reads part of the lists where scores fall off."""
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(4000, 4)) ** 3 * 100).astype(np.int64)
    lists = hard_negatives.Lists(x, np.zeros(4000, np.int64), 4000, np.arange(4000))
    a = np.array([3, -2, 0, 1])
    best = np.sort(x @ a)[::-1][:5]
    found, scores = lists.search(a, lambda f, s, t: len(s) >= 5 and t < np.sort(s)[-5])
    assert len(found) < 2000 and (np.sort(scores)[::-1][:5] == best).all()


TEXT = {
    "aa": ["the", "of", "and", "river", "house", "with", "under", "again"],
    "bb": ["der", "und", "fluss", "nicht", "haus", "mit", "unter", "wieder"],
    "cc": ["les", "dans", "maison", "avec", "sous", "encore", "rivière", "pas"],
}
DOCS = "doc_id long, text string, lang string, held_out string, score string"


def _text(rng, lang, n):
    return " ".join(rng.choice(TEXT[lang]) + rng.choice(["", "s", "en", "."]) for _ in range(n))


def test_languages(spark):
    rng = random.Random(5)
    rows = [(i, _text(rng, lang := rng.choice(list(TEXT)), rng.choice([30, 60, 400])), lang, "h", "s") for i in range(300)]
    rows = [(i, t.upper() if i % 9 == 0 else t, lang, h, s) for i, t, lang, h, s in rows]
    odd = [(300, None, "aa"), (301, "", "aa"), (302, " 12 ?! \n", "bb"), (303, _text(rng, "bb", 100_000), None), (None, _text(rng, "cc", 50), "cc"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([*rows, *[(*r, "h", "s") for r in odd]], DOCS)
    learnt = languages.fit(docs)
    assert sorted(learnt.languages) == sorted(TEXT) and max(map(len, learnt.contents)) <= languages.DICTIONARY
    got = languages.identify(docs, learnt).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and by[302].score == 0 and by[302].rejected
    assert by[303].lang_pred == "bb" and by[None].lang_pred == "cc"
    truth = {i: lang for i, _, lang, _, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    kept = languages.keep_languages(docs, ["bb"], learnt)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.lang_pred == "bb" and not r.rejected}


def test_languages_sizes_are_those_of_every_piece():
    """Sizes are sums over the whole text; ties go to the first language and are rejected."""
    rng = random.Random(1)
    learnt = languages.Profiles(["aa", "bb"], [_text(rng, x, 500).encode() for x in ("aa", "bb")])
    text = _text(rng, "bb", 5000).encode()
    parts = [text[i : i + languages.PIECE] for i in range(0, len(text), languages.PIECE)]
    assert len(parts) > 3 and (learnt.sizes(memoryview(text)) == sum(learnt.sizes(memoryview(p)) for p in parts)).all()
    assert learnt.judge(memoryview(text))[0] == 1
    best, score, margin = learnt.judge(b"?x")
    assert (best, margin) == (0, 0.0) and 0 < score <= 1


def test_languages_without_training_rows(spark):
    docs = spark.createDataFrame([(5, "words here", None, "", ""), (6, None, "aa", "", "")], DOCS)
    assert languages.fit(docs) is None
    assert [(r.lang_pred, r.score) for r in languages.identify(docs, None).collect()] == [("und", 0.0)] * 2
    one = languages.Profiles(["zz"], [b"word"])
    assert sorted((r.lang_pred, r.rejected) for r in languages.identify(docs, one).collect()) == [("und", True), ("zz", False)]
    assert languages.identify(docs.where("false"), one).count() == 0 and languages.fit(docs.where("false")) is None


def _whitened(spark, rows, k=8, scale=1024):
    x = whitening.fixed_point(spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n string").repartition(3), scale, 100_000)
    found = whitening.fit(x, k)
    return found, {r.vec_id: r for r in whitening.whiten(x, found).collect()}


def test_whitening(spark):
    """Components against numpy's eigenvectors; deviations exact; columns of like scales and of
    scales a million times apart."""
    rng = np.random.default_rng(8)
    for stretch in (np.ones(12), np.logspace(0, 6, 12)):
        v = rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)) * stretch
        odd = [(2000, None, "w", "n"), (2001, [], "w", "n"), (2002, [1.0], "w", "n"), (2003, [float("inf")] * 12, "w", "n"), (2004, [None] * 12, "w", "n"), (2005, [1e300] * 12, "w", "n")]
        found, got = _whitened(spark, [(i, r.tolist(), "w", "n") for i, r in enumerate(v)] + odd)
        x = np.floor(1024 * v).astype(np.int64) + 100_000
        c = x - x.mean(0)
        value, vector = np.linalg.eigh(c.T @ c / 900)
        value, vector = value[::-1][:8], vector[:, ::-1][:, :8]
        assert len(got) == 900 and found.n == 900 and found.sums == x.sum(0).tolist() and found.error < 1e-9
        assert np.allclose(found.variances, value, rtol=1e-8) and np.isclose(found.trace, (c * c).sum() / 900, rtol=1e-10)
        assert np.allclose(abs((found.components * vector).sum(0)), 1, atol=1e-9)
        want = c @ vector / np.sqrt(value)
        mine = np.array([got[i].whitened for i in range(900)])
        assert np.allclose(abs(mine), abs(want), atol=1e-6)
        exact = {i: sum((900 * int(a) - int(s)) ** 2 for a, s in zip(x[i], x.sum(0), strict=True)) for i in range(0, 900, 50)}
        assert all(got[i].deviation == (t if t < 1 << 63 else None) for i, t in exact.items())


def test_whitening_of_flat_directions(spark):
    """Equal columns, constant columns, few rows, equal rows, none, and sums beyond a long."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 3))
    found, got = _whitened(spark, [(i, [a, b, c, a, 5.0, a + b], "w", "n") for i, (a, b, c) in enumerate((np.rint(v * 1024) / 1024).tolist())])
    assert found.components.shape == (6, 3) and found.error < 1e-9 and len(got[0].whitened) == 3
    found, got = _whitened(spark, [(1, [1.0, 2.0], "w", "n"), (2, [2.0, 4.0], "w", "n"), (None, [2.0, 4.0], "w", "n")])
    assert found.components.shape == (2, 1) and len(got) == 3 and found.error < 1e-9
    found, got = _whitened(spark, [(i, [1.0, 2.0], "w", "n") for i in range(4)])
    assert found is None and got == {}
    assert _whitened(spark, []) == (None, {})
    found, got = _whitened(spark, [(1, [1e12, 0.0], "w", "n"), (2, [-1e12, 1.0], "w", "n")])
    assert [got[i].deviation for i in (1, 2)] == [None, None] and found.error < 1e-9


def test_solve_and_cholesky():
    rng = np.random.default_rng(2)
    r = np.triu(rng.normal(size=(9, 9))) + 4 * np.eye(9)
    a = rng.normal(size=(50, 9))
    assert np.allclose(whitening.solve(a, r) @ r, a)
    flat = np.outer(np.ones(4), np.ones(4))
    assert np.allclose(whitening.cholesky(flat, 0.0).T @ whitening.cholesky(flat, 0.0), flat, atol=1e-3)
