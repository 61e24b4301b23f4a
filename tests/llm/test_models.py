"""The trained operators: base figures against brute force, models by held-out quality."""

import collections
import math
import random
import re
import zlib

from rowproof.llm import lm_scores, pii, quality, urls

DOCS = "doc_id long, text string, source string, lang string"


def test_pii_base_spans(spark):
    texts = ["write a.b@x.com%c@y.org or 300.1.2.3.4, 10.0.0.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (319) 555-5132 é +12 34", None, "", "x" * 5000 + "@"]
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, v):
        d = [int(c) for c in re.sub("[^0-9]", "", v)]
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)).collect()}
    import hashlib

    for i, t in enumerate(texts):
        spans = sorted((m.start(), n, m.end(), k) for n, (k, f) in enumerate(forms.items()) for m in re.finditer(f, t or "") if good(k, m.group()))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def test_pii_many_matches(spark):
    """Positions of thousands of matches in one text, and columns of the operator's own names."""
    text = " ".join(f"user{i}@mail{i % 7}.org 10.0.{i % 256}.1" for i in range(4000))
    docs = spark.createDataFrame([(1, text, "b", "x", "y"), (None, "", "b", None, None)], "doc_id long, text string, base string, t string, row string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    spans = [(s.start, s.end) for s in got[1].base]
    assert spans == sorted(m.span() for m in re.finditer(r"user\d+@mail\d\.org|10\.0\.\d+\.1", text)) and (got[1].t, got[1].row) == ("x", "y")
    assert got[None].base == [] and pii.pii_report(docs.where("false")).count() == 0


def test_pii_added_spans(spark):
    """Loose shapes are added where labelers agree on them, by EM and the classifier it trains."""
    lines = [f"contact: write to ann{i} (at) mail{i}.com or phone 319-555-{1000 + i}" for i in range(40)] + [f"mail bob{i}@site{i}.org, call +1 319 555 {2000 + i}" for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    for i, line in enumerate(lines):
        want = [(m.start(), m.end()) for m in re.finditer(r"ann\d+ \(at\) mail\d+\.com|bob\d+@site\d+\.org", line)]
        assert all(f"email:{a}:{b}" in got[i].split(",") for a, b in want)
    post = pii.fit_reliabilities([(0, (1, 1, 1, 1), 50), (0, (-1, -1, 0, -1), 50), (0, (1, 1, 0, 1), 5), (0, (-1, 1, 0, -1), 5)])
    assert post[0, (1, 1, 1, 1)] > 0.9 > 0.1 > post[0, (-1, -1, 0, -1)] and post[0, (1, 1, 0, 1)] > post[0, (-1, 1, 0, -1)]


def test_lm_beats_base(spark):
    """On texts with an order to learn, held-out ones are likelier than word counts make them."""
    rng = random.Random(7)
    walk = lambda n: " ".join(f"w{(rng.randrange(12) * 3 + 7 * k) % 36}" for k in range(n))
    rows = [(i, walk(rng.randrange(20, 200))) for i in range(300)] + [(None, None), (400, walk(20000)), (401, "unseen words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scores.lm_scores(docs).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(math.isfinite(r.score) for r in got)
    assert lm_scores.lm_scores(docs.where("false")).count() == 0 and lm_scores.lm_scores(docs.where("doc_id is null")).count() == 1


def test_lm_gradients():
    """Backpropagation against differences of the loss."""
    import numpy as np

    from rowproof.llm.gru import Gru

    g = Gru(40, 4)
    g.w = {n: x.astype(np.float64) for n, x in g.w.items()}
    target = np.array([[3, 5], [7, -1], [0, -1], [33, -1]])
    start = np.zeros((2, 4)), np.zeros(2, int)

    def loss():
        h, last = start
        total = 0.0
        for row in target:
            h = g.step(last, h * (last != 0)[:, None])[0]
            real = row >= 0
            total -= g.log_chance(h[real], row[real]).sum()
            last = np.maximum(row, 0)
        return total

    grads = g._window(target, *start)[0]
    scale = (target >= 0).sum() / len(target)
    for name, at in (("rec", (1, 2)), ("rec", (2, 9)), ("inp", (3, 4)), ("inp", (3, 10)), ("cls", (1, 0)), ("sym", (0, 5, 2)), ("sym", (1, 1, 4))):
        kept = g.w[name][at]
        found = []
        for step in (1e-4, -1e-4):
            g.w[name][at] = kept + step
            found.append(loss())
        g.w[name][at] = kept
        assert abs((found[0] - found[1]) / 2e-4 - grads[name][at] * scale) < 1e-3


def test_lm_base_scores(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "cat", "sat", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, ""]
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = collections.Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    for most in (1 << 18, 8):  # with every word broadcast, and with most of them joined
        got = {r.doc_id: r for r in lm_scores.lm_scores(docs, symbols=64, most=most).collect()}
        for i, ws in enumerate(words):
            want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert abs(got[i].base_score - want) < 1e-6 and got[i].n_known == sum(c[w] > 0 for w in ws)
            assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (held[i], len(ws), n) and got[i].score < 0


def test_quality_held_out(spark):
    rng = random.Random(5)
    make = lambda good: " ".join(f"{'word' if good else '#@!'}{rng.randrange(99)}" for _ in range(40))
    rows = [(i, make(i % 3 > 0), f"s{i % 4}", "en") for i in range(300)] + [(300, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200)], "doc_id long, quality int")
    got = {r.doc_id: r.accepted for r in quality.score(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == 301 and sum(got[i] == (i % 3 > 0) for i in range(200, 300)) >= 95


def test_url_model(spark):
    """Chances, scores and threshold of the character models against plain Python."""
    rng = random.Random(6)
    path = lambda good: "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(8))
    ruled_ = [(i, f"http://x{i % 9}.org/fr/{path(True)}") for i in range(60)] + [(100 + i, f"http://y{i % 9}.net/{path(False)}") for i in range(60)]
    free = [(200 + i, f"http://z.io/{path(i % 2 == 0)}") for i in range(40)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([*ruled_, *free, (300, "http://z.io/"), (300, "http://z.io/")], "page_id long, url string")).collect()}
    known = {u: "org/fr" in u for _, u in ruled_}
    held = {r.url for r in spark.createDataFrame([(u,) for u in known], "url string").where("pmod(xxhash64(url), 5) = 0").collect()}
    n = collections.Counter()
    grams = lambda u: [(t[i : i + 4], t[i + 4]) for t in ["\x02" * 4 + u.lower() + "\x03"] for i in range(len(t) - 4)]
    for u, good in known.items():
        if u not in held:
            n.update((good, c[4 - k :] if k else "", ch) for c, ch in grams(u) for k in range(5))
    seen = {}
    for (good, c, ch), count in n.items():
        seen.setdefault((good, c), {})[ch] = count

    def chance(good, ctx, ch):
        p = 1 / 256
        for k in range(5):
            own = seen.get((good, ctx[4 - k :] if k else ""), {})
            if own:
                p = (own.get(ch, 0) + len(own) * p) / (sum(own.values()) + len(own))
        return p

    for i, u in [*ruled_, *free]:
        g = grams(u)
        want = sum(math.log(chance(True, c, ch)) - math.log(chance(False, c, ch)) for c, ch in g) / len(g)
        assert abs(got[i].score - want) < 1e-9
    assert sum((got[200 + i].verdict == "allow") == (i % 2 == 0) for i in range(40)) >= 36
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality_rounds(spark):
    """Bins, weights and pseudo-labels of every round against plain Python."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    cols = [*quality.TEXT, *quality.META]
    data = []
    for i in range(400):
        good = rng.random() < 0.7
        bins = [min(4, max(0, int(rng.gauss(3 if good else 1, 1)))) for _ in cols]
        data.append((int(good) if i < 200 else None, i % 5 == 0, *bins))
    rows = spark.createDataFrame(data, "quality int, held boolean, " + ", ".join(f"{c} int" for c in cols))
    text, meta, _, _ = quality.co_train(rows, rounds=1)
    at = {c: k + 2 for k, c in enumerate(cols)}

    def learn(taught, names):
        good, bad = sum(y for _, y in taught), sum(not y for _, y in taught)
        out = {"": math.log((good + 1) / (bad + 1))}
        for c in names:
            seen = {r[at[c]] for r, _ in taught}
            for b in seen:
                g, x = sum(y and r[at[c]] == b for r, y in taught), sum(not y and r[at[c]] == b for r, y in taught)
                out[c, b] = math.log((g + 1) / (good + len(seen) + 1)) - math.log((x + 1) / (bad + len(seen) + 1))
        return out

    value = lambda w, r, names: w[""] + sum(w.get((c, r[at[c]]), 0) for c in names)
    base = [(r, r[0] == 1) for r in data if r[0] is not None and not r[1]]
    free = [r for r in data if r[0] is None]
    views = [(quality.TEXT, learn(base, quality.TEXT)), (quality.META, learn(base, quality.META))]
    good = sum(y for _, y in base) / len(base)
    told = []
    for names, w in views:
        z = sorted(value(w, r, names) for r in free)
        low, high = (z[max(0, math.ceil(p * len(z)) - 1)] for p in (quality.SHARE * (1 - good), 1 - quality.SHARE * good))
        edge = math.log(quality.SURE / (1 - quality.SURE))
        told.append([(r, value(w, r, names) >= max(edge, high)) for r in free if value(w, r, names) >= max(edge, high) - 1e-12 or value(w, r, names) <= min(-edge, low) + 1e-12])
    for view, names, other in ((text, quality.TEXT, 1), (meta, quality.META, 0)):
        want = learn(base + told[other], names)
        assert abs(view.prior - want[""]) < 1e-9 and all(abs(w - want[c, b]) < 1e-9 for c, of in view.weights.items() for b, w in of.items())
    none = quality.score(spark.createDataFrame([(1, "a", None, None)], DOCS), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert [(r.score, r.accepted) for r in none] == [(1.0, True)]
    assert rows.select(F.count("*")).first()[0] == 400


def test_url_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q"), (2, "http://b.net/fr/1"), (3, "http://x.org/fr/2#a"), (4, "http://example.com/de/"), (5, None), (6, "no scheme"), (7, "http://notnet/"), (8, "http://y.org/fr/3")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("x.org", "/fr/2", "org/fr/", "allow") and got[4][2:] == ("example.com/de/", "block")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][2] is None
