"""Personal data by weak supervision, in DataFrame expressions only.

Base spans are the regular-expression matches that pass their checks; they always stay.
Candidates are these and looser shapes (addresses written with "at" and "dot", local phone
numbers, card-shaped numbers). Labelers vote 1, -1 or 0 on each candidate: a strict regex of
the kind (against base spans that miss it), a gazetteer (top-level domains, card issuers,
country codes), context words to the left, and the shape of the separators. Expectation-maximisation over the counts of vote patterns (at most
4 kinds x 3^4 rows, whatever the corpus size) estimates each labeler's reliability without
labels, and a naive Bayes span classifier is trained on the candidates' posteriors, over
features of bounded range. Candidates that it accepts are added unless they overlap a base
span of their kind.

Positions come from the lengths of the matches and of the text between them, so that every
pass stays inside the JVM; a document's spans are one array, no row is exploded but for
the aggregated training counts.

Defined cases: a null or empty text has no spans; texts are searched whole; repeated rows
and null ids give a row each; an empty table gives an empty result, with no model; further
columns are kept, but those named base, loose or added are replaced.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, documents

KINDS = ("email", "ip", "card", "phone")

# Runs are consumed possessively and may start only where a run starts or the previous match
# ended: the same matches as the plain patterns, without their quadratic rescans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
QUICK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,63}+)+",
    "phone": r"(?<![0-9A-Za-z+(./-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\x20-]?[0-9])",
}
# Fixed values of the labelers.
DOMAINS = "com org net edu gov mil int info biz io ai app dev co me tv de fr es uk it nl be eu ch at pl pt se no dk fi ie gr cz hu ro ru ua tr us ca mx br ar cl in cn jp kr au nz za"
ISSUERS = r"\A(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12})\z"
DIALLED = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 971 972"
STRICT = {
    "email": r"\A[a-z0-9](?:[._%+-]?[a-z0-9])*@(?:[a-z0-9](?:-?[a-z0-9])*\.)+[a-z]{2,}\z",
    "ip": r"\A(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}\z",
    "card": r"\A(?:[0-9]+|[0-9]{4}(?:([ -])[0-9]{4,7})(?:\1[0-9]{2,5})+)\z",
    "phone": r"\A\+?[0-9]{0,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,5})+\z",
}
CUES = {
    "email": "email|e-mail|mail|contact|write|correo|courriel|kontakt|reach",
    "ip": "ip|address|host|server|client|addr|from",
    "card": "card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|payment",
    "phone": "phone|tel|call|mobile|fax|cell|telefon|téléphone|teléfono|contact|reach",
}
AGAINST = "isbn|issn|order|invoice|version|serial|sku|doi|ticket|build|case"
LABELERS = ("regex", "gazetteer", "context", "shape")
LEFT, ACCEPT, ROUNDS, RUN = 32, 0.9, 50, 128


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    back = F.reverse(digits)

    def step(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _passes(kind: str, value):
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": F.regexp_like(value, F.lit(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")),
        "card": F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False)),
        "phone": n.between(10, 15),
    }[kind]


def _keeps(kind: str, span):
    return _passes(kind, span["value"])


def _is_kind(kind: int, span):
    return span["kind"] == kind


EMPTY = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text, pattern: str, quick: str | None):
    """(matches, texts between them) as arrays."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if quick is None:
        return found, gaps
    none = F.array().cast("array<string>")
    hit = F.contains(text, F.lit(quick))
    return F.when(hit, found).otherwise(none), F.when(hit, gaps).otherwise(none)


def _running(sizes):
    """Sums of an int array up to each place, in runs of ``RUN`` whose totals are summed first:
    an array is never rebuilt element by element over more than a run."""
    none = F.array().cast("array<int>")
    runs = F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: F.slice(sizes, k * RUN + 1, F.lit(RUN)))).otherwise(F.array().cast("array<array<int>>"))
    add = lambda begin: lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), begin) + x))
    total = lambda run: F.aggregate(run, F.lit(0), lambda t, x: t + x)
    ends = F.aggregate(F.transform(runs, total), none, add(F.lit(0)))
    begins = F.concat(F.array(F.lit(0)), ends)
    return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), F.slice(begins, F.lit(1), F.size(runs)).alias("begin")), lambda x: F.aggregate(x["run"], none, add(x["begin"]))))


def _placed(found, gaps, ends, kind: int):
    """Spans of the matches; ``ends`` are the running sums of gaps and matches."""
    pair = F.arrays_zip(found.alias("value"), ends.alias("end"))
    return F.transform(pair, lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``base`` and ``loose`` span arrays (start, kind, end,
    value, and left, the text before). Columns of these names are replaced."""
    rest = [c for c in docs.columns if c != text_col and c.lower() not in ("base", "loose", "added")]
    out = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    every = [("b", k, BASE[k], QUICK[k]) for k in KINDS] + [("l", k, p, "t" if k == "email" else None) for k, p in LOOSE.items()]
    for tag, kind, pattern, quick in every:
        found, gaps = _matches(F.col("t"), pattern, quick)
        out = out.withColumns({f"{tag}f_{kind}": found, f"{tag}g_{kind}": gaps})
    sizes = lambda tag, kind: F.transform(F.arrays_zip(F.col(f"{tag}f_{kind}").alias("f"), F.slice(f"{tag}g_{kind}", F.lit(1), F.size(f"{tag}f_{kind}")).alias("g")), lambda x: F.length(x["f"]) + F.length(x["g"]))
    out = out.withColumns({f"{tag}s_{kind}": sizes(tag, kind) for tag, kind, _, _ in every})
    out = out.withColumns({f"{tag}e_{kind}": _running(F.col(f"{tag}s_{kind}")) for tag, kind, _, _ in every})
    spans = {}
    for tag, kind, _, _ in every:
        found = _placed(F.col(f"{tag}f_{kind}"), F.col(f"{tag}g_{kind}"), F.col(f"{tag}e_{kind}"), KINDS.index(kind))
        spans[tag, kind] = F.filter(found, partial(_keeps, kind)) if tag == "b" else found
    with_left = lambda arr: F.transform(arr, lambda s: s.withField("left", F.lower(F.substring(F.col("t"), F.greatest(s["start"] - LEFT, F.lit(0)) + 1, F.least(s["start"], F.lit(LEFT))))))
    base = with_left(F.array_sort(F.concat(*[spans["b", k] for k in KINDS])))
    loose = with_left(F.array_sort(F.concat(*[spans["l", k] for k in LOOSE])))
    out = out.select(*[F.col("row").getField(c).alias(c) for c in rest], base.alias("base"), loose.alias("loose"))
    apart = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("loose", apart)


def _vote(yes, no=None):
    return (F.when(yes, 1) if no is None else F.when(yes, 1).when(no, -1)).otherwise(0)


def _by_kind(span, per_kind: dict):
    out = F.lit(None)
    for kind, value in per_kind.items():
        out = F.when(span["kind"] == KINDS.index(kind), value).otherwise(out)
    return out


def votes(span, is_base):
    """The labelers' votes on a span, in the order of LABELERS."""
    value, digits = F.lower(span["value"]), _digits(span["value"])
    domain = rf"(?:\.|dot[\])}}]?\x20?)(?:{DOMAINS.replace(' ', '|')})\z"
    known = _by_kind(span, {
        "email": _vote(F.regexp_like(value, F.lit(domain)), F.lit(True)),
        "ip": _vote(~F.regexp_like(value, F.lit(r"\A0")), F.regexp_like(value, F.lit(r"\A0+\."))),
        "card": _vote(F.regexp_like(digits, F.lit(ISSUERS)), F.lit(True)),
        "phone": _vote(F.regexp_like(value, F.lit(rf"\A(?:\+(?:{DIALLED.replace(' ', '|')})|\(?[2-9])")), F.regexp_like(value, F.lit(r"\A\+0"))),
    })
    cue = _by_kind(span, {k: _vote(F.regexp_like(span["left"], F.lit(rf"(?:{c})\W{{0,4}}(?:\w+\W{{1,3}})?\z")), F.regexp_like(span["left"], F.lit(rf"(?:{AGAINST})\W{{0,4}}(?:\w+\W{{1,3}})?\z"))) for k, c in CUES.items()})
    shape = _by_kind(span, {
        "email": _vote(F.regexp_like(value, F.lit(r"@|[\[({]at[\])}]"))),
        "ip": _vote(~F.regexp_like(value, F.lit(r"(?:\A|\.)0[0-9]")), F.lit(True)),
        "card": _vote(_luhn(digits), F.lit(True)),
        "phone": _vote(~F.regexp_like(value, F.lit(r"[0-9]{11}|\.[^0-9]")), F.lit(True)),
    })
    strict = _by_kind(span, {k: _vote(F.regexp_like(value, F.lit(p)), is_base) for k, p in STRICT.items()})
    return F.array(strict, known, cue, shape)


def features(span):
    """Bounded categories that the span classifier sees: shape, length, neighbourhood."""
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(span["value"], r"[A-Za-z]+", "a"), r"[0-9]+", "0"), r"[^a0@.+()\x20\[\]-]", "_"), 1, 8)
    shape = F.when(F.regexp_like(shape, F.lit(r"\A.{0,4}\z")), shape).otherwise(F.substring(shape, 1, 5))
    size = F.least(F.length(_digits(span["value"])), F.lit(20))
    cue = F.regexp_like(span["left"], F.lit("|".join(CUES.values())))
    bad = F.regexp_like(span["left"], F.lit(AGAINST))
    edge = F.regexp_extract(span["left"], r"(?:(\w)|([:=#])|(\S))?\s?\z", 0)
    edge = F.when(F.regexp_like(edge, F.lit(r"\w")), "w").when(F.regexp_like(edge, F.lit("[:=#]")), ":").otherwise("o")
    kind = span["kind"].cast("string")
    return F.array(*[F.concat_ws("|", F.lit(n), kind, v.cast("string")) for n, v in (("shape", shape), ("size", size), ("cue", cue), ("bad", bad), ("edge", edge))])


def fit_reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict:
    """EM for a two-class model with independent labelers. patterns: (kind, votes, count).
    Returns posterior of "is personal data" by (kind, votes)."""
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        post = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in own}  # starts at the majority
        for _ in range(rounds):
            yes = sum(n * post[v] for v, n in own)
            no = sum(n * (1 - post[v]) for v, n in own)
            odds = {v: math.log((yes + 1) / (no + 1)) for v, _ in own}
            for j in range(len(LABELERS)):
                for value in (-1, 0, 1):
                    a = (sum(n * post[v] for v, n in own if v[j] == value) + 1) / (yes + 3)
                    b = (sum(n * (1 - post[v]) for v, n in own if v[j] == value) + 1) / (no + 3)
                    for v in odds:
                        odds[v] += math.log(a / b) if v[j] == value else 0
            post = {v: 1 / (1 + math.exp(-max(-50.0, min(50.0, o)))) for v, o in odds.items()}
        out |= {(kind, v): p for v, p in post.items()}
    return out


def train(found: DataFrame) -> dict[str, float]:
    """Log-odds of the classifier by feature; "kind|k" is a kind's prior. Only aggregated
    counts of bounded categories reach the driver."""
    one = lambda arr, base: found.select(F.explode(arr).alias("s")).select(F.col("s.kind").alias("kind"), votes(F.col("s"), F.lit(base)).alias("v"), features(F.col("s")).alias("f"))
    spans = one("base", True).unionByName(one("loose", False))
    counted = spans.groupBy("kind", "v", "f").agg(F.count(F.lit(1)).alias("n"))
    by_vote = counted.groupBy("kind", "v").agg(F.sum("n").alias("n")).collect()
    post = fit_reliabilities([(r["kind"], tuple(r["v"]), r["n"]) for r in by_vote])
    if not post:
        return {}
    p = F.element_at(F.create_map(*[F.lit(x) for (k, v), q in post.items() for x in (f"{k}{v}", q)]), F.concat(F.col("kind").cast("string"), F.lit("("), F.array_join(F.transform("v", lambda x: x.cast("string")), ", "), F.lit(")")))
    soft = counted.withColumns({"yes": F.col("n") * p, "no": F.col("n") * (1 - p)}).withColumn("f", F.explode(F.concat("f", F.array(F.concat(F.lit("kind|"), F.col("kind").cast("string"))))))
    rows = soft.groupBy("kind", "f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    prior = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["f"].startswith("kind|")}
    model = {}
    for r in rows:
        yes, no = prior[r["kind"]]
        model[r["f"]] = math.log((yes + 1) / (no + 1)) if r["f"].startswith("kind|") else math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
    return model


def find_pii(docs: DataFrame, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``added`` spans (start, kind, end, value, left)."""
    found = cut(candidates(docs, text_col))
    model = train(found)
    if not model:
        return found.withColumn("added", F.slice("loose", 1, 0)).drop("loose")
    table = F.create_map(*[F.lit(x) for f, w in sorted(model.items()) for x in (f, w)])
    logit = lambda s: F.aggregate(F.concat(features(s), F.array(F.concat(F.lit("kind|"), s["kind"].cast("string")))), F.lit(0.0), lambda t, f: t + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    return found.withColumn("added", F.filter("loose", lambda s: logit(s) >= math.log(accept / (1 - accept)))).drop("loose")


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", partial(_is_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op1_pii(spark, sf_dir):
    return pii_report(documents(spark, sf_dir))
