"""Quality classifier by co-training of two views.

The text view sees statistics of the content, the metadata view the source, language and
length. Each is a generalised naive Bayes classifier: a statistic falls into one of ``CUTS`` + 1
bins, a name into a hash bucket, and each bin of each column has a log-odds weight from how
often the two classes fall into it. Both start from the labelled rows. In each round either
view labels the documents without label that it is surest of, for the other view to learn
from: those beyond ``SURE`` and among the ``SHARE`` of each class that it ranks highest, more in
later rounds. All documents take part in every round: what a view has learnt is an expression,
its scores' quantiles and the next counts are one aggregation each, and the driver sees counts
by bin and class, never rows.

A fifth of the labelled rows, by the hash of doc_id, teaches neither view. On it each view's
log-odds are calibrated and the calibrated views are combined, by logistic regressions on a
histogram of both scores. Thresholds of the statistics are quantiles of all documents.

Defined cases: null and empty texts have zero statistics; null source or language is a bucket
of its own; labels that are null are ignored, of repeated labels of one document the smallest
counts; without labels of both kinds, both among the rows that teach and among those held
back, nothing can be learnt and every document is accepted with score 1; rows are scored and
kept or dropped singly, whatever their id; texts are read whole; an empty table gives an empty
result; other columns, whatever their names, are passed over by the report and kept by the
filter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, documents, free_name

ROUNDS, SURE, SHARE = 4, 0.97, 0.05
CUTS, SOURCES, LANGS = 15, 64, 16
ACCEPT = 0.5
TEXT = ("words", "word_length", "distinct", "upper", "digits", "marks", "bars", "bangs", "stops", "short_lines", "repeats", "common")
META = ("length", "source", "lang")
STATS = (*TEXT, "length")  # binned by thresholds; source and lang are buckets already
ACCURACY = 1e-4  # relative error of quantiles


def describe(text, source, lang) -> dict:
    """The statistics of both views as expressions over a row's own columns."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    w = F.regexp_extract_all(t, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    size, n = F.greatest(F.length(t), F.lit(1)).cast("double"), F.greatest(F.size(w), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)) / size
    bucket = lambda c, k: F.pmod(F.xxhash64(c.cast("string")), F.lit(k)).cast("int")
    return {
        "words": F.log1p(F.size(w)), "word_length": size / n, "distinct": F.size(F.array_distinct(w)) / n, "upper": count(r"\p{Lu}"), "digits": count("[0-9]"),
        "marks": count(r"[*#&%$@=^~<>{}\[\]\\]"), "bars": count(r"\|"), "bangs": count("[!?]"), "stops": count("[.,;:]"), "short_lines": count(r"(?m)^[^\n]{0,20}$"),
        "repeats": count(r"([^\x20\x09-\x0D]++)\x20\1(?![^\x20\x09-\x0D])"), "common": F.size(F.filter(w, lambda x: F.length(x) <= 3)) / n,
        "length": F.log1p(F.length(t)), "source": bucket(source, SOURCES), "lang": bucket(lang, LANGS),
    }


def _bin(value, cuts: list[float]):
    """Number of thresholds below ``value``."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < value)) if cuts else F.lit(0)


class View:
    """Log-odds of one view by column and bin, with the log-odds of the classes."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.prior, self.weights = columns, 0.0, {}

    def learn(self, counts: dict, totals: tuple[float, float]) -> None:
        """counts: (column, bin) -> (good, bad)."""
        good, bad = totals
        self.prior = math.log((good + 1) / (bad + 1))
        self.weights = {}
        for c in self.columns:
            own = {b: n for (name, b), n in counts.items() if name == c}
            self.weights[c] = {b: math.log((g + 1) / (good + len(own) + 1)) - math.log((x + 1) / (bad + len(own) + 1)) for b, (g, x) in own.items()}

    def column(self, bins=F.col):
        """The log-odds of a row as an expression over its bins."""
        out = F.lit(self.prior)
        for c in self.columns:
            of = self.weights.get(c)
            if of:
                table = F.array(*[F.lit(float(of.get(b, 0.0))) for b in range(max(of) + 1)])
                out = out + F.coalesce(F.get(table, bins(c)), F.lit(0.0))
        return out


def _counted(rows: DataFrame, columns: tuple[str, ...]):
    """(counts by (column, bin), totals) of ``rows`` with a label y."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("int").alias("b")) for c in columns]))
    found = rows.select("y", each.alias("x")).groupBy("x.c", "x.b").agg(F.count_if("y").alias("good"), F.count_if(~F.col("y")).alias("bad")).collect()
    counts = {(r["c"], r["b"]): (r["good"], r["bad"]) for r in found}
    own = [n for (c, _), n in counts.items() if c == columns[0]]
    return counts, (sum(g for g, _ in own), sum(x for _, x in own))


def _fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (n * (p - y)) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def co_train(rows: DataFrame, rounds: int = ROUNDS):
    """``rows`` (bins of both views, quality 0, 1 or null, held) -> (text view, metadata view,
    calibrations, combining weights), or None where nothing can be learnt."""
    y = F.col("quality") > 0
    kinds = rows.where("quality is not null").groupBy("held").agg(F.count_if(y).alias("good"), F.count_if(~y).alias("bad")).collect()
    of = {r["held"]: (r["good"], r["bad"]) for r in kinds}
    if min(*of.get(True, (0, 0)), *of.get(False, (0, 0))) == 0:
        return None
    good, bad = of[False]
    taught = rows.where("quality is not null and not held").withColumn("y", y)
    free = rows.where("quality is null")
    views = (View(TEXT), View(META))
    own = [_counted(taught, v.columns) for v in views]
    for v, (counts, totals) in zip(views, own, strict=True):
        v.learn(counts, totals)
    edge = math.log(SURE / (1 - SURE))
    for k in range(1, rounds + 1):
        share = SHARE * k * good / (good + bad), SHARE * k * bad / (good + bad)
        scored = free.withColumns({f"s{i}": v.column() for i, v in enumerate(views)})
        ends = scored.agg(*[F.percentile_approx(f"s{i}", [share[1], 1 - share[0]], int(1 / ACCURACY)).alias(f"q{i}") for i in (0, 1)]).first()
        if ends["q0"] is None:
            break
        sure = [(F.col(f"s{i}") >= max(edge, ends[f"q{i}"][1]), F.col(f"s{i}") <= min(-edge, ends[f"q{i}"][0])) for i in (0, 1)]
        for i, v in enumerate(views):  # each learns from what the other is sure of
            yes, no = sure[1 - i]
            counts, totals = _counted(scored.where(yes | no).withColumn("y", yes), v.columns)
            (known, of_known) = own[i]
            both = {x: (known.get(x, (0, 0))[0] + counts.get(x, (0, 0))[0], known.get(x, (0, 0))[1] + counts.get(x, (0, 0))[1]) for x in known.keys() | counts.keys()}
            v.learn(both, (of_known[0] + totals[0], of_known[1] + totals[1]))
    # held-out labels by both scores, to a tenth; at most some thousands of rows
    near = lambda v: F.round(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), v.column())), 1)
    seen = rows.where("quality is not null and held").groupBy(near(views[0]).alias("a"), near(views[1]).alias("b"), y.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    z, label, n = np.array([[r["a"], r["b"]] for r in seen]), np.array([float(r["y"]) for r in seen]), np.array([float(r["n"]) for r in seen])
    calibrated = [_fit_logistic(z[:, [i]], label, n, 1e-2) for i in (0, 1)]
    joined = np.stack([z[:, i] * calibrated[i][0] + calibrated[i][1] for i in (0, 1)], 1)
    return (*views, calibrated, _fit_logistic(joined, label, n, 1e-2))


def fit(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", stat=F.col):
    """What scoring needs: (thresholds of the statistics, model or None). ``found`` holds every
    document's statistics, ``stat`` the expression of one."""
    at = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    ends = found.agg(*[F.percentile_approx(stat(c), at, int(1 / ACCURACY)).alias(c) for c in STATS]).first()
    cuts = {c: sorted(set(ends[c] or [])) for c in STATS}
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    bins = found.select(F.col(id_col).alias("id"), (F.pmod(F.xxhash64(id_col), F.lit(5)) == 0).alias("held"), *[(_bin(stat(c), cuts[c]) if c in cuts else stat(c)).alias(c) for c in (*TEXT, *META)])
    return cuts, co_train(cut(bins.join(known, "id", "left").drop("id")))


def scores(fitted, stat=F.col) -> dict:
    """text_score, meta_score, score and accepted as expressions over a row's statistics."""
    cuts, model = fitted
    if model is None:
        one = F.lit(1.0)
        return {"text_score": one, "meta_score": one, "score": one, "accepted": F.lit(True)}
    text, meta, (ct, cm), w = model
    a, b = (v.column(lambda c: _bin(stat(c), cuts[c]) if c in cuts else stat(c)) for v in (text, meta))
    za, zb = a * float(ct[0]) + float(ct[1]), b * float(cm[0]) + float(cm[1])
    chance = lambda z: 1 / (1 + F.exp(-z))
    score = chance(za * float(w[0]) + zb * float(w[1]) + float(w[2]))
    return {"text_score": chance(za), "meta_score": chance(zb), "score": score, "accepted": score >= ACCEPT}


def _described(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` with all statistics in the column ``name``; written once, as
    working them out is most of the cost."""
    stats = F.struct(*[c.alias(n) for n, c in describe(F.col("text"), F.col("source"), F.col("lang")).items()])
    return cut(docs.select(*keep, stats.alias(name)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score, accepted for every row of ``docs``."""
    found = _described(docs, ["doc_id"], "stats").select("doc_id", "stats.*")
    return found.select("doc_id", *[c.alias(n) for n, c in scores(fit(found, labels)).items()])


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; columns unchanged."""
    name = free_name(docs, "stats")
    found, stat = _described(docs, docs.columns, name), lambda c: F.col(f"{name}.{c}")
    return found.where(scores(fit(found, labels, "doc_id", stat), stat)["accepted"]).select(*docs.columns)


def op2_quality(spark, sf_dir):
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
