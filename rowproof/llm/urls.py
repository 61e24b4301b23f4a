"""URL filter by the ratio of two character language models, in DataFrame operations only.

Rules decide where they fit; the URLs that they allow and block train one Markov model each.
A model's order varies: the chance of a character is mixed from contexts of 0 to ``ORDER``
characters, each weighing its counts against the shorter context's chance by the number of
different characters seen in it (Witten-Bell); contexts never seen fall through. A URL's
score is the log-likelihood difference per character, and the threshold between allow and
block is calibrated on a held-out fifth of the distinct labelled URLs, for the largest mean
of both classes' accuracy.

Chances are worked out once per distinct (context, character) of all URLs, with a shuffled
join on it, then summed per distinct URL, so repeated URLs and common characters cost one
row each; the driver sees a histogram of 1,001 bins.

Defined cases: host and path of a null URL or one without "://" are empty; without labelled
URLs of both kinds every other URL is allowed; repeated rows and null ids give a row each; URLs
are read whole; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

ORDER = 4  # longest context
#: (action, host, path); a fixed list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGE = "\x02"


def parts(url):
    """(host, path) of a URL."""
    pattern = r"(?s)\A(?:(?!://).)*+://([^/?#]*)([^?#]*)"
    found = F.coalesce(F.regexp_like(url, F.lit(pattern)), F.lit(False))
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.when(found, host).otherwise(""), F.when(found, F.regexp_extract(url, pattern, 2)).otherwise("")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, action: the longest rule that fits."""
    host, path = parts(F.col("url"))
    out = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return out.withColumns({"rule": rule, "action": action})


def _grams(urls: DataFrame) -> DataFrame:
    """(url, ..., ctx, ch) for every character of the lower-cased URL and its end; ctx is the
    ORDER characters before it, filled up at the start."""
    urls = urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a URL is many rows
    text = F.concat(F.lit(EDGE * ORDER), F.translate("url", UPPER, LOWER), F.lit("\x03"))
    at = urls.withColumn("t", text).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("t") - ORDER)))
    return at.withColumns({"ctx": F.substring("t", F.col("i"), F.lit(ORDER)), "ch": F.substring("t", F.col("i") + ORDER, F.lit(1))}).drop("t", "i")


def char_models(labelled: DataFrame) -> list[DataFrame]:
    """By order k = 0..ORDER: (ctx, ch, n_ok, n_bad, all_ok, all_bad, kinds_ok, kinds_bad)."""
    full = cut(_grams(labelled).groupBy("ctx", "ch").agg(*[F.count_if(F.col("action") == a).alias(f"n_{n}") for a, n in (("allow", "ok"), ("block", "bad"))]))
    out = []
    for k in range(ORDER + 1):
        ctx = F.substring("ctx", ORDER + 1 - k, k) if k else F.lit("")
        own = full.withColumn("ctx", ctx).groupBy("ctx", "ch").agg(F.sum("n_ok").alias("n_ok"), F.sum("n_bad").alias("n_bad"))
        by = own.groupBy("ctx").agg(*[f(n).alias(f"{name}_{n}") for n in ("ok", "bad") for name, f in (("all", lambda x: F.sum(f"n_{x}")), ("kinds", lambda x: F.count_if(F.col(f"n_{x}") > 0)))])
        out.append((cut(own), cut(by)))
    return out


def gram_ratios(wanted: DataFrame, models) -> DataFrame:
    """(ctx, ch) -> llr: log chance of ch after ctx under "allow" less that under "block"."""
    out = wanted.withColumns({"p_ok": F.lit(1 / 256), "p_bad": F.lit(1 / 256)})
    for k, (own, by) in enumerate(models):
        c = F.substring("ctx", ORDER + 1 - k, k) if k else F.lit("")
        own = own.select(F.col("ctx").alias("c"), F.col("ch").alias("h"), F.col("n_ok").alias("x_ok"), F.col("n_bad").alias("x_bad"))
        by = by.withColumnRenamed("ctx", "d")
        out = out.withColumn("k", c)
        out = out.join(own, (F.col("k") == F.col("c")) & (F.col("ch") == F.col("h")), "left").join(by, F.col("k") == F.col("d"), "left")
        mixed = {}
        for n in ("ok", "bad"):
            seen = F.coalesce(F.col(f"all_{n}") + F.col(f"kinds_{n}"), F.lit(0))
            mixed[f"p_{n}"] = F.when(seen > 0, (F.coalesce(F.col(f"x_{n}"), F.lit(0)) + F.col(f"kinds_{n}") * F.col(f"p_{n}")) / seen).otherwise(F.col(f"p_{n}"))
        out = out.withColumns(mixed).select("ctx", "ch", "p_ok", "p_bad")
    return out.select("ctx", "ch", (F.log("p_ok") - F.log("p_bad")).alias("llr"))


def url_scores(urls: DataFrame, models) -> DataFrame:
    """(url) distinct -> (url, score): log-likelihood difference per character."""
    grams = cut(_grams(urls).groupBy("url", "ctx", "ch").agg(F.count(F.lit(1)).alias("n")))
    ratios = cut(gram_ratios(grams.select("ctx", "ch").distinct(), models))
    return grams.join(ratios, ["ctx", "ch"]).groupBy("url").agg((F.sum(F.col("llr") * F.col("n")) / F.sum("n")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score that parts held-out (action, score) best."""
    bin_ = F.greatest(F.lit(-500), F.least(F.lit(500), F.floor(F.col("score") * 100).cast("int")))
    rows = sorted(tuple(r) for r in scored.groupBy(bin_.alias("b")).agg(F.count_if(F.col("action") == "allow"), F.count_if(F.col("action") == "block")).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, low, at = -1.0, 0, 0.0
    kept, before = good, rows[0][0]
    for b, g, x in [*rows, (501, 0, 0)]:
        value = kept / good + low / bad
        if value > best:
            best, at = value, (before + b) / 200  # all scores between two bins part alike
        kept, low, before = kept - g, low + x, b + 1
    return at


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score."""
    rows = ruled(pages, rules)
    urls = cut(rows.where("url is not null").select("url", "action").distinct())
    known = urls.where("action is not null")
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    models = char_models(known.where(~held))
    scores = cut(url_scores(urls.select("url"), models))
    at = threshold(known.where(held).join(scores, "url"))
    both = known.agg(F.countDistinct("action")).first()[0] == 2
    verdict = F.coalesce("action", F.when(F.col("score") >= (at if both else float("-inf")), "allow").when(F.col("score").isNotNull(), "block").otherwise("allow"))
    return rows.join(scores, "url", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op7_urls(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
