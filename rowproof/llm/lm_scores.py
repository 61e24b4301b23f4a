"""Log-likelihoods of whole texts under a recurrent and a count language model.

Spark counts every word of the training texts, those with crc32(doc_id) mod 5 not 1. The
most frequent words, the end and one symbol for all other words are the symbols of a gated
recurrent network (gru.py). It starts at the words' shares and learns from every training text,
whole: in each of ``ROUNDS`` rounds the tasks run truncated backpropagation from the same
weights over their part of the texts (1 / ``PARTS`` of them a round, so every text is seen
ROUNDS / PARTS times), and the weights that they end with are averaged by Spark, by tokens and
in slices, so the driver sees one set of weights a round. A word outside the symbols has the
chance of that symbol times its smoothed share of the words outside, so ``score`` is the log10
chance of the whole text, word by word. The state is carried from window to window to the
text's end.

Counts of at most ``FREQUENT`` words, cut at a count so that the bound holds, are broadcast;
all rarer words are looked up by a shuffled join, so no table that grows with the corpus is
sent anywhere whole. Words are told apart by 64-bit hashes (words.py).

Defined cases: null and empty texts are the end alone; rows are scored singly, repeats and
null ids too (a null id counts as the text "" for the fold, so it trains); without training
texts all counts are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blas import one_thread
from .gru import END, UNKNOWN, Gru
from .store import cut, documents
from .words import hashed_batches

SYMBOLS, FREQUENT = 1024, 1 << 18
ROUNDS, PARTS = 4, 4
NARROW, WIDE, TOKENS = 32, 512, 1 << 17  # lanes of a task's first TOKENS tokens in the first round, lanes then
SLICE = 4096  # weights in a row


def held_out(doc_id):
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 5 == 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c): the hash and count of every word of ``texts`` (text)."""

    def run(batches):
        for _, _, h, _, _, _ in hashed_batches(batches, lower=True):
            w, c = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    return texts.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int):
    """(hashes, counts) of the words at or above the lowest count that keeps them within
    ``most``, by falling count; from a histogram over eighths of an octave."""
    octave = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(octave.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for b, n in bins:
        if total + n > most:
            break
        total, least = total + n, b
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(octave >= least).select("w", "c").toPandas().sort_values(["c", "w"], ascending=[False, True])
    return found["w"].to_numpy(np.int64), found["c"].to_numpy(np.int64)


class Lookup:
    """Symbol and count of a word's hash; count -1 where the word is not in the table."""

    def __init__(self, w: np.ndarray, c: np.ndarray, symbols: int):
        order = np.argsort(w)
        self.w, self.c = w[order], c[order]
        number = np.where(np.arange(len(w)) < symbols - 2, np.arange(len(w)) + 2, UNKNOWN)
        self.symbol = number[order].astype(np.int32)
        few = np.flatnonzero(self.symbol != UNKNOWN)
        self.few, self.few_symbol = self.w[few], self.symbol[few]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbols alone: a search among the words that have one."""
        h = h.view(np.int64)
        if not len(self.few):
            return np.full(len(h), UNKNOWN, np.int32)
        at = np.minimum(np.searchsorted(self.few, h), len(self.few) - 1)
        return np.where(self.few[at] == h, self.few_symbol[at], UNKNOWN).astype(np.int32)

    def __call__(self, h: np.ndarray):
        h = h.view(np.int64)
        if not len(self.w):
            return np.full(len(h), UNKNOWN, np.int32), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.w, h), len(self.w) - 1)
        hit = self.w[at] == h
        return np.where(hit, self.symbol[at], UNKNOWN).astype(np.int32), np.where(hit, self.c[at], -1)


def train_round(learn: DataFrame, held, first: bool) -> np.ndarray | None:
    """One round over ``learn`` (text) from the weights in ``held``, a broadcast (table, model):
    the mean of the tasks' weights, each by the tokens that it saw; None without texts. In the
    first round a task begins with few lanes, so with many small steps."""

    def run(batches):
        one_thread()
        table, model = held.value
        model, moments, seen, texts, size = copy.deepcopy(model), None, 0, [], 0
        for batch in batches:
            for _, _, h, at, _, _ in hashed_batches([batch], lower=True):
                number = table.symbols(h)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    texts.append(np.r_[number[a:b], END])
                    size += b - a + 1
                    if size >= (TOKENS if first and not seen else 8 * TOKENS):
                        moments = model.train(texts, moments, NARROW if first and not seen else WIDE)
                        seen, texts, size = seen + size, [], 0
        if texts:
            moments = model.train(texts, moments, NARROW if first and not seen else WIDE)
            seen += size
        if seen:
            values = model.flat()
            parts = [values[i : i + SLICE] for i in range(0, len(values), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([p.astype(np.float64) * seen for p in parts], pa.list_(pa.float64()))], names=["part", "seen", "total"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in rows.column("total")], 0)
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "seen": pa.array([sum(rows.column("seen").to_pylist())], pa.int64()), "total": pa.array([total], pa.list_(pa.float64()))})

    schema = "part int, seen long, total array<double>"
    own = learn.select("text").mapInArrow(run, schema).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    # twice, so that however many tasks there are, a group holds few of their weights
    some = own.groupBy("part", "salt").applyInArrow(lambda rows: add(rows), schema)
    rows = sorted(some.groupBy("part").applyInArrow(lambda rows: add(rows), schema).collect(), key=lambda r: r["part"])
    return np.concatenate([np.array(r["total"]) / r["seen"] for r in rows]) if rows else None


def lm_scores(docs: DataFrame, symbols: int = SYMBOLS, most: int = FREQUENT, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    context = docs.sparkSession.sparkContext
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    learn = own.where("not held_out")
    counts = cut(word_counts(learn))
    n_texts = learn.count()
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, kinds = total + n_texts, kinds + (n_texts > 0)
    w, c = frequent(counts, most)
    table = Lookup(w, c, symbols)
    outside = total - int(c[: symbols - 2].sum())
    base_mass = np.log10(n + 0.5 * (kinds + 1))
    outside_mass = np.log10(outside + 0.5 * (max(0, kinds - 1 - min(len(w), symbols - 2)) + 1))
    end_chance = np.log10(n_texts + 0.5) - base_mass

    model = Gru(symbols)
    if n_texts:
        model.start_at(np.r_[n_texts, outside, np.pad(c[: symbols - 2], (0, max(0, symbols - 2 - len(c))))].astype(float))
        for k in range(rounds):
            held = context.broadcast((table, model))
            now = train_round(learn.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k % parts), held, k == 0)
            if now is not None:
                model = copy.deepcopy(model)
                model.unflat(now)
    held = context.broadcast((table, model))

    def run(batches):
        one_thread()
        table, model = held.value
        for batch in batches:
            texts, tokens, known, base, score, rare = [], [], [], [], [], []
            for _, _, h, at, _, _ in hashed_batches([batch], lower=True):
                number, count = table(h)
                seen = count >= 0
                log_c = np.where(seen, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                sums = [np.r_[0, np.cumsum(x)] for x in (seen, np.where(seen, log_c - base_mass, 0), np.where(seen & (number == UNKNOWN), log_c - outside_mass, 0))]
                missing = np.flatnonzero(~seen)
                edge = np.searchsorted(missing, at)
                words = h.view(np.int64)[missing]
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    texts.append(np.r_[number[a:b], END].astype(np.int32))
                    tokens.append(b - a + 1)
                    known.append(int(sums[0][b] - sums[0][a]) + (n_texts > 0))
                    base.append(float(sums[1][b] - sums[1][a]) + float(end_chance))
                    score.append(float(sums[2][b] - sums[2][a]))
                    rare.append(words[edge[k] : edge[k + 1]])
            score = np.array(score) + model.score(texts)
            flat = pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64))
            offsets = pa.array(np.cumsum([0, *(len(x) for x in rare)]).astype(np.int32))
            cols = [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    kind = dict(own.dtypes)["doc_id"]
    rows = own.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>")
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    asked = rows.select("rid", F.explode("rare").alias("w")).groupBy("rid", "w").agg(F.count(F.lit(1)).alias("times"))
    found = asked.join(counts, "w", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"),
        F.sum("times").alias("all"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return rows.join(found, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more")).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - zero("all") * float(base_mass)).alias("base_score"),
        (F.col("score") + zero("logs") - zero("all") * float(outside_mass)).alias("score"),
    )


def op6_lm_scores(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir))
