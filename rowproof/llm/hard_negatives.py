"""Hard negatives of anchors by the threshold algorithm.

Rows become integer vectors; the score of a row is its inner product with the anchor. The
rows are dealt into blocks, and anchors into groups, so that one task holds one block and one
group and every anchor meets every block that can matter to it. A block sorts its rows once
for every dimension. For an anchor, the lists are read in step, from the top where the
anchor's entry is positive and from the bottom where it is negative (sorted access); rows met
for the first time are scored whole (random access). What the anchor's entries make of the
values just read is the threshold: no row that is still unread can score more. Reading stops
once the threshold lies strictly below the kth score found, so ties are never cut off.

Positives come first: blocks of the anchor's own label give their best rows, and the best of
all blocks are the positives. Each distinct score s of a positive opens a window from s/2 to
0.95 s; in a second pass, blocks give the best rows of other labels inside every window, and
reading stops once the threshold lies strictly below the kth score of every window, or below
the window itself while it holds fewer. Rows of one label and equal vectors can only be told
apart by vec_id, so a block keeps as many of them as can be wanted. A hot label or vector
spreads over as many blocks as its rows need. Nothing is capped.

Defined cases: rows with a null label, id or vector, with an empty vector, one of another
length than most, or with a null or non-finite component take no part; rows that repeat a
vec_id are rows each (another row with the anchor's vec_id may be its positive or negative);
anchors without positives, or with empty windows, give no rows; products are exact whatever
their size, but a score that a long cannot hold is an error; further columns are never read;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

POSITIVES, NEGATIVES = 5, 3
BLOCK, GROUP = 4096, 512  # rows of a block, anchors of a group
DEPTH = 32  # entries of each list that are read first; doubled each time
EXACT = 1 << 53


class Lists:
    """Rows of a block with their per-dimension sorted lists."""

    def __init__(self, x: np.ndarray, kind: np.ndarray, most: int, *order_by: np.ndarray):
        """Of rows that are equal and of one kind ``most`` are kept, in the order of the keys
        ``order_by``, the first foremost; ``at`` says which."""
        self.at = _first_of_equal(np.column_stack([x, kind]), order_by, most)
        self.whole, self.x = x[self.at], x[self.at].astype(float)
        self.largest = abs(x).max(initial=0)
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.x, self.order, axis=0)

    def search(self, anchor: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
        """(positions of rows, their scores): all rows read until ``done(rows, scores,
        threshold)`` says that no unread row is wanted."""
        n, up, down = len(self.at), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        big = int(self.largest) * int(abs(anchor).sum()) >= EXACT
        rows, a = (self.whole.astype(object), anchor.astype(object)) if big else (self.x, anchor.astype(float))
        values = self.values.astype(np.int64).astype(object) if big else self.values
        seen, found, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, object if big else np.int64)
        begin, end = 0, n if not len(up) + len(down) else min(n, DEPTH)
        while begin < n:
            met = np.zeros(n, bool)
            met[self.order[n - end : n - begin, up].ravel()] = True
            met[self.order[begin:end, down].ravel()] = True
            if end == n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            score = rows[new] @ a
            found, scores = np.concatenate([found, new]), np.concatenate([scores, score if big else score.astype(np.int64)])
            if end == n:
                break
            if done(found, scores, int(values[n - end, up] @ a[up] + values[end - 1, down] @ a[down])):
                break
            begin, end = end, min(n, 3 * end)
        return found, scores


def _first_of_equal(x: np.ndarray, keys, most: int) -> np.ndarray:
    """Positions of the rows that are among the first ``most`` of those equal to them."""
    order = np.lexsort(keys[::-1])
    data = np.ascontiguousarray(x[order]).view(f"V{x.shape[1] * 8}").ravel()
    same = np.unique(data, return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(same[by]) != 0])
    nth = np.empty(len(by), np.int64)
    nth[by] = np.arange(len(by)) - np.repeat(begin, np.diff(np.r_[begin, len(by)]))
    return order[nth < most]


def _kth(scores: np.ndarray, k: int):
    """The kth largest; None with fewer."""
    if len(scores) < k:
        return None
    return sorted(scores.tolist())[-k] if scores.dtype == object else int(np.partition(scores, len(scores) - k)[len(scores) - k])


def best_of_label(block: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The k best other rows of a block, all of one label, for each anchor: rid, score, vec_id, row."""
    x, vid, row = _matrix(block), block["vec_id"].to_numpy(), block["rid"].to_numpy()
    out = []
    lists = Lists(x, block["label"].to_numpy(), k + 1, vid, row) if len(x) and len(anchors) else None
    for own, a in zip(anchors["rid"].to_pylist(), _matrix(anchors), strict=True) if lists else ():
        def done(found, scores, threshold, own=own):
            kth = _kth(scores[row[lists.at[found]] != own], k)
            return kth is not None and threshold < kth

        found, scores = lists.search(a, done)
        found = lists.at[found]
        other = row[found] != own
        found, scores = found[other], scores[other]
        for j in np.lexsort((row[found], vid[found], -scores))[:k]:
            out.append((own, int(scores[j]), int(vid[found[j]]), int(row[found[j]])))
    return _table(out, ("rid", "score", "vec_id", "row"))


def best_in_windows(block: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The k best rows of other labels in each window of each anchor: rid, positive_score,
    score, vec_id, row."""
    x, vid, row, label = _matrix(block), block["vec_id"].to_numpy(), block["rid"].to_numpy(), block["label"].to_numpy()
    out = []
    lists = Lists(x, label, k, vid, row) if len(x) and len(anchors) else None
    for own, mine, a, windows in zip(anchors["rid"].to_pylist(), anchors["label"].to_pylist(), _matrix(anchors), anchors["windows"].to_pylist(), strict=True) if lists else ():
        bounds = [(s, -(-s // 2), 95 * s // 100) for s in windows]
        other = label[lists.at] != mine

        def inside(found, scores, low, high, other=other):
            return other[found] & (scores >= low) & (scores <= high)

        def done(found, scores, threshold, bounds=bounds, inside=inside):
            if threshold >= min(low for _, low, _ in bounds):
                kths = [(_kth(scores[inside(found, scores, low, high)], k), low) for _, low, high in bounds]
                return all(threshold < (low if kth is None else kth) for kth, low in kths)
            return True

        found, scores = lists.search(a, done)
        for s, low, high in bounds:
            some = inside(found, scores, low, high)
            at, got = lists.at[found[some]], scores[some]
            for j in np.lexsort((row[at], vid[at], -got))[:k]:
                out.append((own, s, int(got[j]), int(vid[at[j]]), int(row[at[j]])))
    return _table(out, ("rid", "positive_score", "score", "vec_id", "row"))


def _matrix(table: pa.Table) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 1), np.int64)


def _table(rows: list[tuple], names) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names))


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, x array<long>) of the rows that take part, labels as given."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("c"))
    fits = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 52)))
    rows = rows.where("vec_id is not null and label is not null and c is not null").where((F.size("c") > 0) & fits)
    common = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("c") == (common["d"] if common else -1)).select("vec_id", "label", F.transform("c", lambda c: F.floor(c * scale)).alias("x"))


def _tiles(rows: DataFrame, anchors: DataFrame, by: str | None = None):
    """Both sides with the same tile columns: blocks of about ``BLOCK`` rows and groups of about
    ``GROUP`` anchors, every group with every block, or with those of the same ``by``."""
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    groups = F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")
    if by:
        both = rows.groupBy(by).agg(blocks).join(anchors.groupBy(by).agg(groups), by)
        rows, anchors = rows.join(both, by), anchors.join(both, by)
    else:
        both = [F.lit(rows.agg(blocks).first()[0]).alias("blocks"), F.lit(anchors.agg(groups).first()[0]).alias("groups")]
        rows, anchors = rows.select("*", *both), anchors.select("*", *both)
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("groups > 0").withColumn("block", dealt("blocks", 1)).withColumn("group", every("groups")).drop("blocks", "groups")
    right = anchors.where("blocks > 0").withColumn("group", dealt("groups", 2)).withColumn("block", every("blocks")).drop("blocks", "groups")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # new columns, as both sides come from one table
    keys = [*([by] if by else []), "block", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``rows`` (vec_id, label, x); ``anchor``: which of them are anchors (a condition).
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    anchors = rows.where(anchor)
    near = _tiles(rows, anchors, "label").applyInArrow(lambda a, b: best_of_label(a, b, positives), "rid long, score long, vec_id long, row long")
    close = cut(_top(near, ["rid"], positives).select("rid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = close.where("positive_score >= 0").groupBy("rid").agg(F.collect_set("positive_score").alias("windows"))  # below 0 they are empty
    far = _tiles(rows, anchors.join(windows, "rid")).applyInArrow(lambda a, b: best_in_windows(a, b, negatives), "rid long, positive_score long, score long, vec_id long, row long")
    hard = _top(far, ["rid", "positive_score"], negatives).select("rid", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return close.join(hard, ["rid", "positive_score"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)
