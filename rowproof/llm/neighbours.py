"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on at most ``SAMPLE`` rows, chosen by the hash of vec_id; every row is
then put into a leaf. A query walks the tree through a priority queue, the child whose centre
has the largest inner product first, and visits leaves in that order. How many it visits is
calibrated: for ``PROBES`` queries the true neighbours are found by brute force in blocks,
and visits are widened until ``RECALL`` of them lie in the visited leaves.

Leaves lie in the order of the tree and rows are dealt along that order into bins of about
``BIN`` rows; a large leaf simply covers several bins. A query goes once to each bin that
holds part of a leaf it visits, with the list of these leaves, and queries are dealt into
blocks of about ``BLOCK`` a bin. One task multiplies one block by one bin, looks only at
visited leaves, and gives at most k rows a query; the best k of those are the result. Equal
scores are computed by the same sum for all rows, so ties go to the smaller vec_id wherever
the rows lie. How much of the table a query must visit depends on the vectors: where they
form no clusters, ``RECALL`` asks for most leaves.

Defined cases: vectors that are null, zero, of another length than most, or with a null or
non-finite component take no part; with fewer than k candidates all are returned; rows that
repeat a vec_id are candidates each, and for one query id are one query; null ids take no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blas import one_thread
from .store import cut

SAMPLE, PROBES, RECALL = 20_000, 200, 0.98
FAN, LEAF_ROWS, BLOCK, BIN = 8, 400, 1024, 4096


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres; starts from k distinct rows, empty clusters are dropped."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x0 = np.unique(x, axis=0)
    centres = x0[rng.choice(len(x0), min(k, len(x0)), replace=False)]
    for _ in range(rounds):
        near = _closest(x, centres)
        centres = np.stack([x[near == j].mean(0) for j in np.unique(near)])
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class KMeansTree:
    """children[node] = (ids, centres) of inner nodes; the other nodes are leaves."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.children: dict[int, tuple[list[int], np.ndarray]] = {}
        self.nodes, size = 1, max(1, len(x) // max(1, leaves))
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= max(size, FAN) or leaves <= 1:
                continue
            centres = _kmeans(rows, FAN, node)
            if len(centres) < 2:
                continue
            ids = list(range(self.nodes, self.nodes + len(centres)))
            self.nodes += len(centres)
            self.children[node] = ids, centres
            near = _closest(rows, centres)
            todo += [(ids[j], rows[near == j]) for j in range(len(ids))]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node not in self.children or not len(at):
                out[at] = node
                continue
            ids, centres = self.children[node]
            near = _closest(x[at], centres)
            todo += [(ids[j], at[near == j]) for j in range(len(ids))]
        return out

    def leaves(self) -> list[int]:
        """All leaves from left to right."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if node in self.children:
                todo += reversed(self.children[node][0])
            else:
                out.append(node)
        return out

    def visits(self, q: np.ndarray):
        """Leaves in the order in which a best-bin-first walk reaches them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node not in self.children:
                yield node
                continue
            ids, centres = self.children[node]
            for i, s in zip(ids, (centres @ q).tolist(), strict=True):
                heapq.heappush(queue, (-s, i))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good.where(finite & F.exists("v", lambda x: x != 0.0))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (common["d"] if common else -1))


def _first_of_equal(vid: np.ndarray, v: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Positions, by vec_id, without rows that have k + 1 equal vectors of smaller ids in their
    group: at most one of these is the query itself, so k of them always come first."""
    order = np.argsort(vid, kind="stable")
    data = np.column_stack([v[order], group[order]])
    same = np.unique(np.ascontiguousarray(data).view(f"V{data.shape[1] * 8}").ravel(), return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(same[by]) != 0])
    nth = np.empty(len(by), np.int64)
    nth[by] = np.arange(len(by)) - np.repeat(begin, np.diff(np.r_[begin, len(by)]))
    return order[nth <= k]


def _best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, seen: np.ndarray | None = None, group: np.ndarray | None = None) -> pd.DataFrame:
    """The k best rows of a bin for each query; ``seen`` (query, group) says which groups of
    rows it looks at. The fast product only preselects."""
    out = []
    one_thread()
    if len(vid):
        group = np.zeros(len(vid), np.int64) if group is None else group
        keep = _first_of_equal(vid, v, group, k)
        vid, v, group = vid[keep], v[keep], group[keep]
    for i in range(0, len(qid) if len(vid) else 0, 128):
        own, rows = qid[i : i + 128], q[i : i + 128]
        rough = rows @ v.T
        if seen is not None:
            rough[~seen[i : i + 128][:, group]] = -np.inf
        rough[own[:, None] == vid[None, :]] = -np.inf
        least = np.partition(rough, len(vid) - k, axis=1)[:, len(vid) - k] if len(vid) > k else np.full(len(own), -np.inf)
        some = np.where(np.isfinite(least), least, 0.0)
        a, b = np.nonzero((rough > -np.inf) & (rough >= np.where(np.isfinite(least), least - 1e-9 * (1 + abs(some)), -np.inf)[:, None]))
        exact = np.concatenate([np.einsum("nd,nd->n", rows[a[j : j + BIN]], v[b[j : j + BIN]]) for j in range(0, len(a), BIN)]) if len(a) else np.zeros(0)
        order = np.lexsort((vid[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        begin = np.searchsorted(a, a)
        top = np.arange(len(a)) - begin < k
        out.append(pd.DataFrame({"query_id": own[a[top]], "vec_id": vid[b[top]], "score": exact[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


RESULT = "query_id long, vec_id long, score double"


def _matrix(values) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 1))


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries, by blocks of rows."""
    held = rows.sparkSession.sparkContext.broadcast((np.array([q[0] for q in queries]), np.array([q[1] for q in queries], float)))

    def run(frames):
        for frame in frames:
            for i in range(0, len(frame), BLOCK):
                part = frame.iloc[i : i + BLOCK]
                yield _best(*held.value, part["vec_id"].to_numpy(), _matrix(part["v"]), k)

    return _top(rows.select("vec_id", "v").mapInPandas(run, RESULT), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def calibrate(tree: KMeansTree, rows: DataFrame, probes: list, k: int, recall: float) -> int:
    """Leaf visits after which ``recall`` of the probes' true neighbours have been seen."""
    true = brute_force(rows, probes, k).select("query_id", "vec_id")  # at most k a probe
    where = rows.select("vec_id", "leaf").join(F.broadcast(true), "vec_id").select("query_id", "vec_id", "leaf").distinct().collect()
    nth = {q: {leaf: n for n, leaf in enumerate(tree.visits(np.array(v, float)), 1)} for q, v in probes}
    needed = sorted(nth[r["query_id"]][r["leaf"]] for r in where)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: k neighbours of each row with vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    good = usable(vectors)
    n = good.count()
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = KMeansTree(_matrix(sample["v"]), -(-n // LEAF_ROWS))
    held = spark.sparkContext.broadcast(tree)

    def place(frames):
        for frame in frames:
            for i in range(0, len(frame), BLOCK):
                one_thread()
                part = frame.iloc[i : i + BLOCK]
                yield part.assign(leaf=held.value.leaf_of(_matrix(part["v"])))

    # u is written with the rows, so it is the same whenever they are read
    rows = cut(good.mapInPandas(place, "vec_id long, v array<double>, leaf int").withColumn("u", F.rand(9)))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]).select("vec_id", "v")
    probes = [(r["vec_id"], r["v"]) for r in queries.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(PROBES).collect()]
    most = calibrate(tree, rows, probes, k, recall) if probes else 1

    # one entry a leaf, at most one per row of the sample: where it begins and ends, in bins
    counts = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}
    ends, width = np.cumsum([counts.get(x, 0) for x in tree.leaves()]), n / -(-n // BIN)
    spans = {x: ((int(e) - counts[x]) / width, int(e) / width) for x, e in zip(tree.leaves(), ends, strict=True) if x in counts}
    within = spark.createDataFrame([(x, *span) for x, span in spans.items()], "leaf int, low double, high double")
    bin_of = lambda at, high: F.least(F.floor(at), F.ceil(high) - 1).cast("int")
    dealt = rows.join(F.broadcast(within), "leaf").select(bin_of(F.col("low") + F.col("u") * (F.col("high") - F.col("low")), F.col("high")).alias("bin"), "leaf", "vec_id", "v")
    spread = spark.sparkContext.broadcast({x: range(int(a), int(np.ceil(b))) for x, (a, b) in spans.items()})

    def walk(frames):
        for frame in frames:
            for i in range(0, len(frame), 32):  # a query is repeated once a bin, so few at a time
                out = []
                for q, v in zip(frame["vec_id"].iloc[i : i + 32], frame["v"].iloc[i : i + 32], strict=True):
                    by: dict[int, list[int]] = {}
                    for leaf, _ in zip(held.value.visits(np.asarray(v, float)), range(most), strict=False):
                        for x in spread.value.get(leaf, ()):
                            by.setdefault(x, []).append(leaf)
                    out += [(x, leaves, int(q), v) for x, leaves in by.items()]
                yield pd.DataFrame(out, columns=["bin", "leaves", "vec_id", "v"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = cut(queries.repartition(tasks).mapInPandas(walk, "bin int, leaves array<int>, vec_id long, v array<double>"))
    parts = asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qb"))
    left = dealt.join(parts, "bin").select("bin", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "leaf", "vec_id", "v")
    right = asked.join(parts, "bin").select("bin", F.pmod(F.xxhash64("vec_id"), F.col("qb")).cast("int").alias("q"), "leaves", "vec_id", "v")

    def compare(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return _best(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
        names, group = np.unique(r["leaf"].to_numpy(), return_inverse=True)
        seen = np.stack([np.isin(names, x) for x in q["leaves"]])
        return _best(q["vec_id"].to_numpy(), _matrix(q["v"]), r["vec_id"].to_numpy(), _matrix(r["v"]), k, seen, group)

    near = left.groupBy("bin", "q").cogroup(right.groupBy("bin", "q")).applyInPandas(compare, RESULT)
    return _top(near, k)


def op9_neighbours(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
