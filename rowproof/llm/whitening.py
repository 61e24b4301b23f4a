"""Whitening of embeddings by shifted CholeskyQR.

Vectors become integers (fixed point), so that counts, sums and distances from the mean are
exact. The centred rows A are orthogonalised by repeated passes: a pass solves every row of A
against the triangular factor found so far, sums the Gram matrix of the result over all
tasks, and takes its Cholesky factor, which is composed with the one before (A = QR with R the
product). The first pass shifts the Gram matrix, so that its factor exists however badly A is
conditioned; passes go on until Q is orthonormal to rounding. The singular values s and right
vectors V of the small R are those of A: component j is V[:, j], its variance s[j]^2 / n, and
whitened values are the centred row times V[:, j] over the square root of the variance.

A pass reads the table once, gives one matrix a task and shuffles only sums; a task holds a
batch of rows and a few square matrices of the vectors' length, and so does the driver.

Defined cases: vectors that are null, empty, of another length than most, or hold a null or
non-finite entry, or one whose fixed point is 2^52 or more, take no part; directions without
variance have no component, so equal vectors give no rows, and vectors of length d at most
min(d, k) components; a deviation that a long cannot hold is null; rows that repeat, also with
null ids, are vectors each; further columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 4096  # rows that are multiplied at once
PASSES, ORTHONORMAL = 6, 1e-12
FLAT = 1e-12  # a singular value of this share of the largest has no variance


@dataclass
class Whitening:
    """n rows with per-dimension sums; components (d x k) with their variances, the trace of the
    covariance, and the largest entry by which whitened rows depart from unit covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int
    error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off as integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; None beyond a long."""
        bound = self.n * int(abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if bound * bound * max(1, x.shape[1]) < 1 << 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        far = self.n * x.astype(object) - np.array(self.sums, object)
        return [t if t < 1 << 63 else None for t in (far * far).sum(1).tolist()]


def fixed_point(vectors: DataFrame, scale: int, shift: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part: x = floor(scale * c) + shift."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda c: c.cast("double")).alias("c"))
    fits = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 52)))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0)).where(fits)
    common = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("c") == (common["d"] if common else -1))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * scale) + shift).alias("x"))


def matrices(batches, column: int = 1):
    """(slice of the batch, its vectors as a matrix of integers), some rows at a time."""
    for batch in batches:
        for i in range(0, len(batch), BATCH):
            part = batch.slice(i, BATCH)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of the upper triangular r, column by column."""
    q = np.empty((a.shape[1], len(a)))
    for j in range(len(q)):
        q[j] = (a[:, j] - r[:j, j] @ q[:j]) / r[j, j]
    return q.T


def _summed(rows: DataFrame, made, kind: str) -> np.ndarray:
    """Sums over all tasks of the matrix that ``made`` gives for each block of rows."""

    def run(batches):
        total = None
        for _, x in matrices(batches):
            now = made(x)
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist())], names=["i", "v"])

    cells = rows.mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    found = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")).alias("v")).collect()
    if not found:
        return np.zeros((0, 0))
    out = np.zeros((max(r["i"] for r in found) + 1, max(r["j"] for r in found) + 1), object if kind == "long" else float)
    for r in found:
        out[r["i"], r["j"]] = int(r["v"]) if isinstance(r["v"], Decimal) else r["v"]
    return out


def _counted(x: np.ndarray) -> np.ndarray:
    """Rows, and the sums in two parts that no number of rows overflows."""
    return np.stack([np.full(x.shape[1], len(x)), (x >> 26).sum(0), (x & (1 << 26) - 1).sum(0)])


def cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of gram + shift * I; a shift that is too small grows."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-16 * np.trace(gram), 1e-300)


def fit(rows: DataFrame, k: int = 8) -> Whitening | None:
    """The first ``k`` components of ``rows`` (x); None without rows or variance."""
    counted = _summed(rows, _counted, "long")
    if not counted.size:
        return None
    n, d = counted[0, 0], counted.shape[1]
    found = Whitening(n, [(int(a) << 26) + int(b) for a, b in counted[1:].T], np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    r, gram, centred = None, None, found.centred
    for found.passes in range(1, PASSES + 1):
        before = r
        gram = _summed(rows, lambda x, r=before: _gram(centred(x) if r is None else solve(centred(x), r)), "double")
        if not np.trace(gram) > 0:
            return None
        if before is not None and abs(gram - np.eye(d)).max() < ORTHONORMAL:
            break
        if found.passes < PASSES:
            shift = 11 * d * (d + 1) * np.finfo(float).eps * np.trace(gram) if before is None else 0.0
            r = cholesky(gram, shift) if before is None else cholesky(gram, shift) @ before
    # what is left of the Gram matrix: nothing to speak of, but where directions have no variance
    value, vector = np.linalg.eigh(gram)
    _, s, right = np.linalg.svd((vector * np.sqrt(np.maximum(value, 0))) @ vector.T @ r)
    found.trace = float((s * s).sum() / n)
    right = right[: min(k, int((s > FLAT * s[0]).sum()))]
    right = right * np.where(np.take_along_axis(right, abs(right).argmax(1)[:, None], 1) < 0, -1, 1)  # the largest entry is positive
    found.components, found.variances = right.T, s[: len(right)] ** 2 / n
    scaled = found.scaled()
    white = _summed(rows, lambda x: _moments(centred(x) @ scaled), "double") / n
    found.error = float(abs(white[1:] - np.outer(white[0], white[0]) - np.eye(len(right))).max())
    return found


def _gram(q: np.ndarray) -> np.ndarray:
    return q.T @ q


def _moments(w: np.ndarray) -> np.ndarray:
    return np.vstack([w.sum(0), w.T @ w])


def whiten(rows: DataFrame, found: Whitening | None) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every row."""
    schema = "vec_id long, deviation long, whitened array<double>"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    held = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        know = held.value
        scaled = know.scaled()
        for part, x in matrices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(know.deviations(x), pa.int64()), pa.array((know.centred(x) @ scaled).tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def op13_whitening(spark, sf_dir):
    rows = fixed_point(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 1024, 100_000)
    found = fit(rows)
    share = [float(e / found.trace) for e in found.variances] if found else []
    return whiten(rows, found).select("vec_id", "deviation", F.posexplode("whitened").alias("j", "whitened")).select(
        "vec_id", (F.col("j") + 1).cast("int").alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(x) for x in share]).cast("array<double>"), F.col("j")).alias("explained"), F.lit(found.error if found else 0.0).alias("identity_error"),
    )
