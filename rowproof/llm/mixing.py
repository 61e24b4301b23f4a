"""Mixing sources to target weights.

Words are summed per source, the weights are turned into target sizes, and a source's
repetition rate is its target over its size. A document is taken floor(rate) times, plus
once more when a uniform number hashed from (seed, doc_id) falls below the fraction.

Targets: sources in code-point order, null last, have the weights 5, 2, 1, repeating, and
share the total of all sizes; none exceeds ``cap`` times its source's size, and what is cut
off is shared again by weight. That end state is the water level L with target =
min(weight * L, cap * size) and sum of targets = total, found in closed form: in order of
cap * size / weight, the first k sources are full, and L is what is left over the weights
that remain.

Defined cases: a null text has size 0; null sources form one source; a source of size 0 has
target 0 and gives nothing; documents without doc_id draw as id null (one common draw);
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import broadcast_if_small, cut, documents, free_name

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 20_011
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _draw(seed: int, id_col: str):
    """Uniform in [0, 1): the first 52 bits of the MD5 of "seed:id"."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size), one row per source -> with target and rate.
    The windows run over sources, never over documents."""
    ordered = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    nth = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1)
    every = Window.partitionBy()
    full = Window.orderBy("ratio", F.col("source").isNull(), "source")
    upto = full.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", weight).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    rows = rows.withColumns({
        "total": F.sum("source_size").over(every).cast("double"),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        "filled": cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0)),
    })
    rows = rows.withColumn("level", (F.col("total") - F.col("filled")) / F.col("left"))
    # the level is that of the first source, in order of ratio, which it does not fill
    rows = rows.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    most = cap * F.col("source_size")
    target = F.least(most, F.col("weight") * F.coalesce("found", F.lit(float("inf"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), target / F.col("source_size"))).otherwise(0.0)
    return rows.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    targets = broadcast_if_small(targets.withColumnRenamed("source", "of_source"))
    copies = F.floor("rate") + F.when(_draw(seed, "doc_id") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left").select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(copies, F.lit(0)).cast("long").alias("copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged,
    whatever their names."""
    of_source, rate, copy = (free_name(docs, x) for x in ("of_source", "rate", "copy"))
    sizes = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    targets = cut(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    rates = broadcast_if_small(targets.select(F.col("source").alias(of_source), F.col("rate").alias(rate)))
    copies = F.floor(rate) + F.when(_draw(seed, id_col) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    taken = docs.join(rates, F.col("source").cast("string").eqNullSafe(F.col(of_source)), "left")
    taken = taken.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(0)).cast("int"))))
    return taken.select(*[f"`{c}`" for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * min_by(level, ratio) FILTER (level <= ratio) OVER ()) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, c.source_size, c.target,
  (d.size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


def op10_mixing(spark, sf_dir):
    plan = mixing_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
