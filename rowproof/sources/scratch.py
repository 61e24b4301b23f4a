"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, the warehouse in local mode (tests). On
    a cluster that is an error, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder: what follows is planned and run over its columns
    instead of the expressions behind them, and once for all uses."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/rowproof-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def with_number(rows: DataFrame, *order: str, name: str = "nth") -> DataFrame:
    """``rows`` with a number, counted from 1 in the given order. Rows are sorted by ranges, numbered in
    each and moved on by the sizes of the ranges before it: the driver sees one size a range."""
    rows = written(rows)  # the ranges are found by a pass of its own, which would work out all rows twice
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    before, begins = 0, {}
    for p, n in sizes:
        begins[p], before = before, before + n
    starts = rows.sparkSession.createDataFrame(list(begins.items()), "_p long, _start long")
    counted = ranged.withColumn("_p", part).join(F.broadcast(starts), "_p")  # a row a task
    return counted.withColumn(name, F.col("_start") + F.col(name).bitwiseAND((1 << 33) - 1) + 1).select(name, *rows.columns)
