"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROW_GROUP = 16 << 20  # bytes


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one in local mode
    (tests); on a cluster that is an error, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rowproof-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps
    neither recompute it nor depend on executors that held its shuffle files. Row groups are
    small, as a writing task holds one in memory beside whatever its Python worker needs; zstd
    takes about a third less disk than the default for texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowproof-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a column ``rid`` that names each row. The numbers are written with the rows,
    so they are the same whenever these are read, whatever repeats or is null."""
    return cut(df.withColumn("rid", F.monotonically_increasing_id()))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Hint a broadcast only when ``df`` has at most ``most`` rows (counted here)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
