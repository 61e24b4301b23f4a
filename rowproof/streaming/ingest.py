"""Files that keep arriving, each read once.

A file source lists the folder and its checkpoint remembers what was read, so a query that is
stopped and started again goes on where it was. Every micro-batch is written under its own
number, cells and failures apart, and replaces what an attempt of the same batch left: a
replay after a failure neither loses nor repeats a file. A file that cannot be read gives a
row among the failures and holds nothing up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowproof.sources.sheets import DELIMITED, of_suffix, parse_delimited

FILES = "path string, modificationTime timestamp, length long, content binary"
ROWS = "source string, sheet string, sheet_order int, row_no int, col_no int, value string, error string"


def ingest(
    spark: SparkSession, folder: str, out: str, checkpoint: str, read: Callable[[DataFrame], DataFrame] = parse_delimited, suffixes: tuple[str, ...] = DELIMITED, files_a_batch: int | None = None, continuous: bool = False
) -> StreamingQuery:
    """Start reading the files of ``folder`` into ``out``: those that are there and were not read
    yet, then stop, or with ``continuous`` all that come. ``read`` turns files (path, content)
    into rows of ``ROWS``; rows with an error are failures. ``out`` and ``checkpoint`` lie in a
    folder that all executors share."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if files_a_batch:
        files = files.option("maxFilesPerTrigger", files_a_batch)

    def keep(batch: DataFrame, number: int) -> None:
        rows = read(batch).withColumn("kind", F.when(F.col("error").isNull(), "cells").otherwise("failures"))
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={number}")

    found = of_suffix(files.load(folder), suffixes).select("path", "content")
    writer = found.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def ingested(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(cells, failures) of all batches so far, each with the number of its batch."""
    rows = spark.read.schema(f"{ROWS}, batch long, kind string").parquet(out)
    cells = rows.where("kind = 'cells'").drop("kind", "error")
    return cells, rows.where("kind = 'failures'").select("source", "error", "batch")
