"""Past runs of a reconciliation: four Parquet tables under one folder, by run_id.

The table ``runs`` is the manifest: its entry for a run is written aside when all else of the
run stands, and put in place by one rename. Readers know only the runs that it lists, so a run
whose saving was cut short, or whose entry a deletion has taken away, does not exist; saving or
deleting it again clears what is left. The folder must be shared by all executors.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions.normalize import norm_key, strip
from rowproof.operators.compare import FIELDS, VERDICTS

from .scratch import written

TABLES = ("run_records", "field_results", "unmatched_excel")
RUNS = "created_at string, excel_file string, sheet string, header_row int, mapping string, settings string, pdf_count long, n_verified long, n_review long, n_mismatch long, n_notfound long, run_id long"
HITS = "run_id long, created_at string, excel_file string, rec_seq long, pdf_file string, excel_row string, overall string, note string"
_RESULT = "struct<status string, score double, note string, doc string, sheet string>"


def _files(spark: SparkSession, path: str):
    """(file system, path) of the store that ``path`` lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _drop(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _enter(spark: SparkSession, aside: str, folder: str, run_id: int) -> None:
    """Put the entry that was written aside into the manifest."""
    files, at = _files(spark, aside)
    if not files.rename(at, _files(spark, f"{folder}/runs/run_id={run_id}")[1]):
        raise OSError(f"run {run_id} could not be entered")


def _put(rows: DataFrame, folder: str, table: str, run_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{table}/run_id={run_id}")


def placed(results: DataFrame, records: DataFrame) -> DataFrame:
    """``results`` beside the place of each record's document: what ``save_run`` keeps. Written once, it
    serves all runs that save it, and none of them has to join."""
    path = F.col("path") if "path" in records.columns else F.col("file")
    place = records.select("rec_seq", F.col("file").alias("pdf_file"), path.alias("pdf_path"), "page", F.coalesce("reg", F.lit("")).alias("pdf_reg"))
    return results.join(place, "rec_seq")


def save_run(folder: str, run_id: int, info: dict, results: DataFrame, records: DataFrame, unmatched: DataFrame) -> None:
    """``info``: created_at, excel_file, sheet, header_row, mapping, settings. ``results`` is what
    reconcile gives, or ``placed`` of it; unpaired records keep the document's own values as Not
    compared. A run of that number is replaced; it is not listed until all of the new one stands."""
    spark = results.sparkSession
    _drop(spark, f"{folder}/runs/run_id={run_id}")
    rows = results if "pdf_file" in results.columns else written(placed(results, records))
    rows = rows.select("rec_seq", "excel_row", F.col("verdict").alias("overall"), "note", "paired_by", "sheet_reg", *FIELDS, "pdf_file", "pdf_path", "page", "pdf_reg")
    _put(rows.drop("paired_by", "sheet_reg", *FIELDS), folder, "run_records", run_id)
    by_reg, by_abc = F.col("paired_by").eqNullSafe("reg"), F.col("paired_by").eqNullSafe("abc")
    note = F.when(by_reg, "Paired on this").when(by_abc, "Not on the marksheet; paired by ABC ID").otherwise("")
    own = F.struct(F.when(by_reg, "Match").otherwise("Not compared").alias("status"), F.when(by_reg, 100.0).alias("score"), note.alias("note"), F.when(by_abc, "").otherwise(F.col("pdf_reg")).alias("doc"), F.coalesce("sheet_reg", F.lit("")).alias("sheet"))
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c.cast(_RESULT).alias("r")) for f, c in (("reg", own), *((f, F.col(f)) for f in FIELDS))]))
    _put(rows.select("rec_seq", each).select("rec_seq", "field", F.coalesce("r.doc", F.lit("")).alias("pdf_value"), F.coalesce("r.sheet", F.lit("")).alias("excel_value"), "r.status", "r.score", "r.note"), folder, "field_results", run_id)
    _put(unmatched.select("excel_row", "reg", "name"), folder, "unmatched_excel", run_id)
    of = lambda *v: F.count_if(F.col("overall").isin(*v)).alias
    facts = [F.lit(str(info.get(k, ""))).alias(k) for k in ("created_at", "excel_file", "sheet")]
    facts += [F.lit(int(info.get("header_row", 0))).alias("header_row"), *[F.lit(json.dumps(info.get(k, {}))).alias(k) for k in ("mapping", "settings")]]
    kept = spark.read.parquet(f"{folder}/run_records/run_id={run_id}")
    counts = kept.agg(F.count(F.lit(1)).alias("pdf_count"), of(*VERDICTS[:2])("n_verified"), of(VERDICTS[2])("n_review"), of(VERDICTS[3])("n_mismatch"), of(*VERDICTS[4:])("n_notfound"))
    aside = f"{folder}/runs/_{uuid.uuid4().hex}"  # Spark's readers pass over such names
    counts.select(*facts, "*").coalesce(1).write.parquet(aside)
    _enter(spark, aside, folder, run_id)


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that the manifest lists."""
    files, at = _files(spark, f"{folder}/runs")
    there = files.exists(at) and any(x.getPath().getName().startswith("run_id=") for x in files.listStatus(at))
    return spark.read.schema(RUNS).parquet(f"{folder}/runs") if there else spark.createDataFrame([], RUNS)


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Newest first."""
    return _runs(spark, folder).orderBy(F.desc("run_id"))


def load_run(spark: SparkSession, folder: str, run_id: int) -> tuple[dict, DataFrame, DataFrame]:
    """(facts, results, unmatched) of one run; results have a struct per field, null where the
    record was not paired, and doc_fields, the document's non-empty values."""
    facts = _runs(spark, folder).where(F.col("run_id") == run_id).first()
    if facts is None:
        raise ValueError(f"no run with id {run_id}")
    info = facts.asDict() | {k: json.loads(facts[k] or "{}") for k in ("mapping", "settings")}
    records, fields, unmatched = (spark.read.parquet(f"{folder}/{t}/run_id={int(run_id)}") for t in TABLES)
    one = F.struct("status", "score", "note", F.col("pdf_value").alias("doc"), F.col("excel_value").alias("sheet"))
    given = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("pdf_value") != "", F.struct("field", "pdf_value")))))
    wide = fields.groupBy("rec_seq").agg(given.alias("doc_fields"), *[F.max(F.when(F.col("field") == f, one)).alias(f) for f in FIELDS])
    found = records.join(wide, "rec_seq", "left").withColumns({f: F.when(~F.col("overall").isin(*VERDICTS[4:]), F.col(f)) for f in FIELDS})
    return info, found.withColumnRenamed("overall", "verdict"), unmatched


def delete_run(spark: SparkSession, folder: str, run_id: int) -> None:
    """The run's entry in the manifest goes first, then its partitions."""
    for table in ("runs", *TABLES):
        _drop(spark, f"{folder}/{table}/run_id={int(run_id)}")


def history_for_key(spark: SparkSession, folder: str, reg: str) -> DataFrame:
    """Every result of one stored registration number, newest run first."""
    runs = _runs(spark, folder).select("run_id", "created_at", "excel_file")
    if runs.isEmpty():
        return spark.createDataFrame([], HITS)
    hits = spark.read.parquet(f"{folder}/run_records").where(F.col("pdf_reg") == reg).withColumn("run_id", F.col("run_id").cast("long"))
    return hits.join(runs, "run_id").orderBy(F.desc("run_id"), "rec_seq").select("run_id", "created_at", "excel_file", "rec_seq", "pdf_file", "excel_row", "overall", "note")


def lookup(spark: SparkSession, folder: str, raw: str) -> DataFrame:
    """History by a typed number: as it stands without outer blanks, else as a key."""
    asked = spark.range(1).select(strip(F.lit(raw)).alias("raw"), norm_key(F.lit(raw)).alias("key")).first()
    found = history_for_key(spark, folder, asked.raw)
    if not asked.raw:
        return found.where("false")
    return history_for_key(spark, folder, asked.key) if found.isEmpty() else found
