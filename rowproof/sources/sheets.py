"""Delimited files and grids of cells: (source, sheet, sheet_order, row_no, col_no, value)."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowproof.functions.normalize import squash, strip, text
from rowproof.operators.columns import HEADERS, header_score

from .scratch import written

FIELD_BYTES = 1 << 30  # a quoted field may be as long as its file


def read_text_grid(data: bytes) -> list[list[str]]:
    """Rows of one file: UTF-8 (a mark is dropped) or Latin-1; the first line tells the
    delimiter; blank rows go; a row wider than the first is an error, shorter ones are padded."""
    try:
        words = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        words = data.decode("latin-1")
    lines = io.StringIO(words, newline="")
    first = lines.readline()
    if not first:
        raise ValueError("No columns to parse from file")
    csv.field_size_limit(FIELD_BYTES)
    rows = csv.reader(io.StringIO(words, newline=""), delimiter=csv.Sniffer().sniff(first).delimiter, strict=True)
    kept = []
    for row in rows:
        if len(row) > 1 or (row and row[0].strip()):
            if kept and len(row) > len(kept[0]):
                raise ValueError(f"Expected {len(kept[0])} fields in line {rows.line_num}, saw {len(row)}")
            kept.append([v.strip() for v in row] + [""] * (len(kept[0]) - len(row) if kept else 0))
    if not kept:
        raise ValueError("No columns to parse from file")
    return kept


DELIMITED = (".csv", ".tsv", ".txt")


def of_suffix(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    return files.where(F.regexp_like(F.lower("path"), F.lit("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")))


def parse_delimited(files: DataFrame) -> DataFrame:
    """Cells of ``files`` (path, content), with a column ``error``: a file that cannot be read gives
    one row with its error and no cell; a file of no bytes gives none, as Spark's readers pass
    over it. Each file is read whole in one task, because quotes and row numbers run through it."""

    def run(batches):
        for files in batches:
            for source, data in zip(files["path"], files["content"], strict=True):
                try:
                    grid = read_text_grid(bytes(data))
                except (ValueError, csv.Error) as problem:
                    yield pd.DataFrame([(source, None, None, None, str(problem))], columns=["source", "row_no", "col_no", "value", "error"])
                    continue
                for at in range(0, len(grid), 10_000):
                    part = [(source, at + i + 1, j, v, None) for i, row in enumerate(grid[at : at + 10_000]) for j, v in enumerate(row)]
                    yield pd.DataFrame(part, columns=["source", "row_no", "col_no", "value", "error"])

    cells = files.select("path", "content").mapInPandas(run, "source string, row_no int, col_no int, value string, error string")
    return cells.select("source", F.lit("").alias("sheet"), F.lit(0).alias("sheet_order"), "row_no", "col_no", "value", "error")


def read_delimited(spark: SparkSession, path: str, suffixes: tuple[str, ...] = DELIMITED) -> DataFrame:
    """``parse_delimited`` of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_delimited(of_suffix(files, suffixes))


def ingest_unseen(files: DataFrame, seen: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """Rows of ``files`` (path) with the suffix whose path is not in ``seen``, in the order of path."""
    return files.where(F.lower("path").endswith(suffix)).join(seen.select("path").distinct(), "path", "left_anti").orderBy("path")


NOTHING_STACKED = "No sheet has a recognisable header row (registration no., name, ...)."


def _told_apart(heads):
    """An array of struct(col_no, base, title) in the order of columns, with a ``key`` each: the base,
    or the first "base (2)", "base (3)" ... that no column before has taken as its key."""

    def take(state, head):
        again = lambda i: F.concat(head["base"], F.lit(" ("), i.cast("string"), F.lit(")"))
        # of size + 1 names one is free
        free = F.get(F.filter(F.sequence(F.lit(2), F.size(state["taken"]) + 2), lambda i: ~F.array_contains(state["taken"], again(i))), F.lit(0))
        n = F.when(F.array_contains(state["taken"], head["base"]), free)
        key = F.coalesce(again(n), head["base"])
        title = F.concat(head["title"], F.coalesce(F.concat(F.lit(" ("), n.cast("string"), F.lit(")")), F.lit("")))
        named = F.struct(head["col_no"].alias("col_no"), key.alias("key"), title.alias("title"))
        return F.struct(F.concat(state["taken"], F.array(key)).alias("taken"), F.concat(state["named"], F.array(named)).alias("named"))

    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<col_no:int,key:string,title:string>>").alias("named"))
    return F.aggregate(heads, start, take, lambda state: state["named"])


def combine_sheets(cells: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sheets of each source stacked under one header: (cells, sheets).

    ``headers`` (source, sheet, header_row) are the sheets' header rows. A sheet takes part if its
    header names two kinds of field at least. Columns are put together by their titles without
    regard to case and blanks, in the order in which sheets bring them; a title that repeats in
    one sheet is told apart as "title (2)", or the next number that no column before it has taken;
    columns without title go. The cells are (source, sheet, row_no, col_no, title, value), with
    the sheet and row that they come from and a last column "Sheet"; the sheets are (source,
    sheet, sheet_order, combined, rows, header_row), which ``combined_note`` puts into words. A source of which no
    sheet takes part gives no cells."""
    order = cells.groupBy("source", "sheet").agg(F.min("sheet_order").alias("sheet_order"))
    titled = cells.drop("sheet_order").join(headers, ["source", "sheet"]).where("header_row >= 0")
    heads = titled.where("row_no = header_row").select("source", "sheet", F.col("col_no").cast("int").alias("col_no"), strip(F.col("value")).alias("title"))
    kinds = F.array(*[F.struct(header_score(f, F.col("title")).alias("s"), (-F.lit(i)).alias("first"), F.lit(f).alias("f")) for i, f in enumerate(HEADERS)])
    best = F.array_max(kinds)
    kind = F.when(best["s"] >= 0.6, best["f"])
    entry = F.when(F.col("title") != "", F.struct("col_no", F.lower(squash(F.col("title"))).alias("base"), "title"))
    # headers only: a few rows a sheet
    sheet_heads = heads.groupBy("source", "sheet").agg(F.count_distinct(kind).alias("kinds"), F.array_sort(F.collect_list(entry)).alias("heads")).where("kinds >= 2")
    taking = written(sheet_heads.join(order, ["source", "sheet"]).select("source", "sheet", "sheet_order", _told_apart(F.col("heads")).alias("named")))
    enough = taking.select("source", "sheet")
    named = taking.select("source", "sheet", "sheet_order", F.inline("named"))
    place = named.groupBy("source", "key").agg(F.min(F.struct("sheet_order", "col_no", "title")).alias("first"))
    place = place.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy("first.sheet_order", "first.col_no")) - 1)
    where = named.select("source", "sheet", "col_no", "key").join(place.select("source", "key", "at", F.col("first.title").alias("title")), ["source", "key"])
    width = place.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("at"))
    data = titled.where("row_no > header_row").where(text(F.col("value")) != "").join(enough, ["source", "sheet"], "left_semi")
    body = data.join(where, ["source", "sheet", "col_no"]).select("source", "sheet", "row_no", F.col("at").cast("int").alias("col_no"), "title", "value")
    rows = data.select("source", "sheet", "row_no").distinct()
    names = rows.join(width, "source").select("source", "sheet", "row_no", F.col("at").alias("col_no"), F.lit("Sheet").alias("title"), F.col("sheet").alias("value"))
    counted = rows.groupBy("source", "sheet").agg(F.count(F.lit(1)).alias("rows"))
    sheets = order.join(headers, ["source", "sheet"], "left").join(enough.withColumn("combined", F.lit(True)), ["source", "sheet"], "left").join(counted, ["source", "sheet"], "left")
    return body.unionByName(names), sheets.select("source", "sheet", "sheet_order", F.coalesce("combined", F.lit(False)).alias("combined"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("header_row", F.lit(-1)).alias("header_row"))


def combined_note(sheets: DataFrame) -> DataFrame:
    """(source, note, error) of the sheets that ``combine_sheets`` gives: how many were stacked with
    how many rows and which were skipped, or, for a source that gives no row, an error."""
    skipped = F.array_sort(F.collect_list(F.when(~F.col("combined"), F.struct("sheet_order", "sheet"))))
    found = sheets.groupBy("source").agg(F.count_if("combined").alias("n"), F.sum("rows").alias("rows"), F.transform(skipped, lambda x: x["sheet"]).alias("skipped"))
    left = F.when(F.size("skipped") > 0, F.concat(F.lit(" Skipped (no header row found): "), F.array_join("skipped", ", "))).otherwise("")
    note = F.concat(F.lit("Combined "), F.col("n").cast("string"), F.lit(" sheet(s), "), F.col("rows").cast("string"), F.lit(" rows."), left)
    return found.select("source", F.when(F.col("rows") > 0, note).alias("note"), F.when(F.col("rows") == 0, NOTHING_STACKED).alias("error"))


def trim_grid(cells: DataFrame) -> DataFrame:
    """Without the empty rows and columns at each sheet's end; empty sheets go."""
    full = strip(F.col("value")) != ""
    last = cells.groupBy("source", "sheet").agg(F.max(F.when(full, F.col("row_no"))).alias("last_row"), F.max(F.when(full, F.col("col_no"))).alias("last_col"))
    return cells.join(last, ["source", "sheet"]).where("row_no <= last_row and col_no <= last_col").select(*cells.columns)


def pick_sheet(cells: DataFrame, name: str | None = None) -> DataFrame:
    """Cells of the named sheet, else of each source's longest sheet, the first of equals."""
    if name is not None:
        return cells.where(F.col("sheet") == name)
    sizes = cells.groupBy("source", "sheet").agg(F.max("row_no").alias("rows"), F.min("sheet_order").alias("place"))
    best = sizes.groupBy("source").agg(F.max_by("sheet", F.struct("rows", -F.col("place"))).alias("sheet"))
    return cells.join(best, ["source", "sheet"], "left_semi").select(*cells.columns)


def data_rows(cells: DataFrame, header_row: int) -> DataFrame:
    """Cells of the rows below the header that hold anything."""
    below = cells.where(F.col("row_no") > header_row)
    rows = below.where(strip(F.col("value")) != "").select("source", "sheet", "row_no").distinct()
    return below.join(rows, ["source", "sheet", "row_no"], "left_semi").select(*cells.columns)


def wide_rows(cells: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """One row per sheet row with a column per mapped field, blanks for what is absent."""
    of = lambda c: F.coalesce(F.max(F.when(F.col("col_no") == c, text(F.col("value")))), F.lit(""))
    return cells.groupBy("source", "sheet", "row_no").agg(*[of(c).alias(f) for f, c in mapping.items()])
