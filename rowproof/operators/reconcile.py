"""Pairing of records with sheet rows on a normalised key, and their comparison.

The sheet is reduced to one row per key before any join, so joins are many-to-one whatever
repeats on either side; empty keys are left out before they are shuffled. Keys, dates and
cleaned names are worked out once per row as columns, the sheet's also written; comparisons read
these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.functions.normalize import norm_digits, norm_key, row_label, strip, text
from rowproof.functions.similarity import rule
from rowproof.sources.scratch import written

from .compare import FIELDS, PARTS, Settings, compare_parts, overall, prepared

MAPPED = ("reg", "abc", "name", "father", "mother", "dob", "name_last")
CHUNK = 1000  # row numbers whose rows of one key are listed together
MARKS = 1 << 23  # bits, a megabyte
DEEP = tuple(f for f in FIELDS if f != "abc")
NO_KEY, NOT_THERE = "Registration number not found in the PDF", "Registration number not found in Excel"


def key_index(sheet: DataFrame, key) -> DataFrame:
    """(key, first struct, n): the first row of each key and how many rows have it."""
    keyed = sheet.withColumn("key", key).where("key != ''")
    return keyed.groupBy("key").agg(F.min_by(F.struct(*sheet.columns), "row_no").alias("first"), F.count(F.lit(1)).alias("n"))


def row_chunks(rows: DataFrame, by: list[str], label: str, order: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """(by, chunk, rows): the rows of each key as arrays of struct(order, label) in order, those of
    ``CHUNK`` row numbers together, so that no group holds all rows of a key that many have."""
    each = F.struct(*order, F.col(label).cast("string").alias("label"))
    return rows.groupBy(*by, F.floor(F.col("row_no") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(each)).alias("rows"))


def row_texts(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, texts): the labels of each chunk, joined, as struct(chunk, text) in order."""
    named = chunks.select(*by, "chunk", F.array_join(F.transform("rows", lambda r: r["label"]), ", ").alias("text"))
    return named.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("texts"))


def key_rows(sheet: DataFrame, key, wanted: DataFrame, label="row_no") -> DataFrame:
    """(key, rows): the labels of all rows of the keys in ``wanted`` (key), in order, comma-joined."""
    found = sheet.withColumn("key", key).join(wanted.select("key").distinct(), "key", "left_semi")
    return row_texts(row_chunks(found, ["key"], label), ["key"]).select("key", F.array_join(F.transform("texts", lambda t: t["text"]), ", ").alias("rows"))


def variants(key):
    """A key and what is left of it without one of its characters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))
    return F.array_distinct(F.concat(F.array(key), F.when(F.length(key) > 0, cut).otherwise(F.array().cast("array<string>"))))


def _marked(variant):
    """The bit of ``MARKS`` that a variant has."""
    return F.pmod(F.xxhash64(variant), F.lit(MARKS))


def _marks(variants_: DataFrame):
    """The bits of all variants (v) as one array of longs, a value of fixed size whatever their
    number; ready within the query, as a scalar subquery."""
    words = variants_.select(_marked(F.col("v")).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    every = variants_.sparkSession.range(MARKS // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"])).scalar()


def closest_keys(missing: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, closest): the smallest of ``keys`` (key) one edit away. Two strings one edit apart
    share a variant, so this is an equality join on variants, then a check.

    Few keys are near a missing one, so keys that share no variant with any are left out before
    theirs become rows: each is looked up among the marks of the missing keys' variants, a bit
    each of ``MARKS``. Marks may coincide, which costs a row and changes nothing."""
    left = missing.select("key").where("key != ''").distinct().withColumn("v", F.explode(variants(F.col("key"))))
    right = keys.select(F.col("key").alias("closest")).distinct().withColumn("vs", variants(F.col("closest"))).withColumn("marks", _marks(left))
    marked = lambda v: F.getbit(F.get(F.col("marks"), F.shiftright(_marked(v), 6).cast("int")), (_marked(v) % 64).cast("int")) == 1
    right = right.select("closest", F.explode(F.filter("vs", marked)).alias("v"))
    near = left.join(right, "v").where(F.levenshtein("key", "closest") == 1)
    return near.groupBy("key").agg(F.min("closest").alias("closest"))


def sheet_values(sheet: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """``sheet`` (row_no[, sheet] and a column per mapped field) -> row_no, excel_row, place, the raw
    values of all fields, blank where a field is not mapped. A name gets the last name's column
    appended where that holds anything."""
    mapping = mapping or {f: f for f in MAPPED if f in sheet.columns}
    if mapping.get("reg") is None:
        raise ValueError("map the registration number first: rows are paired by it")
    cell = lambda f: text(F.col(mapping[f])) if mapping.get(f) else F.lit("")
    of = {f: cell(f) for f in MAPPED}
    name = F.when(of["name_last"] != "", strip(F.concat(of["name"], F.lit(" "), of["name_last"]))).otherwise(of["name"])
    book = text(F.col("sheet")) if "sheet" in sheet.columns else F.lit("")
    row = F.col("row_no").cast("string")
    place = F.when(book != "", F.concat(F.lit("sheet "), book, F.lit(" row "), row)).otherwise(F.concat(F.lit("row "), row))
    return sheet.select("row_no", row_label(book, F.col("row_no")).alias("excel_row"), place.alias("place"), *[(name if f == "name" else of[f]).alias(f) for f in MAPPED[:-1]])


def _on(key, abc_key, otherwise):
    """What a row is paired on: its key, else its ABC ID; ``otherwise`` where it has neither."""
    return F.when(key != "", F.concat(F.lit("r"), key)).when(abc_key != "", F.concat(F.lit("a"), abc_key)).otherwise(otherwise)


def pair(records: DataFrame, rows: DataFrame) -> DataFrame:
    """``records`` with key, on, paired_by ("reg", "abc" or null), row (the first sheet row of that
    key) and n, how many rows have it. One join: sheet rows are found by either key, a record
    asks for one of them. Records without any ask for what no row has, each for its own, so that they
    do not meet in one task."""
    kinds = [F.when(k != "", F.concat(F.lit(p), k)) for p, k in (("r", norm_key(F.col("reg"))), ("a", norm_digits(F.col("abc"))))]
    each = rows.select("*", F.explode(F.array_compact(F.array(*kinds))).alias("on"))
    index = each.groupBy("on").agg(F.min_by(F.struct(*rows.columns), "row_no").alias("row"), F.count(F.lit(1)).alias("n"))
    keyed = records.withColumns({"key": norm_key(F.col("reg")), "abc_key": norm_digits(F.col("abc"))})
    keyed = keyed.withColumn("on", _on(F.col("key"), F.col("abc_key"), F.concat(F.lit("-"), F.col("rec_seq").cast("string")))).drop("abc_key")
    paired_by = F.when(F.col("row").isNotNull(), F.when(F.col("key") != "", "reg").otherwise("abc"))
    return keyed.join(index, "on", "left").withColumn("paired_by", paired_by)


def _paired(records: DataFrame, sheet: DataFrame, settings: Settings, mapping: dict[str, str] | None):
    """(rows of the sheet, records with the row that each is paired with and a struct per field)."""
    mapping = mapping or {f: f for f in MAPPED if f in sheet.columns}
    mapped = [f for f in FIELDS if mapping.get(f)]
    rows = sheet_values(sheet, mapping).select("*", *[strip(F.col(f)).alias(f"e_{f}") for f in mapped])
    rows = written(rows.select("*", *[prepared(f, F.col(f"e_{f}"), settings).alias(f"y_{f}") for f in DEEP if f in mapped]))
    own = records.select("rec_seq", *[text(F.col(f)).alias(f) for f in ("reg", *FIELDS)], (text(F.col("note")) if "note" in records.columns else F.lit("")).alias("rec_note"))
    found = pair(own, rows)  # values as they stand are shuffled; all else is worked out beside the row
    found = found.select("*", *[strip(F.col(f)).alias(f"p_{f}") for f in mapped])
    hit = F.col("row").isNotNull()
    found = found.select("*", *[F.when(hit, prepared(f, F.col(f"p_{f}"), settings)).alias(f"x_{f}") for f in DEEP if f in mapped])
    known = {f: (F.col(f"x_{f}"), F.col(f"row.y_{f}")) for f in DEEP if f in mapped}
    names = [] if settings.strict else [f for f in known if f != "dob"]
    found = found.select("*", *[rule(*known[f]).alias(f"r_{f}") for f in names])
    skipped = lambda f, why: (F.lit("Not compared"), F.lit(None).cast("double"), F.lit(why), F.col(f), F.lit(""))
    fields = {}  # a part each, so that verdicts ask for statuses alone
    for f in FIELDS:
        made = compare_parts(f, F.col(f"p_{f}"), F.col(f"row.e_{f}"), settings, known.get(f), F.col(f"r_{f}") if f in names else None) if f in mapped else None
        parts = made if f in mapped else skipped(f, "Column not mapped")
        fields[f] = [F.when(hit, a).otherwise(b).alias(p) for p, a, b in zip(PARTS, parts, skipped(f, ""), strict=True)]
    found = found.select("*", *[fields[f][0].alias(f"s_{f}") for f in FIELDS])
    fields = {f: F.struct(F.col(f"s_{f}").alias(PARTS[0]), *parts[1:]) for f, parts in fields.items()}
    row_no = F.col("row.row_no")
    verdict = F.when(row_no.isNotNull(), overall([F.col(f"s_{f}") for f in FIELDS])).when(F.col("key") == "", "No reg. no. in PDF").otherwise("Not in Excel")
    return rows, found.select("rec_seq", row_no.alias("row_no"), F.col("row.excel_row").alias("excel_row"), "paired_by", "key", "on", "n", "rec_note", F.col("row.reg").alias("sheet_reg"), verdict.alias("verdict"), *[c.alias(f) for f, c in fields.items()])


def verdicts(records: DataFrame, sheet: DataFrame, settings: Settings = Settings(), mapping: dict[str, str] | None = None) -> DataFrame:  # noqa: B008
    """What ``reconcile`` gives without closest keys and notes: one join, for counts and filters."""
    return _paired(records, sheet, settings, mapping)[1].select("rec_seq", "row_no", "excel_row", "paired_by", "verdict", "sheet_reg", *FIELDS)


def reconcile(records: DataFrame, sheet: DataFrame, settings: Settings = Settings(), mapping: dict[str, str] | None = None) -> DataFrame:  # noqa: B008
    """One row per record: rec_seq, row_no, excel_row, paired_by, verdict, closest, note, sheet_reg,
    and a struct (status, score, note, doc, sheet) per field. ``mapping``: column of each field,
    a field's own name unless given. The result is not computed before it is used, and then only
    the columns that are: write it first if it is used several times."""
    rows, found = _paired(records, sheet, settings, mapping)
    hit = F.col("row_no").isNotNull()
    keys = rows.select(norm_key(F.col("reg")).alias("key"), "row_no", "reg", "place").where("key != ''")
    lost = written(found.where(~hit & (F.col("key") != "")).select("key").distinct())
    first = keys.groupBy(F.col("key").alias("closest")).agg(F.min_by(F.struct("reg", "place"), "row_no").alias("near"))
    near = closest_keys(lost, keys).join(first, "closest").select(F.concat(F.lit("r"), "key").alias("on"), "closest", "near")
    # rows of repeated keys
    both = [keys.select(F.concat(F.lit("r"), "key").alias("on"), "row_no", "place"), rows.select(F.concat(F.lit("a"), norm_digits(F.col("abc"))).alias("on"), "row_no", "place").where("on != 'a'")]
    both = both[0].unionByName(both[1])
    twice = both.groupBy("on").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("on")
    lists = row_texts(row_chunks(both.join(twice, "on", "left_semi"), ["on"], "place"), ["on"]).select("on", F.array_join(F.transform("texts", lambda t: t["text"]), ", ").alias("rows"))
    more = near.select("*", F.lit(None).cast("string").alias("rows")).unionByName(lists, allowMissingColumns=True)  # a key is near another or repeated, not both
    found = found.join(more, "on", "left")
    several = F.when(F.col("rows").isNotNull(), F.concat(F.when(F.col("paired_by") == "abc", "ABC ID").otherwise("Reg. no."), F.lit(" appears in Excel at "), "rows", F.lit("; first used")))
    paired = F.concat_ws("; ", F.when(F.col("paired_by") == "abc", "No reg. no. in the PDF; paired by ABC ID"), several)
    hint = F.when(F.col("near").isNotNull(), F.concat(F.lit(". Closest in Excel: "), "near.reg", F.lit(" ("), "near.place", F.lit(")"))).otherwise("")
    note = F.when(hit, paired).when(F.col("key") == "", F.when(F.col("rec_note") != "", F.col("rec_note")).otherwise(NO_KEY)).otherwise(F.concat(F.lit(NOT_THERE), hint))
    return found.select("rec_seq", "row_no", "excel_row", "paired_by", "verdict", F.when(~hit, F.col("closest")).alias("closest"), note.alias("note"), "sheet_reg", *FIELDS)


def unmatched_rows(results: DataFrame, sheet: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Sheet rows that no record used and that have a key: row_no, reg, name. A row is known by its
    label, so sheets that were combined may repeat row numbers."""
    used = results.where("excel_row is not null").select("excel_row").distinct()
    return sheet_values(sheet, mapping).where("reg != ''").join(used, "excel_row", "left_anti").select("row_no", "excel_row", "reg", "name")
