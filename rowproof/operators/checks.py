"""Expected values from a sheet's cells, checked against document records.

A sheet row becomes one check per line of its ``expected`` cell. Records are reduced to one
row per key and field before any join, so a check meets at most one record whatever repeats.
A check is named by (row_no, nth), the line of its cell.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions.normalize import label_field, norm_digits, norm_key, parse_cell, strip, text
from rowproof.sources.scratch import with_number, written

from .compare import Settings, compare_field, prepared
from .reconcile import CHUNK, closest_keys

# Checkable fields with their labels, statuses in report order, marks words.
LABELS = {"reg": "Registration No.", "abc": "ABC ID", "name": "Student Name", "father": "Father's Name", "mother": "Mother's Name", "dob": "Date of Birth"}
CHECK_STATUSES = (
    "Correct", "Correct (minor differences)", "Needs review", "Still wrong (same as old value)", "Mismatch", "Field not in PDF", "PDF not found",
    "Marks row (not checked)", "Not checked",
)
PROBLEMS = CHECK_STATUSES[2:7]
MARKS = r"(?i)(?<![\p{L}\p{N}_])(?:marks?|total|grade|sgpa|cgpa)(?![\p{L}\p{N}_])"

NAMES = ("name", "father", "mother", "reg")
ROLES = ("enroll", "expected", "claimed", "student", "remark", "abc")


KEYS = ("source", "sheet")
DEALS = 64  # places where the notes of one key are put together, at most; bits of a long
NOT_CHOSEN = "Choose the enrollment column and the expected-data column first."


def check_sheet(cells: DataFrame, headers: DataFrame, columns: DataFrame, last_rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of sheets as cells (source, sheet, row_no, col_no, value): what ``build_checks``
    reads, from the rows below each sheet's header (source, sheet, header_row) in the columns that
    its roles have (source, sheet, role, col), down to its last row (source, sheet, last_row)
    where one is given. A sheet without a column for enrollment numbers or expected values gives
    an error and no row. Header, last row and roles are data, so all sheets are read at once."""
    by = list(KEYS)
    roles = columns.where(F.col("col").isNotNull()).select(*by, "role", F.col("col").alias("col_no"))
    chosen = columns.groupBy(*by).agg(F.count_if(F.col("role").isin("enroll", "expected") & F.col("col").isNotNull()).alias("n"))
    bounds = headers.join(chosen.where("n = 2").select(*by), by)
    last = F.lit(None).cast("int")
    if last_rows is not None:
        bounds, last = bounds.join(last_rows.select(*by, "last_row"), by, "left"), F.nullif(F.col("last_row"), F.lit(0))
    inside = cells.join(bounds, by).where((F.col("row_no") > F.col("header_row")) & (F.col("row_no") <= F.coalesce(last, F.col("row_no"))))
    named = inside.select(*by, "row_no", "col_no", "value").join(roles, [*by, "col_no"])
    rows = named.groupBy(*by, "row_no").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, text(F.col("value")))), F.lit("")).alias(r) for r in ROLES])
    return rows, chosen.where("n < 2").select(*by, F.lit(NOT_CHOSEN).alias("error"))


def build_checks(sheet: DataFrame) -> DataFrame:
    """Checks of ``sheet`` (row_no, enroll, expected and, where present, claimed, student,
    remark, abc, source, sheet): row_no, nth, enroll, student, remark, abc, label, field, expected,
    claimed, kind (field, empty, marks or unsupported), parse_note, and source and sheet where
    they are given. Row-local: no shuffle."""
    cell = lambda c: strip(F.col(c)) if c in sheet.columns else F.lit("")
    own = [c for c in KEYS if c in sheet.columns]
    rows = sheet.select(*own, "row_no", *[cell(c).alias(c) for c in ROLES]).where("enroll != '' or expected != ''")
    rows = rows.withColumns({"lines": parse_cell(F.col("expected")), "old": parse_cell(F.col("claimed"))}).withColumns({"n_lines": F.size("lines"), "n_old": F.size("old")})
    rows = rows.drop("expected", "claimed").select("*", F.posexplode_outer("lines").alias("nth", "line")).drop("lines")
    label, value, named = F.coalesce("line.label", F.lit("")), F.coalesce("line.value", F.lit("")), F.col("line.field")
    blank, bare = F.col("line").isNull(), (F.col("line.label") == "") & F.col("line.field").isNull()
    hinted = label_field(F.col("remark"))
    marks = bare & F.regexp_like(value, F.lit(MARKS))
    field = F.when(bare & ~marks, hinted).otherwise(named)
    kind = F.when(blank, "empty").when(marks, "marks").when(field.isNull(), "unsupported").when(value == "", "empty").otherwise("field")
    why = (
        F.when(blank, "Expected-data cell is empty").when(marks, "")
        .when(bare & field.isNull(), "No 'Label : value' found and Remarks do not name a field")
        .when(field.isNull(), F.concat(F.lit('"'), label, F.lit('" is not a field read from marksheets')))
        .when(value == "", "No value after the label").when(bare, "Field taken from the Remarks column (no label in the cell)").otherwise("")
    )
    found = rows.select(*own, "row_no", F.coalesce("nth", F.lit(0)).alias("nth"), "enroll", "student", "remark", "abc", label.alias("label"), field.alias("field"), value.alias("expected"), kind.alias("kind"), why.alias("parse_note"), "old", "n_lines", "n_old")
    same = F.filter("old", lambda x: x["field"] == F.col("field"))
    last = F.coalesce(F.try_element_at(same, F.lit(-1))["value"], F.lit(""))
    only = F.when((F.col("n_lines") == 1) & (F.col("n_old") == 1), F.col("old")[0]["value"])
    claimed = F.when(F.col("field").isNotNull() & F.col("kind").isin("field", "empty"), F.coalesce(F.nullif(last, F.lit("")), only, F.lit(""))).otherwise("")
    return found.withColumn("claimed", claimed).drop("old", "n_lines", "n_old")


def _own(checks: DataFrame) -> list[str]:
    return ["dup_key", "dup_field", *(c for c in KEYS if c in checks.columns)]


def _keyed(checks: DataFrame) -> DataFrame:
    """``checks`` with the key and field that duplicates share, and the deal where their note is put together."""
    return checks.withColumns({"dup_key": F.when(F.col("kind") == "field", norm_key(F.col("enroll"))), "dup_field": F.col("field"), "deal": _deal(_chunk())})


def _chunk():
    return F.floor(F.col("row_no") / CHUNK)


def _deal(chunk):
    return F.coalesce(F.pmod(chunk, F.lit(DEALS)), F.lit(0)).cast("int")


def _id():
    return F.call_function("shiftleft", F.col("row_no").cast("long"), F.lit(32)) + F.col("nth")


def _duplicate_lists(keyed: DataFrame) -> DataFrame:
    """(by, deal, whole, ids, starts, nexts) of every key and field that several checks share: the numbers
    of all their rows as one text of bytes, and for the checks of the deal where their own begins and the
    next one does. Rows are listed in chunks, and the texts of a key's chunks copied once for each of the
    ``DEALS`` that these fall into."""
    by, label = _own(keyed), F.col("row_no").cast("string")
    size = F.coalesce(F.octet_length(label) + 2, F.lit(0))  # with the comma after it
    rows = keyed.where("dup_key is not null").select(*by, _chunk().alias("chunk"), _id().alias("id"), label.alias("label"), size.alias("size"), "row_no", "nth")
    before = Window.partitionBy(*by, "chunk").orderBy("row_no", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("off", F.coalesce(F.sum("size").over(before), F.lit(0)))
    chunks = rows.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("off", "id", "size", "label"))).alias("rows"), F.sum("size").alias("bytes"))
    ordered = Window.partitionBy(*by).orderBy("chunk")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _deal(F.col("chunk")))
    begin = F.coalesce(F.sum("bytes").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    twice = chunks.withColumns({"n": F.sum(F.size("rows")).over(every), "has": F.bit_or(bit).over(every), "begin": begin}).where("n > 1")
    deals = F.filter(F.sequence(F.lit(0), F.lit(DEALS - 1)), lambda i: F.getbit("has", i) == 1)
    text_ = F.array_join(F.transform("rows", lambda r: r["label"]), ", ")
    dealt = twice.select(*by, "chunk", text_.alias("text"), "begin", "rows", F.explode(deals).alias("deal"))
    here = F.when(F.col("deal") == _deal(F.col("chunk")), F.struct("begin", "rows"))
    listed = dealt.groupBy(*by, "deal").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("texts"), F.collect_list(here).alias("here"))
    of = lambda make: F.flatten(F.transform("here", lambda c: F.transform(c["rows"], lambda r: make(c["begin"] + r["off"], r)).alias("x")))
    whole = F.array_join(F.array_remove(F.transform("texts", lambda t: t["text"]), ""), ", ").cast("binary")
    return listed.select(*by, "deal", whole.alias("whole"), of(lambda at, r: r["id"]).alias("ids"), of(lambda at, r: at).alias("starts"), of(lambda at, r: at + r["size"]).alias("nexts"))


def _with_duplicates(found: DataFrame, lists: DataFrame) -> DataFrame:
    """``found`` with the rows of the others in parse_note, which are what ``lists`` has but their own. A note is as
    long as its key is hot, so that nothing is to be shuffled after this; bytes are cut and not searched."""
    found = found.join(lists, [*_own(found), "deal"], "left").withColumn("nth_id", F.array_position("ids", _id()).cast("int") - 1)
    found = found.withColumns({x: F.coalesce(F.get(f"{x}s", F.col("nth_id")), F.lit(0)).cast("int") for x in ("start", "next")})
    size = F.octet_length("whole")
    cut = lambda at, n: F.substring("whole", at, n).cast("string")
    between = F.when((F.col("start") > 0) & (F.col("next") < size), ", ").otherwise("")
    own = F.col("parse_note")
    lead = F.concat(F.when(own != "", F.concat(own, F.lit("; "))).otherwise(""), F.lit("Same student and field also on row(s) "))
    note = F.concat(lead, cut(F.lit(1), F.col("start") - 2), between, cut(F.col("next") + 1, size))
    return found.withColumn("parse_note", F.when(F.col("whole").isNotNull(), note).otherwise(F.coalesce(own, F.lit(""))))


def mark_duplicates(checks: DataFrame) -> DataFrame:
    """Field checks that share a key and field name the others' rows in parse_note. The notes of a hot key are put
    together in up to ``DEALS`` places, and what is shuffled grows with the rows, though the notes
    themselves grow with their square."""
    keyed = _keyed(checks)
    return _with_duplicates(keyed, _duplicate_lists(keyed)).select(*checks.columns)


def doc_index(records: DataFrame, key, where, place: bool = True) -> DataFrame:
    """(key, recs): per key, in the order of ``LABELS``, the first record that has the field, else the
    key's first record. A row a key, whatever is asked. Without ``place`` its value alone."""
    own = ("file", "path", "page", "unreadable", F.col("note").alias("rec_note")) if place else ()
    rec = lambda f: F.struct(text(F.col(f)).alias("value"), *own)
    keyed = records.where(where).withColumn("key", key)
    best = [F.coalesce(F.min_by(rec(f), F.when(text(F.col(f)) != "", F.col("rec_seq"))), F.min_by(rec(f), "rec_seq")) for f in LABELS]
    return keyed.groupBy("key").agg(F.array(*best).alias("recs"))


def _of_field(recs):
    """The record for the row's own field."""
    at = F.array_position(F.array(*[F.lit(f) for f in LABELS]), F.col("field")) - 1
    return F.get(F.col(recs), at.cast("int"))


def _compared(doc, expected, settings: Settings, dates, names):
    """Comparison by the row's own field; only its kind of comparison gets the values."""
    of = lambda c, *fields: F.when(F.col("field").isin(*fields), c)
    name, dob, abc = (compare_field(f, of(doc, *fs), of(expected, *fs), settings, known) for f, fs, known in (("name", NAMES, names), ("dob", ("dob",), dates), ("abc", ("abc",), None)))
    return F.when(F.col("field") == "dob", dob).when(F.col("field") == "abc", abc).otherwise(name)


def with_defaults(records: DataFrame) -> DataFrame:
    """``records`` with every column that checks read; what is absent is empty."""
    blank = {"path": F.col("file"), "page": F.lit(1), "unreadable": F.lit(False), "note": F.lit("")}
    return records.withColumns({c: x for c, x in blank.items() if c not in records.columns})


def _asking(checks: DataFrame) -> DataFrame:
    """``checks`` with live, whether there is anything to look up, and the keys that they look up by."""
    live = F.col("kind").eqNullSafe("field") & F.col("field").isNotNull() & (text(F.col("expected")) != "")
    return checks.withColumns({"live": live, "reg_key": norm_key(F.col("enroll")), "abc_key": norm_digits(F.col("abc"))})


def _judged(checks: DataFrame, records: DataFrame, settings: Settings, place: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index of records by key, checks beside their record with ``reg_key``, the comparison, status and
    shown values): what statuses need, two joins and no look at other checks."""
    records = with_defaults(records)
    forced = "force_pdf_path" in checks.columns
    found = _asking(checks)
    by_reg = doc_index(records, norm_key(F.col("reg")), text(F.col("reg")) != "", place)
    by_abc = doc_index(records, norm_digits(F.col("abc")), text(F.col("abc")) != "", place)
    hand = F.col("force_pdf_path") if forced else F.lit(None).cast("string")
    # what needs no record asks for what none has, each for its own, so that they do not meet in one task
    none = F.concat(F.lit("-"), F.col("row_no").cast("string"))
    found = found.withColumns({"reg_on": F.when(F.col("live") & hand.isNull(), F.col("reg_key")).otherwise(none), "abc_on": F.when(F.col("live") & hand.isNull() & (F.col("abc") != ""), F.col("abc_key")).otherwise(none)})
    for index, on, name in ((by_reg, "reg_on", "r"), (by_abc, "abc_on", "a")):
        found = _looked_up(found, index, on, name)
    rec, how = F.coalesce("r", "a"), F.when(F.col("r").isNull() & F.col("a").isNotNull(), "matched by ABC ID")
    if forced:
        found = _looked_up(found, doc_index(records, F.col("path"), F.col("path").isNotNull(), place), "force_pdf_path", "f")
        rec, how = F.when(hand.isNotNull(), F.col("f")).otherwise(rec), F.when(hand.isNotNull(), "chosen by hand").otherwise(how)
    found = found.withColumns({"rec": rec, "how": how})
    own = F.col("rec.value")
    found = found.withColumn("pdf_value", F.coalesce("force_pdf_value", own) if "force_pdf_value" in checks.columns else own)
    # dates and cleaned names once, as columns, and only for the rows whose field needs them
    sides = {"p": F.col("pdf_value"), "e": F.col("expected"), "o": F.nullif("claimed", F.lit(""))}
    found = found.withColumns({f"{k}_{f}": prepared(f, F.when(F.col("field").isin(*fs) & F.col("pdf_value").isNotNull(), c), settings) for k, c in sides.items() for f, fs in (("dob", ("dob",)), ("name", NAMES))})
    known = lambda f, other: (F.col(f"p_{f}"), F.col(f"{other}_{f}"))
    found = found.withColumns({
        "cmp": _compared(sides["p"], sides["e"], settings, known("dob", "e"), known("name", "e")),
        "old": _compared(sides["p"], sides["o"], replace(settings, strict=True), known("dob", "o"), known("name", "o"))["status"],
    })
    has, status = F.col("pdf_value") != "", F.col("cmp.status")
    verdict = (
        F.when(F.col("kind") == "marks", "Marks row (not checked)").when(~F.col("live"), "Not checked").when(F.col("rec").isNull(), "PDF not found").when(~has, "Field not in PDF")
        .when(status == "Match", "Correct").when((F.col("claimed") != "") & (F.col("old") == "Match"), "Still wrong (same as old value)")
        .when(status == "Close match", "Correct (minor differences)").when(status == "Review", "Needs review").otherwise("Mismatch")
    )
    return by_reg, found.withColumn("status", verdict)


def _looked_up(found: DataFrame, index: DataFrame, on: str, name: str) -> DataFrame:
    """``found`` with the record that ``index`` has for its key ``on`` and its own field, as ``name``."""
    return found.join(index.select(F.col("key").alias(on), F.col("recs").alias(f"{name}_recs")), on, "left").withColumn(name, _of_field(f"{name}_recs")).drop(f"{name}_recs")


MET = "live and rec is not null"


def _shown(c):
    return F.when(F.expr(MET), c).otherwise("")


def statuses(checks: DataFrame, records: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """What ``evaluate`` gives without notes, score and the record's place: for counts, filters and
    lists, which ask for no near key and no other check of the same student."""
    return _judged(checks, records, settings, place=False)[1].select(*checks.columns, "status")


def _near(lost: DataFrame, keys: DataFrame) -> DataFrame:
    """(reg_key, closest, near_file) of the checks ``lost``, by ``keys`` (key, near_file)."""
    asked = written(lost.where("reg_key != ''").select(F.col("reg_key").alias("key")).distinct())
    return closest_keys(asked, keys).join(keys.withColumnRenamed("key", "closest"), "closest").select(F.col("key").alias("reg_key"), "closest", "near_file")


def _lost_note():
    hint = F.when(F.col("closest").isNotNull(), F.concat(F.lit(". Closest PDF: "), "near_file", F.lit(" ("), "closest", F.lit(")"))).otherwise("")
    return F.concat(F.when(F.col("reg_key") == "", "No enrollment number on this row").otherwise("No uploaded PDF has this enrollment number"), hint)


def lost_notes(checks: DataFrame, records: DataFrame) -> DataFrame:
    """The checks without overrides that ``evaluate`` gives as "PDF not found", with their note. Such a note
    names no other check and no value, so keys alone are looked up: no check meets a record's
    values, and none the list of the rows that share its key."""
    found = _asking(checks).where("live").withColumn("abc_on", F.when(F.col("abc") != "", F.col("abc_key")))
    first = F.coalesce(F.min_by("file", F.when(text(F.col("reg")) != "", F.col("rec_seq"))), F.min_by("file", "rec_seq"))
    keys = written(records.where(text(F.col("reg")) != "").groupBy(norm_key(F.col("reg")).alias("key")).agg(first.alias("near_file")))
    others = records.where(text(F.col("abc")) != "").select(norm_digits(F.col("abc")).alias("abc_on")).distinct()
    found = written(found.join(keys.select(F.col("key").alias("reg_key")), "reg_key", "left_anti").join(others, "abc_on", "left_anti"))
    return found.join(_near(found, keys), "reg_key", "left").select(*checks.columns, F.lit("PDF not found").alias("status"), _lost_note().alias("note"))


def evaluate(checks: DataFrame, records: DataFrame, settings: Settings = Settings(), lists: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``checks`` with pdf_file, pdf_path, pdf_page, pdf_value, status, score and note. With ``lists`` the rows of
    duplicates are named only here, after all other joins.

    Columns force_pdf_path and force_pdf_value, where present, choose a record's file or value
    by hand. Reg numbers compare as names do: two numbers without letters are a match."""
    by_reg, found = _judged(checks, records, settings)
    keys = written(by_reg.select("key", F.col("recs")[0]["file"].alias("near_file")))
    asking = _asking(checks).where("live")
    lost = asking.join(keys.select(F.col("key").alias("reg_key")), "reg_key", "left_anti")  # some are found by their ABC ID, which shows no near key
    if "force_pdf_path" in checks.columns:
        lost = lost.unionByName(asking.where("force_pdf_path is not null"))
    found = found.join(written(_near(lost, keys)), "reg_key", "left")  # written, so that few are known to be few and no check is shuffled for them
    if lists is not None:  # a note of what is not found names no other row
        found = _with_duplicates(found.withColumn("deal", F.when(~F.col("live") | F.col("rec").isNotNull(), F.col("deal")).otherwise(-1 - F.col("deal"))), lists)
    has, status = F.col("pdf_value") != "", F.col("cmp.status")
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("field")]
    tail = [F.col("how"), F.nullif("parse_note", F.lit("")), F.when(F.col("rec.unreadable"), F.nullif(F.col("rec.rec_note"), F.lit("")))]
    differs = F.concat(F.lit('PDF has "'), "cmp.doc", F.lit('", expected "'), "cmp.sheet", F.lit('" ('), "cmp.note", F.lit(")"))
    note = (
        F.when(F.col("kind") == "marks", "Marks are not printed as 'Label : value'; check by hand")
        .when(~F.col("live"), F.coalesce(F.nullif("parse_note", F.lit("")), F.lit("No expected value to check")))
        .when(F.col("rec").isNull(), _lost_note())
        .when(~has, F.concat_ws("; ", F.concat(label, F.lit(" not found in "), "rec.file"), *tail))
        .when(status == "Match", F.concat_ws("; ", F.nullif(F.col("cmp.note"), F.lit("")), *tail)).otherwise(F.concat_ws("; ", differs, *tail))
    )
    met = F.expr(MET)
    return found.select(*checks.columns, _shown(F.col("rec.file")).alias("pdf_file"), _shown(F.col("rec.path")).alias("pdf_path"), F.when(met, F.col("rec.page")).alias("pdf_page"), _shown(F.coalesce("pdf_value", F.lit(""))).alias("pdf_value0"), "status", F.when(met & has, F.col("cmp.score")).alias("score"), note.alias("note")).withColumnRenamed("pdf_value0", "pdf_value")


def run_checks(sheet: DataFrame, records: DataFrame, settings: Settings = Settings(), overrides: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Checks of ``sheet``, with ``overrides`` laid over them, evaluated. number counts them in the order of (row_no, nth)."""
    keyed = _keyed(with_number(build_checks(sheet), "row_no", "nth", name="number"))
    checks = keyed if overrides is None else apply_check_overrides(keyed, overrides)
    return evaluate(checks, records, settings, _duplicate_lists(keyed)).drop("dup_key", "dup_field", "deal")


def run_statuses(sheet: DataFrame, records: DataFrame, settings: Settings = Settings(), overrides: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """The checks of ``run_checks`` with their statuses alone; parse_note does not name the rows of others."""
    checks = build_checks(sheet)
    return statuses(checks if overrides is None else apply_check_overrides(checks, overrides), records, settings)


def apply_check_overrides(checks: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides``: one row per check (row_no, nth) with field, expected, force_pdf_path,
    force_pdf_value. Null leaves a value as it is; an empty path or value is automatic again.
    The changes are listed in ``manual``."""
    new = overrides.select("row_no", "nth", F.col("field").alias("o_field"), F.when(F.col("expected").isNotNull(), strip(F.col("expected"))).alias("o_expected"), F.col("force_pdf_path").alias("o_path"), F.when(F.col("force_pdf_value").isNotNull(), strip(F.col("force_pdf_value"))).alias("o_value"))
    none = F.lit(None).cast("string")
    kept = checks.withColumns({c: none for c in ("force_pdf_path", "force_pdf_value") if c not in checks.columns})
    if "manual" not in kept.columns:
        kept = kept.withColumn("manual", F.array().cast("array<string>"))
    found = kept.join(new, ["row_no", "nth"], "left")
    field = F.coalesce("o_field", "field")
    expected = F.coalesce("o_expected", "expected")
    path = F.nullif(F.coalesce("o_path", "force_pdf_path"), F.lit(""))
    value = F.nullif(F.coalesce("o_value", "force_pdf_value"), F.lit(""))
    refielded, reworded = ~field.eqNullSafe(F.col("field")), expected != F.col("expected")
    kind = F.when(refielded | (reworded & (expected != "") & field.isNotNull()), "field").otherwise(F.col("kind"))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[field]
    said = [
        F.when(refielded, F.concat(F.lit("field set to "), label)), F.when(reworded, F.concat(F.lit('expected set to "'), expected, F.lit('"'))),
        F.when(~path.eqNullSafe(F.col("force_pdf_path")), F.when(path.isNull(), "PDF back to automatic").otherwise(F.concat(F.lit("PDF set to "), path))),
        F.when(~value.eqNullSafe(F.col("force_pdf_value")), F.when(value.isNull(), "PDF value back to automatic").otherwise(F.concat(F.lit('PDF value set to "'), value, F.lit('"')))),
    ]
    changes = F.filter(F.array(*said), lambda x: x.isNotNull())
    kind = F.when((F.size(changes) > 0) & (kind == "field") & field.isNull(), "unsupported").otherwise(kind)
    laid = {"field": field, "expected": expected, "force_pdf_path": path, "force_pdf_value": value, "kind": kind, "manual": F.concat("manual", changes)}
    return found.withColumns(laid).select(*kept.columns)


def apply_record_corrections(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records whose (path, page) is in ``corrections`` take its six fields, blanks as none."""
    fields = tuple(LABELS)
    new = corrections.select("path", "page", F.lit(True).alias("hit"), *[F.nullif(strip(F.col(f)), F.lit("")).alias(f"n_{f}") for f in fields])
    found = with_defaults(records).join(new, ["path", "page"], "left")
    hit = F.col("hit").isNotNull()
    kept = found.withColumns({f: F.when(hit, F.col(f"n_{f}")).otherwise(F.col(f)) for f in fields})
    source = F.col("source") if "source" in records.columns else F.lit("text")
    empty = F.coalesce(*[F.col(f) for f in fields]).isNull()
    return kept.withColumns({"source": F.when(hit, "manual").otherwise(source), "unreadable": F.when(hit, empty).otherwise(F.col("unreadable"))}).drop("hit", *[f"n_{f}" for f in fields])


def remove_records(records: DataFrame, gone: DataFrame) -> DataFrame:
    """``records`` without those whose rec_seq is in ``gone``."""
    return records.join(gone.select("rec_seq").distinct(), "rec_seq", "left_anti").select(*records.columns)
