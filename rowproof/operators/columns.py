"""Which column of a sheet holds which field.

Sheets are grids of cells (source, sheet, row_no, col_no, value), rows counted from 1. Each
column is scored for each field from its header, the shape of its values, how many of the
documents' keys it holds, and how well it agrees with the documents it would be paired with;
then columns are given out one to one. All counts are aggregations by (source, sheet, col_no);
only the last step works on a small group, the fields times the columns of one sheet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions.dates import parse_date_any
from rowproof.functions.normalize import SPACE, clean_name, norm_digits, norm_key, parse_cell, squash, text, trimmed
from rowproof.functions.similarity import name_similarity
from rowproof.sources.scratch import written

# Header patterns and their weights, headers that rule a field out, role patterns.
HEADERS = {
    "reg": ((r"registration|regn|reg\.? ?no|reg ?number|^reg$|regd", 1.0), ("enrol+ment|enrol+ no", 0.9), ("roll", 0.55), ("univ.*(no|id)|student id|^id$", 0.45)),
    "name": (("name of (the )?(student|candidate)|(student|candidate|learner)'?s? ?name", 1.0), ("^(full ?)?name$", 0.9), ("^(student|candidate)$", 0.85), ("^first ?name$|given ?name", 0.8), ("name", 0.45)),
    "name_last": (("^(last|sur) ?name$|^surname$", 1.0), ("last ?name|surname|family name", 0.8)),
    "abc": ((r"\babc\b|\bapaar\b", 1.0),),
    "father": (("father", 1.0), (r"f\.? ?name|fname", 0.6), ("guardian", 0.5)),
    "mother": (("mother", 1.0), (r"m\.? ?name|mname", 0.6)),
    "dob": ((r"birth|\bdob\b|d\.o\.b", 1.0), (r"^b\.? ?date$|bdate", 0.8), ("date", 0.3)),
}
RULED_OUT = {
    "name": "father|mother|guardian|husband|course|programme|school|college|institut|subject|last ?name|surname|middle|family name|regional",
    "dob": "admission|issue|exam|publi|join",
}
EXPECTED = r"(?i)meritto|merito|\btr\b|expected|correct|should be|data as per|as per record"
CLAIMED = r"(?i)\bin (?:the )?mark ?sheet|mark ?sheet (?:data|value)|printed|wrong|incorrect|old value|current"
REMARK = "(?i)remark|comment|issue|discrepanc|observation"
MAIN = ("reg", "name", "abc", "father", "mother", "dob")
ROLES = ("enroll", "expected", "claimed", "student", "remark", "abc")
SHEET, COLUMN = ["source", "sheet"], ["source", "sheet", "col_no"]
SAMPLE_ROWS = 400  # shapes are taken from a sheet's first rows with data; keys from all rows


def header_score(field: str, c):
    """0 to 1: the largest weight of the field's patterns in a header."""
    t = trimmed(F.regexp_replace(F.lower(text(c)), f"[_{SPACE}]+", " "))
    weights = [F.when(F.regexp_like(t, F.lit(p)), F.lit(w)).otherwise(F.lit(0.0)) for p, w in HEADERS[field]]
    best = F.greatest(*weights) if len(weights) > 1 else weights[0]
    return F.when(F.regexp_like(t, F.lit(RULED_OUT[field])), 0.0).otherwise(best) if field in RULED_OUT else best


def role_score(role: str, c):
    """0 to 1: how well a header names a role of a sheet of expected values."""
    t = squash(c)
    said = lambda p: F.regexp_like(t, F.lit(p))
    if role in ("enroll", "student", "abc"):
        return header_score({"enroll": "reg", "student": "name"}.get(role, role), t)
    fits = {"claimed": said(CLAIMED), "expected": said(EXPECTED) & ~said(CLAIMED), "remark": said(REMARK)}[role]
    return F.when(fits, 1.0).otherwise(0.0)


def _top_row(rows: DataFrame, least: int) -> DataFrame:
    """(source, sheet, header_row): the first row with the largest n, -1 below ``least``."""
    best = rows.groupBy(*SHEET).agg(F.max_by("row_no", F.struct(F.col("n"), -F.col("row_no"))).alias("row_no"), F.max("n").alias("n"))
    return best.select(*SHEET, F.when(F.col("n") >= least, F.col("row_no")).otherwise(-1).alias("header_row"))


def detect_header_row(cells: DataFrame, first: int = 20) -> DataFrame:
    """Among the first rows, the one with most cells that name a field."""
    named = F.greatest(*[header_score(f, F.col("value")) for f in MAIN]) >= 0.6
    return _top_row(cells.where(F.col("row_no") <= first).groupBy(*SHEET, "row_no").agg(F.count_if(named).alias("n")), 1)


def detect_role_header_row(cells: DataFrame, first: int = 30) -> DataFrame:
    """Among the first rows, the one that names most distinct roles; at least two."""
    n = sum((F.max(F.when(role_score(r, F.col("value")) >= 0.5, 1).otherwise(0)) for r in ROLES), F.lit(0))
    return _top_row(cells.where(F.col("row_no") <= first).groupBy(*SHEET, "row_no").agg(n.alias("n")), 2)


def _below(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Non-empty cells below each sheet's header."""
    return cells.join(headers, SHEET).where("row_no > header_row").where(text(F.col("value")) != "").select(*COLUMN, "row_no", "value")


def profile_columns(cells: DataFrame, headers: DataFrame, day_first: bool = True) -> DataFrame:
    """Shares of non-empty values by shape, in the first rows with data: id_like, uniq,
    date_like, name_like."""
    data = _below(cells, headers)
    rows = data.select(*SHEET, "row_no").distinct().withColumn("nth", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_no")))
    v = F.col("value")
    day = parse_date_any(v, day_first).isNotNull()
    packed = F.replace(v, F.lit(" "), F.lit(""))
    share = lambda c, name: F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name)
    sample = data.join(rows.where(F.col("nth") <= SAMPLE_ROWS).drop("nth"), [*SHEET, "row_no"], "left_semi")
    return sample.groupBy(*COLUMN).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.regexp_like(packed, F.lit(r"\p{Nd}{5,}")) & ~day, "id_like"),
        (F.count_distinct(norm_key(v)) / F.count(F.lit(1))).alias("uniq"),
        share(day, "date_like"),
        share(F.regexp_like(v, F.lit(rf"\A[A-Za-z][A-Za-z.{SPACE}'\-]{{2,}}\z")), "name_like"),
            )


def key_overlap(cells: DataFrame, headers: DataFrame, records: DataFrame) -> DataFrame:
    """Per column, how many records have their reg (and abc) key anywhere in it."""
    data = _below(cells, headers)

    def hits(field, norm):
        keys = records.where(text(F.col(field)) != "").groupBy(norm(F.col(field)).alias("key")).agg(F.count(F.lit(1)).alias("records"))
        held = data.select(*COLUMN, norm(F.col("value")).alias("key")).distinct()
        return held.join(keys, "key").groupBy(*COLUMN).agg(F.sum("records").alias(f"{field}_hits"))

    columns = cells.select(*COLUMN).distinct()
    found = columns.join(hits("reg", norm_key), COLUMN, "left").join(hits("abc", norm_digits), COLUMN, "left")
    return found.select(*COLUMN, *[F.coalesce(f"{f}_hits", F.lit(0)).alias(f"{f}_hits") for f in ("reg", "abc")])


AGREEING = ("name", "father", "mother", "dob")


def pair_agreement(cells: DataFrame, headers: DataFrame, records: DataFrame, key_columns: DataFrame, day_first: bool = True, ignore_titles: bool = True) -> DataFrame:
    """Per column and field, over records paired by the key column (source, sheet, reg_col):
    how many have a value, and for how many the column agrees with it. Names are cleaned and dates
    read once a value, and a sheet's row meets a record as one row. Pairs of names that are equal
    or too far apart are counted at once; the others are compared once, however often they occur."""
    c, v = F.col, F.col("value")
    clean = lambda x: clean_name(x, ignore_titles)
    lone = lambda x: F.regexp_like(x, F.lit(r"\b[A-Z]\b"))  # only such names can match by initials
    held = _below(cells, headers).join(key_columns, SHEET).select(*COLUMN, "row_no", "reg_col", F.when(c("col_no") == c("reg_col"), norm_key(v)).alias("key"), clean(v).alias("y"), parse_date_any(v, day_first).alias("day"))
    rows = held.groupBy(*SHEET, "row_no", "reg_col").agg(F.max("key").alias("key"), F.collect_list(F.struct("col_no", "y", lone(c("y")).alias("y_lone"), "day")).alias("cells"))
    first = rows.where("key is not null").groupBy(*SHEET, "reg_col", "key").agg(F.min_by("cells", "row_no").alias("cells"))
    own = [F.when(text(c(f)) != "", clean(c(f))).alias(f) for f in AGREEING[:-1]]
    told = records.where(text(c("reg")) != "").select(norm_key(c("reg")).alias("key"), *own, (text(c("dob")) != "").alias("dated"), parse_date_any(c("dob"), day_first).alias("told_day"))
    one = lambda f, x, there, day: F.struct(F.lit(f).alias("field"), there.alias("is_told"), x.alias("x"), lone(x).alias("x_lone"), day.alias("told_day"))
    told = told.select("key", F.array(*[one(f, c(f), c(f).isNotNull(), F.lit(None).cast("date")) for f in AGREEING[:-1]], one("dob", F.lit(None).cast("string"), c("dated"), c("told_day"))).alias("told"))
    # each field meets each cell in one short expression, as code that is too long is not compiled
    met = told.join(first, "key").select(*SHEET, "reg_col", "told", F.inline("cells")).select(*COLUMN, (c("col_no") == c("reg_col")).alias("is_key"), "y", "y_lone", "day", F.inline("told")).where("is_told")
    x, y = c("x"), c("y")
    size = F.octet_length(x), F.octet_length(y)  # lengths tell which pairs can reach 85 at all
    glued = (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & (F.replace(x, F.lit(" ")) == F.replace(y, F.lit(" ")))
    can = (200 * F.least(*size) >= 84.94 * (size[0] + size[1])) | c("x_lone") | c("y_lone") | glued
    same = F.when(c("field") == "dob", F.coalesce(c("told_day") == c("day"), F.lit(False))).when(x == y, True).when((x == "") | (y == "") | ~can, False)
    each = met.withColumn("same", same).select(*COLUMN, "is_key", "field", "same", *[F.when(c("same").isNull(), c(n)).alias(n) for n in ("x", "y")])
    pairs = written(each.groupBy(*COLUMN, "is_key", "field", "same", "x", "y").agg(F.count(F.lit(1)).alias("records")))
    asked = pairs.where("is_key").groupBy(*SHEET, "field").agg(F.sum("records").alias("told"))  # a paired row has a key
    near = pairs.where("same is null").select(*COLUMN, "field", "records", (name_similarity(c("x"), c("y"), ignore_titles, (c("x"), c("y")))["score"] >= 85).alias("same"))
    found = pairs.where("same is not null").select(*COLUMN, "field", "records", "same").unionByName(near)
    return found.groupBy(*COLUMN, "field").agg(F.sum(F.when(c("same"), c("records")).otherwise(0)).alias("hits")).join(asked, [*SHEET, "field"])


def _scored(field, score, *reasons):
    return F.struct(F.lit(field).alias("field"), F.least(F.lit(1.0), score).alias("score"), F.concat_ws(", ", *reasons).alias("reason"))


def column_scores(cells: DataFrame, headers: DataFrame, records: DataFrame, pinned: dict[str, int] | None = None) -> DataFrame:
    """(source, sheet, col_no, field, score, reason) of every column for every field. Records are
    read several times, so the columns that count are written once."""
    records = written(records.select("reg", "abc", *AGREEING))
    n = records.agg(F.count_if(text(F.col("reg")) != "").alias("reg"), F.count_if(text(F.col("abc")) != "").alias("abc")).first()
    named = cells.join(headers, SHEET).where("row_no = header_row").select(*COLUMN, text(F.col("value")).alias("header"))
    facts = key_overlap(cells, headers, records).join(named, COLUMN, "left").join(profile_columns(cells, headers), COLUMN, "left")
    facts = facts.fillna("", ["header"]).fillna(0.0, ["id_like", "uniq", "date_like", "name_like"])
    col = F.col
    h = {f: header_score(f, col("header")) for f in HEADERS}
    titled = lambda f: F.when(h[f] >= 0.5, F.concat(F.lit('header "'), col("header"), F.lit('"')))
    found = lambda f, what: F.when(col(f"{f}_hits") > 0, F.concat(col(f"{f}_hits").cast("string"), F.lit(f" of {n[f]} PDF {what} found")))
    looks = F.when((col("reg_hits") == 0) & (col("id_like") > 0.7), "values look like ID numbers")
    sure = F.when((h["reg"] >= 0.5) & (col("id_like") > 0.7), 0.15).otherwise(0.0)
    reg = 0.55 * h["reg"] + 0.2 * col("id_like") * col("uniq") + 0.7 * col("reg_hits") / max(1, n["reg"]) + sure
    abc = 0.8 * h["abc"] + 0.7 * col("abc_hits") / max(1, n["abc"])
    keys = facts.select(*COLUMN, F.explode(F.array(_scored("reg", reg, titled("reg"), found("reg", "reg. numbers"), looks), _scored("abc", abc, titled("abc"), found("abc", "ABC IDs")), _scored("name_last", 0.6 * h["name_last"], titled("name_last")))).alias("x")).select(*COLUMN, "x.*")
    if pinned and "reg" in pinned:
        chosen = cells.select(*SHEET).distinct().withColumn("reg_col", F.lit(pinned["reg"]))
    else:
        chosen = keys.where("field = 'reg' and score >= 0.3").groupBy(*SHEET).agg(F.max_by("col_no", F.struct(col("score"), -col("col_no"))).alias("reg_col"))
    agreed = pair_agreement(cells, headers, records, chosen)
    rest = facts.withColumn("field", F.explode(F.array(*[F.lit(f) for f in AGREEING]))).join(agreed, [*COLUMN, "field"], "left")
    own = F.coalesce(*[F.when(col("field") == f, h[f]) for f in AGREEING])
    part = F.coalesce(col("hits") / col("told"), F.lit(0.0))
    score = F.when(col("field") == "dob", 0.55 * own + 0.3 * col("date_like") + 0.6 * part).otherwise(0.6 * own + 0.1 * col("name_like") + 0.6 * part)
    many = F.when(col("hits") > 0, F.concat_ws(" ", col("hits").cast("string"), F.lit("of"), col("told").cast("string"), F.lit("PDF values match")))
    days = F.when((F.coalesce(col("hits"), F.lit(0)) == 0) & (col("field") == "dob") & (col("date_like") > 0.7), F.concat(F.bround(100 * col("date_like")).cast("int").cast("string"), F.lit("% of values are dates")))
    title = F.when(own >= 0.5, F.concat(F.lit('header "'), col("header"), F.lit('"')))
    return keys.where("field != 'name_last' or score > 0").unionByName(rest.select(*COLUMN, "field", F.least(F.lit(1.0), score).alias("score"), F.concat_ws(", ", title, many, days).alias("reason")))


def _given_out(scores: DataFrame, pinned: dict[str, int], order, fields, steps: tuple[float, float]) -> DataFrame:
    """Columns of ``scores`` given to ``fields`` one to one in ``order``; a group is one sheet's
    fields times its columns."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        source, sheet = rows["source"].iloc[0], rows["sheet"].iloc[0]
        got = {f: (c, "manual", 1.0, "Set manually") for f, c in pinned.items()}
        used = set(pinned.values())
        for x in sorted(rows.itertuples(), key=order):
            if x.score >= 0.3 and x.field not in got and x.col_no not in used:
                got[x.field] = x.col_no, "high" if x.score >= steps[0] else "medium" if x.score >= steps[1] else "low", x.score, x.reason
                used.add(x.col_no)
        out = [(source, sheet, f, *got.get(f, (None, "none", 0.0, ""))) for f in fields]
        return pd.DataFrame(out, columns=["source", "sheet", "field", "col", "confidence", "score", "reason"]).astype({"col": "Int32"})

    return scores.groupBy(*SHEET).applyInPandas(choose, "source string, sheet string, field string, col int, confidence string, score double, reason string")


def assign_columns(scores: DataFrame, pinned: dict[str, int] | None = None) -> DataFrame:
    """(source, sheet, field, col, confidence, score, reason): columns given out one to one, the
    best score first, equal scores in the order abc and last name, reg, name, father, mother,
    dob and then by column; pinned columns come first, and scores below 0.3 give none."""
    place = {"abc": 0, "name_last": 0, "reg": 1, "name": 2, "father": 3, "mother": 4, "dob": 5}
    return _given_out(scores, pinned or {}, lambda x: (-x.score, place[x.field], x.col_no, x.field), HEADERS, (0.75, 0.5))


def detect_check_columns(cells: DataFrame, headers: DataFrame, records: DataFrame, pinned: dict[str, int] | None = None) -> DataFrame:
    """(source, sheet, role, col, confidence, score, reason) of the columns of a sheet of expected
    values: enrollment numbers by header, shape and the documents that they name; expected and
    printed values by header and cells that read "label : value"; the others by header."""
    value, key = F.col("value"), norm_key(F.col("value"))
    keys = written(records.where(text(F.col("reg")) != "").select(norm_key(F.col("reg")).alias("key")).distinct())
    total, least, most = keys.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    # a line has a label only with a colon, and a key only digits if its value has one
    labelled = F.when(F.contains(value, F.lit(":")) | F.contains(value, F.lit("：")), F.exists(parse_cell(value), lambda x: x["field"].isNotNull())).otherwise(False)
    digits = F.when(F.regexp_like(value, F.lit(r"\p{Nd}")), F.regexp_like(key, F.lit(r"\A[0-9]{6,}\z"))).otherwise(False)
    below = (F.col("row_no") > F.col("header_row")) & (text(value) != "")
    share = lambda x: F.avg(F.when(below, F.when(x, 1.0).otherwise(0.0)))
    shape = cells.join(headers, SHEET, "left").groupBy(*COLUMN).agg(F.max(F.when(F.col("row_no") == F.col("header_row"), text(value))).alias("header"), share(digits).alias("id_like"), share(labelled).alias("labelled"))
    near = _below(cells, headers).select(*COLUMN, key.alias("key")).where(F.col("key").between(least, most)) if total else cells.select(*COLUMN, F.lit("").alias("key")).where("false")
    hits = near.join(keys, "key", "left_semi").groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("hits"))
    facts = written(shape.join(hits, COLUMN, "left").fillna("", ["header"]).fillna(0.0, ["id_like", "labelled"]).fillna(0, ["hits"]))
    c = F.col
    out = []
    for role in ROLES:
        h = role_score(role, c("header"))
        title = F.when(h >= 0.5, F.concat(F.lit('header "'), c("header"), F.lit('"')))
        if role == "enroll":
            score = 0.6 * h + 0.3 * c("id_like") + (0.5 * F.least(F.lit(1.0), c("hits") / total) if total else F.lit(0.0))
            more = F.when(c("hits") > 0, F.concat(c("hits").cast("string"), F.lit(" PDF reg. numbers found"))).when(c("id_like") > 0.7, "values look like ID numbers")
        elif role in ("expected", "claimed"):
            tie = -0.01 * c("col_no") if role == "expected" else 0.01 * c("col_no") * F.when(h > 0, 1).otherwise(0)
            score = 0.7 * h + 0.3 * c("labelled") + tie
            more = F.when(c("labelled") > 0.3, F.concat(F.bround(100 * c("labelled"), 0).cast("int").cast("string"), F.lit("% of cells look like 'Label : value'")))
        else:
            score, more = 0.8 * h, F.lit(None).cast("string")
        out.append(F.struct(F.lit(role).alias("field"), score.cast("double").alias("score"), F.concat_ws(", ", title, more).alias("reason")))
    scores = facts.select(*COLUMN, F.inline(F.array(*out)))
    return _given_out(scores, pinned or {}, lambda x: (-x.score, x.col_no, ROLES.index(x.field)), ROLES, (0.7, 0.5)).withColumnRenamed("field", "role")
