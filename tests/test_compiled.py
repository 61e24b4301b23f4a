"""Forms that most values have are told by compiled code; they give what the general forms give."""

import random

from pyspark.sql import functions as F

from rowproof.functions import dates as D
from rowproof.functions import normalize as N
from rowproof.operators import reconcile as R
from rowproof.operators import report as A
from rowproof.operators.compare import Settings

BITS = ["", " ", " ", "\t", "\n", "Mr", "MR. ", "Shri ", "miss", " Late ", "A", "b", "Rao", "José", "ﬁ", "é", "ß", "́", "12", "13", "31", "02", "1999", "0021", "99", "-", "/", ".", "E+11", "2.5", "0", "٣", "Feb", "'", "X", "_", "~", "\x7f", "　", "36526", "Ⅳ", "DR"]


def _texts():
    made = random.Random(5)
    days = [f"{a}{s}{b}{s}{c}" for a in ("01", "12", "13", "32", "1999", "0099") for b in ("01", "12", "13", "30", "00") for c in ("0099", "1999", "01", "31", "0000") for s in "-/. "]
    return [None, *days, *("".join(made.choices(BITS, k=made.randint(0, 6))) for _ in range(2000))]


def test_compiled_forms_are_the_general_ones(spark):
    c = F.col("v")
    words = F.filter(F.split(F.regexp_replace(F.upper(N.strip_accents(c)), "[^A-Z]+", " "), " "), lambda w: ~w.isin(*N.TITLES) & (w != ""))
    key = N.once(F.upper(N.trimmed(c)), N._key_of)
    pairs = {"strip": (N.strip(c), N.trimmed(c)), "key": (N.norm_key(c), key), "digits": (N.norm_digits(c), F.regexp_replace(key, "[^0-9]", "")), "name": (N.clean_name(c), F.array_join(words, " "))}
    general = lambda first: N.once(N.ascii_digits(N.trimmed(c)), lambda t: D._parsed(t, first))
    pairs |= {f"day{first}": (D.parse_date_any(c, first).cast("string"), general(first).cast("string")) for first in (True, False)}
    rows = spark.createDataFrame([(t,) for t in _texts()], "v string").repartition(4)
    odd = [(k, r.v, r.a, r.b) for k, (a, b) in pairs.items() for r in rows.select("v", a.alias("a"), b.alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).limit(3).collect()]
    assert not odd, odd


RECORDS = [(1, "11", None, "Asha", "Ram", "Sita", "01-02-2001"), (2, None, "7", "Asha", "Ram", "Sita", "01-02-2001"), (3, "99", None, "X", "Y", "Z", "01-02-2001"), (4, "11", None, "Anil", "Ram", None, "02-01-2001")]
SHEET = [(2, "11", "5", "Asha", "Ram", "Sita", "2001-02-01"), (3, "12", "7", "Asha", "Shri Ram", "Sita", "2001-02-01")]
FIELDS = "reg string, abc string, name string, father string, mother string, dob string"


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_work_verdicts_out_again(spark):
    found = R.verdicts(spark.createDataFrame(RECORDS, f"rec_seq long, {FIELDS}"), spark.createDataFrame(SHEET, f"row_no int, {FIELDS}"), Settings(strict=True))
    kept = A.filter_results(found.select("rec_seq", "verdict"), "Mismatch / not found")
    assert {tuple(r) for r in kept.collect()} == {(3, "Not in Excel"), (4, "Mismatch")}
    assert _plan(kept).count("regexp_replace") <= _plan(found.select("rec_seq", "verdict")).count("regexp_replace")
    assert A.filter_results(found, "All") is found and A.filter_results(found, "Verified").columns == found.columns


def test_counts_work_out_statuses_alone(spark):
    found = R.verdicts(spark.createDataFrame(RECORDS, f"rec_seq long, {FIELDS}"), spark.createDataFrame(SHEET, f"row_no int, {FIELDS}"), Settings(strict=True))
    plan = _plan(found.select("verdict"))
    assert "Same apart from case" not in plan and "Strict: text differs" not in plan
