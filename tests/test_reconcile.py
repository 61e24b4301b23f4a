import itertools

from pyspark.sql import functions as F

from rowproof.functions import normalize as N
from rowproof.functions.dates import parse_date_any
from rowproof.functions.similarity import indel, initials_match, lcs_length, name_similarity
from rowproof.operators.compare import overall
from rowproof.operators.reconcile import closest_keys


def test_keys(spark):
    rows = [("2.51612400699E+11", "251612400699"), ("123.0", "123"), (" 25-16/12 ", "251612"), (None, ""), ("ab c", "ABC")]
    got = spark.createDataFrame(rows, "v string, want string").select(N.norm_key(F.col("v")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_names(spark):
    rows = [("Shri José  García", "JOSE GARCIA"), ("Miss", ""), ("a.b", "A B"), ("ﬁne ＡＢ e\u0301 ß Ⅳ", "FINE AB E SS IV"), ("ñandú Łukasz", "NANDU UKASZ"), (None, "")]
    got = spark.createDataFrame(rows, "v string, want string").select(N.clean_name(F.col("v")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_clean_value(spark):
    rows = [("reg", " no. 25/16-12 x", "25/16-12"), ("reg", "n/a", "n/a"), ("dob", "on 03 Feb, 2001.", "03 Feb, 2001"), ("dob", "x", "x"), ("abc", "ID 1234-5678 90", "1234567890"), ("abc", "12-3", "12-3"), ("name", " : Asha Rao., ", "Asha Rao"), ("name", None, "")]
    frame = spark.createDataFrame(rows, "field string, v string, want string")
    for field in ("reg", "dob", "abc", "name"):
        got = frame.where(F.col("field") == field).select(N.clean_value(field, F.col("v")).alias("got"), "want").collect()
        assert all(r.got == r.want for r in got), got


def test_dates(spark):
    rows = [("2001-02-03", "2001-02-03"), ("03/02/2001", "2001-02-03"), ("02-13-2001", "2001-02-13"), ("3rd Feb 2001", "2001-02-03"), ("Feb 3, 01", "2001-02-03"), ("1.1.31", "1931-01-01"), ("1.1.30", "2030-01-01"), ("31-02-2001", None), ("10000", None), ("3RD Feb 2001", None), ("3,Feb 2001", None), ("Feb/3 2001", None), ("Feb 0301", "2001-02-03"), ("3 Septemberish 2001", "2001-09-03"), ("0021-01-02", "0021-01-02"), ("٠٣/٠٢/٢٠٠١", "2001-02-03"), ("3 Foo 2001", None), ("36526.5", "2000-01-01"), ("36526", "2000-01-01"), ("x", None)]
    got = spark.createDataFrame(rows, "v string, want string").select(parse_date_any(F.col("v")).cast("string").alias("got"), "want", "v").collect()
    assert all(r.got == r.want for r in got), got


def test_similarity_ladder(spark):
    rows = [("A Kumar", "Ashok Kumar", 95.0), ("Anil Rao", "Rao Anil", 97.0), ("AnilRao", "Anil Rao", 98.0), ("anil rao", "Anil Rao", 100.0), ("", "x", 0.0), ("Anil Rao", "Anil Rai", 87.5)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select(name_similarity(F.col("a"), F.col("b")).alias("s"), "want").collect()
    assert [r.s.score for r in got] == [r.want for r in got]


def test_lcs_against_table():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    words = ["", "a", "banana", "ananas", "kumar", "kumari", "abcabcabc", "cbacba"]
    assert all(lcs_length(a, b) == plain(a, b) for a in words for b in words)
    assert indel("", "") == 100.0


def test_initials_against_the_rule(spark):
    """Every pair of names of up to three words, by the rule written out for lists."""
    words = ["A", "B", "AN", "AB", "BO"]
    names = [" ".join(n) for k in (1, 2, 3) for n in itertools.product(words, repeat=k)]

    def rule(a, b):
        left, free, short = sorted(a.split(), key=lambda w: -len(w)), b.split(), False
        if len(left) != len(free):
            return False
        for w in left:
            match = [i for i, f in enumerate(free) if f == w] or [i for i, f in enumerate(free) if (len(f) == 1 or len(w) == 1) and (f.startswith(w) or w.startswith(f))]
            if not match:
                return False
            short |= free[match[0]] != w
            free.pop(match[0])
        return short

    pairs = [(a, b) for a in names for b in names if len(a.split()) == len(b.split())][::7]
    got = spark.createDataFrame([*pairs, ("A B", "A B C")], "a string, b string").select("a", "b", initials_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.got == rule(r.a, r.b) for r in got)


def test_verdicts(spark):
    rows = [(["Match"], "Verified"), (["Not compared"], "Needs review"), (["Match", "Close match"], "Verified (minor differences)"), (["Missing", "Match"], "Needs review"), (["Mismatch", "Missing"], "Mismatch")]
    got = spark.createDataFrame(rows, "s array<string>, want string").select(overall(F.col("s")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_closest_keys(spark):
    keys = spark.createDataFrame([("1234",), ("1235",), ("99",), ("abc",)], "key string")
    found = closest_keys(spark.createDataFrame([("123X",), ("9",), ("zzz",), ("",)], "key string"), keys).collect()
    assert {(r.key, r.closest) for r in found} == {("123X", "1234"), ("9", "99")}


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
