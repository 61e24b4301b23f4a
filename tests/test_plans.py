"""How often a text is worked out in a plan, and what white space is."""

from pyspark.sql import functions as F

from rowproof.functions.dates import parse_date_any
from rowproof.functions.normalize import LINE_FORM, SPACE, WHITE, label_field, parse_cell, strip
from rowproof.functions.similarity import strict_similarity


def _analyzed(rows):
    return rows._jdf.queryExecution().analyzed().toString()


def test_texts_are_worked_out_once(spark):
    one = spark.sql("SELECT 'a' AS a, 'b' AS b")
    assert _analyzed(one.select(label_field(F.col("a")))).count("lower(") == 2  # in the plan and in the names of its columns
    assert _analyzed(one.select(parse_cell(F.col("a")))).count("lower(") == 2
    assert _analyzed(one.select(strict_similarity(F.col("a"), F.col("b")))).count("upper(") == 4
    assert _analyzed(one.select(parse_date_any(F.col("a")))).count("regexp_extract(") <= 10


def test_white_space_is_one_set(spark):
    chars = spark.createDataFrame([(chr(c),) for c in range(1, 0x3100)], "c string")
    of_class, trimmed = (chars.where(w).collect() for w in (F.regexp_like("c", F.lit(rf"\A[{SPACE}]\z")), strip(F.col("c")) == ""))
    assert {r.c for r in of_class} == {r.c for r in trimmed} == set(WHITE)


def test_label_before_long_blanks(spark):
    line = "x" * 55 + " " * 12 + ": y"
    assert [tuple(r) for r in spark.createDataFrame([(line,)], "c string").select(F.inline(parse_cell(F.col("c")))).collect()] == [("x" * 55, None, "y")]
    assert LINE_FORM.startswith(r"\A")


def test_words_of_runs_are_words_of_their_characters(spark):
    from rowproof.operators import layout as L

    runs = [("a", 1, 1, "ab  c ", 10.0, 100.0), ("a", 1, 2, " d", 90.0, 100.5), ("a", 1, 3, "ﬁx e", 10.0, 80.0), ("a", 2, 1, "z", 5.0, 9.0), ("b", 1, 1, "   ", 5.0, 50.0), ("b", 1, 2, "q r", 5.0, 20.0)]
    rows = spark.createDataFrame([(f, p, n, t, 0.0, 10.0, x, y, 6.0 * len(t), 0.0) for f, p, n, t, x, y in runs], "file string, page int, run_seq long, str string, t2 double, t3 double, x double, y double, width double, descent double")
    listed = lambda d: sorted(map(tuple, d.select(*L.PAGE, "line_no", "word_no", "text", "x0", "x1", "top", "bottom").collect()))
    assert listed(L.runs_to_words(rows)) == listed(L.chars_to_words(L.runs_to_chars(rows)))
