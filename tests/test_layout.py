"""Text runs to records, typed cells, stacked sheets and report tables on small inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from rowproof.functions import cells as X
from rowproof.functions import normalize as N
from rowproof.operators import columns as D
from rowproof.operators import layout as L
from rowproof.operators import report as A
from rowproof.operators.compare import Settings
from rowproof.operators.reconcile import reconcile, unmatched_rows
from rowproof.sources import sheets as S

RUNS = "file string, page int, run_seq int, str string, t2 double, t3 double, x double, y double, width double, descent double"


def _runs(spark, rows):
    """(file, page, x, y, text) as runs of 6 points a character."""
    return spark.createDataFrame([(f, p, i, t, 0.0, 10.0, float(x), float(y), 6.0 * len(t), -0.2) for i, (f, p, x, y, t) in enumerate(rows)], RUNS)


def test_chars_and_words(spark):
    runs = _runs(spark, [("a", 1, 100, 50, "second"), ("a", 1, 0, 51, "on ﬁrst"), ("a", 1, 0, 20, "x"), ("a", 1, 7, 20, "y"), ("a", 1, 0, 100, "")])
    chars = L.runs_to_chars(runs).where("run_seq = 0 and pos = 1").first()
    assert (chars.ch, chars.x0, chars.x1, chars.top, chars.bottom) == ("e", 106.0, 112.0, -58.0, -48.0)
    words = [(r.line_no, r.text) for r in L.chars_to_words(L.runs_to_chars(runs)).orderBy("line_no", "word_no").collect()]
    assert words == [(1, "on"), (1, "first"), (1, "second"), (2, "xy")]


def test_segments_and_fields(spark):
    # the second line of the right column runs into the left value; colons stand alone
    runs = _runs(spark, [
        ("a", 1, 0, 100, "Name : Asha Rao"), ("a", 1, 300, 100, "Mother's Name : Mira"), ("a", 1, 0, 80, "Father's Name : A B"), ("a", 1, 300, 80, "Date of Birth"), ("a", 1, 420, 80, ": 03 Feb 2001"),
        ("a", 1, 192, 60, "ABC ID : 123456789012"), ("a", 1, 0, 60, "Registration No. : 12X/ab-2345 xx"), ("a", 1, 0, 40, "Reg. No. : n/a"), ("a", 1, 0, 20, "Enrolment number 99998888"),
        ("b", 1, 0, 50, "nothing to see"), ("c", 2, 0, 50, "abc id 1234 5678 9012, d.o.b. 1/2/2001"),
    ])
    segments = L.words_to_segments(L.chars_to_words(L.runs_to_chars(runs)))
    lines = {}
    for r in segments.where("file = 'a'").orderBy("line_no", "seg_no").collect():
        lines.setdefault(r.line_no, []).append(r.text)
    assert lines[1] == ["Father's Name : A B", "Date of Birth : 03 Feb 2001"] and lines[0] == ["Name : Asha Rao", "Mother's Name : Mira"]
    short = L.run_lines(runs).select("file", "page", F.posexplode("lines").alias("line_no", "line")).select("file", "page", "line_no", F.posexplode("line").alias("seg_no", "text"))
    assert sorted(short.collect()) == sorted(segments.collect())
    files = spark.createDataFrame([(f, f"/{f}", 2) for f in "abc"], "file string, path string, pages int")
    got = {r.file: r for r in L.read_pages(runs, files).collect()}
    a = got["a"]
    assert (a.name, a.mother, a.father, a.dob) == ("Asha Rao", "Mira", "A B", "03 Feb 2001")
    assert got["b"].unreadable and got["b"].note == L.UNREADABLE and got["b"].name is None
    assert (got["c"].page, got["c"].abc, got["c"].dob, got["c"].reg) == (2, "123456789012", "1/2/2001", None)


def test_runs_straight_to_lines(spark, monkeypatch):
    """Both ways give the same lines: ligatures, blanks of every kind, overprinting, sizes from
    either side of the matrix, missing numbers, empty and unplaced runs, several batches."""
    rng = random.Random(4)
    rows = []
    for n in range(900):
        text = "".join(rng.choice(["a", "B", "ﬁ", " ", "\u00a0", "\x1c", ":", "：", "é", "😀", "7"]) for _ in range(rng.choice([0, 1, 4, 12])))
        t2, t3 = rng.choice([(0.0, 10.0), (0.0, -8.0), (3.0, 4.0), (0.0, 0.0), (None, 9.0), (1.0, None)])
        x, y = rng.choice([None, *[rng.choice([0, 30, 200, 203, rng.uniform(0, 400)])] * 20]), float(rng.choice([0, 10, 11, 12.5, 30, 33]))
        rows.append((f"f{n % 7}", n % 5, n, text, t2, t3, x if x is None else float(x), y, rng.choice([None, 6.0 * len(text), 3.0]), rng.choice([None, -0.2, 0.0])))
    runs = spark.createDataFrame(rows, RUNS)
    monkeypatch.setattr(L, "MANY", 200)
    short = {(r.file, r.page): r.lines for r in L.run_lines(runs).collect()}
    long = {(r.file, r.page): r.lines for r in L.page_lines(L.chars_to_words(L.runs_to_chars(runs))).collect()}
    assert sum(map(len, long.values())) > 100 and {k: v for k, v in short.items() if v} == {k: v for k, v in long.items() if v}
    assert L.run_lines(runs.where("false")).count() == 0


def _laid(*pages, scale=1.0):
    """Segments of pages of (text, x0, top) words, 6 points a character and 10 high."""
    flat = [(i, j, t, x, top) for i, page in enumerate(pages) for j, (t, x, top) in enumerate(page)]
    numbers = lambda f: np.array([f(w) for w in flat], float)
    words = {"text": np.array([w[2] for w in flat], object), "x0": numbers(lambda w: w[3]), "x1": numbers(lambda w: w[3] + 6 * len(w[2])), "top": numbers(lambda w: w[4]), "bottom": numbers(lambda w: w[4] + 10)}
    words |= {"line_no": np.zeros(len(flat), int), "word_no": np.array([w[1] for w in flat], int)}
    return L.lay_out(np.array([w[0] for w in flat], int), words, len(pages), scale).to_pylist()


def _line(top, *words):
    return [(t, x, top) for t, x in words]


def test_column_of_labels_is_split():
    two = _line(0, ("Name", 0), (":", 30), ("A", 42), ("DOB", 200), (":", 224), ("1", 236)) + _line(20, ("Id", 0), (":", 18), ("2", 30), ("ABC", 200), (":", 224), ("3", 236))
    long = _line(40, ("Place", 0), (":", 36), ("long", 48), ("value", 156), ("Roll", 192 + 8), (":", 226), ("7", 238))
    near = _line(40, ("Place", 0), (":", 36), ("long", 160), ("Roll", 202), (":", 226), ("7", 238))
    off = _line(40, ("Place", 0), (":", 36), ("long", 160), ("Roll", 206), (":", 226), ("7", 238))
    plain = _line(40, ("Place", 0), (":", 36), ("long", 160), ("rolls", 199))
    got = _laid(two, two + long, two + near, two + off, two + plain, [])
    assert got[0] == [["Name : A", "DOB : 1"], ["Id : 2", "ABC : 3"]] and got[5] == []
    assert got[1][2] == ["Place : long", "value", "Roll : 7"]  # gaps and the column's place
    assert got[2][2] == ["Place : long", "Roll : 7"]  # no gap before the label: the place alone parts
    assert got[3][2] == ["Place : long Roll : 7"]  # too far from the place
    assert got[4][2] == ["Place : long rolls"]  # what follows is no label
    assert _laid(two[:6] + near) == [[["Name : A", "DOB : 1"], ["Place : long Roll : 7"]]]  # one line makes no column


def test_lines_and_colons():
    """Words join the highest line that is near enough; equal tops of other pages stay apart."""
    steps = [("a", 0, 0.0), ("b", 10, 3.0), ("c", 20, 3.5), ("d", 30, 6.9), ("e", 40, 7.0), ("f", 50, 10.5)]
    assert _laid(steps, [("z", 0, 3.0)]) == [[["a b"], ["c d"], ["e"], ["f"]], [["z"]]]
    assert _laid(_line(0, ("Name", 0), (":", 100), ("A", 200), ("x", 300)), _line(0, ("：b", 0))) == [[["Name : A", "x"]], [["：b"]]]
    assert _laid(_line(0, ("a", 0), (" ", 50), ("b", 60)), scale=4.0) == [[["a b"]]]
    assert _laid() == [] and _laid([], []) == [[], []]


def test_typed_cells(spark):
    rows = [
        (0.5, False, False, "12:00:00"), (59.0, False, False, "1900-02-28"), (60.0, False, False, "1900-02-28"), (61.25, False, False, "1900-03-01 06:00:00"), (1.0, True, False, "1904-01-02"),
        (1.5, False, True, "1 day, 12:00:00"), (0.25, False, True, "6:00:00"), (3e6, False, False, "#VALUE!"), (44197.000005787, False, False, "2021-01-01"), (44197.5000115741, False, False, "2021-01-01 12:00:01"), (-0.5, False, True, "-1 day, 12:00:00"),
    ]
    got = spark.createDataFrame(rows, "v double, d boolean, t boolean, want string").select(X.serial_date_text(F.col("v"), F.col("d"), F.col("t")).alias("got"), "want", "v").collect()
    assert all(r.got == r.want for r in got), got
    cells = [("n", 12.0, "", None, "12"), ("n", 0.1 + 0.2, "", "General", "0.3"), ("n", 1e-7, "", "0.00", "1e-07"), ("b", 1.0, "", None, "True"), ("s", None, " x ", None, "x"), ("e", None, "#N/A", None, "#N/A"), ("n", None, "", "dd/mm/yy", ""), ("n", 44197.0, "", "dd/mm/yy", "2021-01-01"), ("n", 2.0, "", '"mm" 0', "2"), ("n", 1.5, "", "[hh]:mm", "1 day, 12:00:00")]
    got = spark.createDataFrame(cells, "k string, v double, w string, f string, want string").select(X.cell_text(F.col("k"), F.col("v"), F.col("w"), F.col("f"), F.lit(False)).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def _stacked(spark, grids):
    rows = [("f", n, k, i + 1, j, v) for k, (n, g) in enumerate(grids.items()) for i, row in enumerate(g) for j, v in enumerate(row)]
    cells = spark.createDataFrame(rows, "source string, sheet string, sheet_order int, row_no int, col_no int, value string")
    return S.combine_sheets(cells, D.detect_header_row(cells))


def test_sheets_are_stacked(spark):
    body, sheets = _stacked(spark, {"one": [["Reg. No.", "Name", "Name", ""], ["1", "A", "B", "x"], ["", "", "", ""]], "two": [["title", ""], ["NAME", "reg. no."], ["C", "2"]], "three": [["no", "header"]]})
    got = {(r.sheet, r.row_no, r.title): r.value for r in body.collect()}
    assert got == {("one", 2, "Reg. No."): "1", ("one", 2, "Name"): "A", ("one", 2, "Name (2)"): "B", ("one", 2, "Sheet"): "one", ("two", 3, "Reg. No."): "2", ("two", 3, "Name"): "C", ("two", 3, "Sheet"): "two"}
    assert {(r.sheet, r.combined, r.rows) for r in sheets.collect()} == {("one", True, 1), ("two", True, 1), ("three", False, 0)}
    assert [tuple(r) for r in S.combined_note(sheets).collect()] == [("f", "Combined 2 sheet(s), 2 rows. Skipped (no header row found): three", None)]


def test_titles_that_end_in_numbers(spark):
    """A number that another column has already is passed over; later sheets join by what became
    of a title."""
    titles = ["Name (2)", "Name", "NAME", "Reg. No.", "name ", "Name (2)"]
    body, sheets = _stacked(spark, {"one": [titles, list("abcdef")], "two": [["Reg no", "Name", "Name"], ["1", "g", "h"]]})
    got = {(r.sheet, r.col_no, r.title): r.value for r in body.collect()}
    first = {("one", 0, "Name (2)"): "a", ("one", 1, "Name"): "b", ("one", 2, "NAME (3)"): "c", ("one", 3, "Reg. No."): "d", ("one", 4, "name (4)"): "e", ("one", 5, "Name (2) (2)"): "f", ("one", 7, "Sheet"): "one"}
    assert got == first | {("two", 6, "Reg no"): "1", ("two", 1, "Name"): "g", ("two", 0, "Name (2)"): "h", ("two", 7, "Sheet"): "two"}
    none = _stacked(spark, {"one": [["no", "header"], ["1", "2"]]})
    assert none[0].count() == 0 and [tuple(r) for r in S.combined_note(none[1]).collect()] == [("f", None, S.NOTHING_STACKED)]


def test_number_text_is_exact(spark):
    """Against Python's own: halves, limits of 15 digits, long whole numbers, both signs."""
    rng = random.Random(3)
    values = [1e18, 1e22, 2.0**70, 1.7976931348623157e308, 1e-7, 0.1 + 0.2, 0.0, -0.0, -3.0, 1 / 3, 123456789012345.5, 123456789012344.5, 1234567890123456.5, 999999999999999.5, 9.999999999999995, 0.0001, 0.00001, -0.1, float("inf"), -float("inf"), float("nan"), -1e19, 3e-300]
    for _ in range(150):
        values += [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-20, 16), (rng.randrange(10**15, 10**16) // 10 * 10 + 5) / 10 ** rng.randint(1, 22), rng.randrange(1 << 52) / 2 ** rng.randint(1, 8)]
    want = lambda v: "" if v != v else str(int(v)) if abs(v) != float("inf") and v == int(v) else format(v, ".15g")
    made = spark.createDataFrame([(v, want(v)) for v in values], "v double, want string").select("v", "want", X.number_text(F.col("v")).alias("got"))
    assert all(r.got == r.want for r in made.collect())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_keys_of_any_exponent(spark):
    rows = [("1E+500", "1" + "0" * 500), ("2.516E+11", "251600000000"), ("123.0", "123"), ("0E+7", "0"), ("9.99E+1", "99"), ("1E+99999999999", "1E99999999999"), (" 25-16/12 ", "251612"), ("\u0663E+2", "300"), ("0012e+2", "1200")]
    got = spark.createDataFrame(rows, "k string, want string").select("want", N.norm_key(F.col("k")).alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_mapping_notes_and_tables(spark, tmp_path):
    records = [(1, "a.pdf", 1, "11", None, "Asha Rao", "F", None, "01-02-2001", ""), (2, "b.pdf", 1, "1X", None, "Ravi", None, None, None, ""), (3, "c.pdf", 1, None, None, None, None, None, None, "scanned"), (4, "d.pdf", 1, "12", None, "Mira Sen", "G", None, "03-02-2001", "")]
    records = spark.createDataFrame(records, "rec_seq long, file string, page int, reg string, abc string, name string, father string, mother string, dob string, note string")
    sheet = spark.createDataFrame([(2, "S", "11", "Asha", "Rao", "F", "2001-02-01"), (3, "S", "11", "x", "", "", ""), (3, "T", "12", "Mira Sen", "", "G", "2001-02-03")], "row_no int, sheet string, key string, first string, last string, father string, dob string")
    mapping = {"reg": "key", "name": "first", "name_last": "last", "father": "father", "dob": "dob"}
    results = reconcile(records, sheet, mapping=mapping)
    got = {r.rec_seq: r for r in results.collect()}
    assert (got[1].verdict, got[1].excel_row, got[1].name.sheet, got[1].mother.note) == ("Verified", "S!2", "Asha Rao", "Column not mapped")
    assert got[1].note == "Reg. no. appears in Excel at sheet S row 2, sheet S row 3; first used"
    assert got[2].note == "Registration number not found in Excel. Closest in Excel: 11 (sheet S row 2)" and got[2].name.doc == "Ravi"
    assert (got[3].verdict, got[3].note) == ("No reg. no. in PDF", "scanned")
    rows = {(r.rec_seq, r.field): r.status for r in A.needs_attention(results, records).collect()}
    assert rows == {(1, "Record"): "Verified", (2, "Registration no."): "Not in Excel", (3, "Registration no."): "No reg. no. in PDF"}
    left = unmatched_rows(results, sheet, mapping)
    assert [r.excel_row for r in left.collect()] == ["S!3"]
    A.write_report_tables(str(tmp_path), A.run_tables(results, records, left, {"excel_file": "b"}, Settings(), mapping))
    assert spark.read.parquet(f"{tmp_path}/summary").where("verdict = 'Total records'").first()["n"] == 4
    assert [r.nth for r in spark.read.parquet(f"{tmp_path}/comparison").orderBy("rec_seq").collect()] == [1, 2, 3, 4]
    assert {r.field: r.column for r in spark.read.parquet(f"{tmp_path}/mapping").collect()}["Mother's Name"] == "Not mapped"
    assert Settings().with_threshold(match_threshold=60.0).review_threshold == 60.0 and Settings().with_threshold(review_threshold=95.0).match_threshold == 95.0
    assert {r.rec_seq for r in A.filter_results(results, "Verified").collect()} == {1, 4}
