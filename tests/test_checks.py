from pyspark.sql import functions as F

from rowproof.operators import checks as K
from rowproof.operators import columns as D
from rowproof.operators import report as A

SHEET = "row_no int, enroll string, abc string, student string, expected string, claimed string, remark string"
RECORDS = "rec_seq long, file string, reg string, abc string, name string, father string, mother string, dob string"


def _tables(spark):
    sheet = [
        (2, "111", None, "A", "Student Name : Asha Rao\nDate of Birth : 01-02-2001", "", ""),
        (3, "111", None, "A", "Student Name : Asha Roy", "Name : Asha Rao", ""),
        (4, "", "999", "B", "Ravi Sen", "", "father name wrong"),
        (5, "112", None, "C", "Mother's Name : Mira", "", ""),
        (6, "222", "999", "B", "Total marks 40", "", ""),
        (7, "222", None, "B", "Aadhaar No : 5", "", ""),
        (8, "222", None, "B", "Mother's Name :", "", None),
        (9, "222", None, "B", "", "", ""),
        (10, " ", None, "", None, "x", ""),
        (11, "222", None, "B", "Mother's Name : Mira", "", ""),
    ]
    records = [
        (1, "a.pdf", "111", None, "Asha Rao", None, None, "01/02/2001"),
        (2, "b.pdf", "222", "999", "Bina Sen", None, None, None),
        (3, "c.pdf", "222", "999", None, "Ravi Sen", None, None),
    ]
    return spark.createDataFrame(sheet, SHEET), spark.createDataFrame(records, RECORDS)


def test_build_checks(spark):
    got = {(r.row_no, r.nth): (r.kind, r.field) for r in K.build_checks(_tables(spark)[0]).collect()}
    assert got == {
        (2, 0): ("field", "name"), (2, 1): ("field", "dob"), (3, 0): ("field", "name"), (4, 0): ("field", "father"), (5, 0): ("field", "mother"),
        (6, 0): ("marks", None), (7, 0): ("unsupported", None), (8, 0): ("empty", "mother"), (9, 0): ("empty", None), (11, 0): ("field", "mother"),
    }


def test_every_status(spark):
    sheet, records = _tables(spark)
    done = K.run_checks(sheet, records).cache()
    got = {(r.row_no, r.nth): r for r in done.collect()}
    want = {(2, 0): "Correct", (2, 1): "Correct", (3, 0): "Still wrong (same as old value)", (4, 0): "Correct", (5, 0): "PDF not found", (6, 0): "Marks row (not checked)", (7, 0): "Not checked", (8, 0): "Not checked", (9, 0): "Not checked", (11, 0): "Field not in PDF"}
    assert {k: r.status for k, r in got.items()} == want
    assert got[2, 0].note == "Exact; Same student and field also on row(s) 3"
    assert got[5, 0].note == "No uploaded PDF has this enrollment number. Closest PDF: a.pdf (111)"
    assert got[4, 0].pdf_file == "c.pdf" and "matched by ABC ID" in got[4, 0].note
    assert {r.row_no for r in A.check_needs_attention(done).collect()} == {3, 5, 11}
    assert sum(r.n for r in A.check_counts(done).collect()) == len(want)


def test_overrides(spark):
    sheet, _ = _tables(spark)
    laid = spark.createDataFrame([(5, 0, None, None, "a.pdf", "Mira "), (7, 0, "name", " Bina", None, None)], "row_no int, nth int, field string, expected string, force_pdf_path string, force_pdf_value string")
    got = {r.row_no: r for r in K.apply_check_overrides(K.build_checks(sheet), laid).where("row_no in (5, 7, 9)").collect()}
    assert got[5].manual == ["PDF set to a.pdf", 'PDF value set to "Mira"'] and got[5].force_pdf_value == "Mira"
    assert (got[7].kind, got[7].expected, got[7].manual) == ("field", "Bina", ["field set to Student Name", 'expected set to "Bina"'])
    assert got[9].manual == []


def test_corrections_and_removal(spark):
    records = _tables(spark)[1].withColumn("path", F.col("file")).withColumn("page", F.lit(1))
    new = spark.createDataFrame([("b.pdf", 1, "222", "", " Bina Rao ", None, None, None)], "path string, page int, reg string, abc string, name string, father string, mother string, dob string")
    got = {r.rec_seq: r for r in K.apply_record_corrections(records, new).collect()}
    assert (got[2].name, got[2].abc, got[2].source) == ("Bina Rao", None, "manual") and got[1].source == "text"
    assert {r.rec_seq for r in K.remove_records(records, records.where("rec_seq = 2")).collect()} == {1, 3}


def test_short_status(spark):
    rows = [("Close match", 92.5, "Close match 92%"), ("Match", 100.0, "Match"), ("Not compared", None, "-"), ("Missing", None, "Missing")]
    got = spark.createDataFrame(rows, "s string, n double, want string").select(A.short_status("name", F.col("s"), F.col("n")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_rows_of_a_hot_key(spark):
    """Rows of one key lie in several chunks; a note lists them all in order, and nothing is listed
    where notes are not asked for."""
    sheet = spark.range(2600).selectExpr("cast(id * 2 + 2 as int) as row_no", "'111' as enroll", "'Student Name : A' || chr(10) || 'Name : B' as expected")
    checks = K.mark_duplicates(K.build_checks(sheet))
    note = checks.where("row_no = 3000 and nth = 1").first()["parse_note"]
    rows = [2 * i + 2 for i in range(2600) for nth in (0, 1) if (2 * i + 2, nth) != (3000, 1)]
    assert note == "Same student and field also on row(s) " + ", ".join(map(str, rows))
    plan = checks.select("row_no", "kind")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_notes_of_a_hot_key_are_dealt(spark):
    """The notes of one key are put together in many partitions, and name each of the others once, in order,
    with or without a number of their own."""
    sheet = spark.range(400).selectExpr("cast(if(id = 7, null, id * 700) as int) as row_no", "'' as enroll", "'Name : B' as expected")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = K.mark_duplicates(K.build_checks(sheet)).select("row_no", "parse_note", F.spark_partition_id().alias("part")).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    every = [i * 700 for i in range(400) if i != 7]
    want = {n: "Same student and field also on row(s) " + ", ".join(str(m) for m in every if m != n) for n in (None, *every)}
    assert {r.row_no: r.parse_note for r in got} == want and len(got) == 400
    assert len({r.part for r in got}) == spark.sparkContext.defaultParallelism


def test_notes_are_cut_from_one_text(spark):
    """A note takes one join, whatever repeats, and leaves out its own check alone: another one of the same number stays."""
    sheet = spark.createDataFrame([(2, "111", "Name : A"), (2, "111", "Name : B"), (1500, "111", "Name : C"), (99999, "111", "Name : D"), (7, "222", "Name : E")], "row_no int, enroll string, expected string")
    found = K.mark_duplicates(K.build_checks(sheet)).select("expected", "parse_note")
    said = "Same student and field also on row(s) "
    assert dict(map(tuple, found.collect())) == {"A": said + "2, 1500, 99999", "B": said + "2, 1500, 99999", "C": said + "2, 2, 99999", "D": said + "2, 2, 1500", "E": ""}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_checks_from_cells(spark):
    """Header, last row and roles are data: two sheets at once, and one without expected values."""
    grids = {
        "A": [["List"], ["Enrolment no", "Expected data", "Remarks"], ["111", "Student Name : Asha Rao", ""], ["", "", "blank"], ["222", "Ravi Sen", "father name"], ["333", "Name : X", ""]],
        "B": [["Expected", "Enrolment no", "Wrong value"], ["Father's Name : Ravi Sen", "222", "Ravi"]],
        "C": [["Enrolment no", "Remarks"], ["111", "x"]],
    }
    cells = spark.createDataFrame([("f", s, i + 1, j, v) for s, g in grids.items() for i, row in enumerate(g) for j, v in enumerate(row)], "source string, sheet string, row_no int, col_no int, value string")
    headers, records = D.detect_role_header_row(cells), _tables(spark)[1]
    last = spark.createDataFrame([("f", "A", 5), ("f", "B", 0)], "source string, sheet string, last_row int")
    rows, errors = K.check_sheet(cells, headers, D.detect_check_columns(cells, headers, records), last)
    got = {(r.sheet, r.row_no): (r.status, r.field, r.claimed) for r in K.run_checks(rows, records).collect()}
    assert got == {("A", 3): ("Correct", "name", ""), ("A", 5): ("Correct", "father", ""), ("B", 2): ("Correct", "father", "Ravi")}
    assert [tuple(r) for r in errors.collect()] == [("f", "C", K.NOT_CHOSEN)]
