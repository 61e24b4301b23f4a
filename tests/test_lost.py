"""Notes of checks whose record is not found."""

from rowproof.operators import checks as K


def test_lost_notes_meet_no_list_of_rows(spark):
    sheet = spark.createDataFrame([(2, "1234", "Student Name : A", ""), (3, "123X", "Student Name : A", ""), (4, "", "Student Name : A", "77"), (5, "", "Student Name : A", "")], "row_no int, enroll string, expected string, abc string")
    records = spark.createDataFrame([(1, "a.pdf", "1234", None), (2, "b.pdf", None, "77")], "rec_seq long, file string, reg string, abc string")
    found = K.lost_notes(K.build_checks(sheet), records)
    assert sorted((r.row_no, r.status, r.note) for r in found.collect()) == [
        (3, "PDF not found", "No uploaded PDF has this enrollment number. Closest PDF: a.pdf (1234)"), (5, "PDF not found", "No enrollment number on this row"),
    ]
    assert "texts" not in found._jdf.queryExecution().optimizedPlan().toString()
