"""Columns of a sheet of expected values."""

from rowproof.operators import columns as D


def test_cells_are_read_twice_alone(spark, monkeypatch):
    kept, put = [], D.written
    monkeypatch.setattr(D, "written", lambda rows: kept.append(rows) or put(rows))
    grid = [["Enrolment no", "", "x"], ["12345-6", "Student Name：A", ""], ["٤٥٦", "plain", "no : field"], ["", "Father : B\nC", "7"]]
    cells = spark.createDataFrame([("f", "S", i + 1, j, v) for i, row in enumerate(grid) for j, v in enumerate(row)], "source string, sheet string, row_no int, col_no int, value string")
    headers = spark.createDataFrame([("f", "S", 1)], "source string, sheet string, header_row int")
    records = spark.createDataFrame([("123456",), ("9",), (None,)], "reg string")
    got = {r.role: (r.col, round(r.score, 4), r.reason) for r in D.detect_check_columns(cells, headers, records).collect()}
    assert got["enroll"] == (0, 0.94, 'header "Enrolment no", 1 PDF reg. numbers found')
    assert kept[1]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4
    facts = {r.col_no: (r.header, round(r.id_like, 3), round(r.labelled, 3), r.hits) for r in kept[1].collect()}
    assert facts == {0: ("Enrolment no", 0.5, 0.0, 1), 1: ("", 0.0, 0.667, 0), 2: ("x", 0.0, 0.0, 0)}
    assert D.detect_check_columns(cells, headers, records.where("false")).where("role = 'enroll'").first().col == 0
