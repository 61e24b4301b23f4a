"""Column discovery on a small grid."""

from pyspark.sql import functions as F

from rowproof.operators import columns as D

GRID = [
    ["Report of the college", "", "", "", ""],
    ["Reg. No.", "Name of the Student", "Father_Name", "Date of admission", "DOB"],
    ["251612000001", "Asha Rao", "Mohan Rao", "2020-07-01", "1999-04-03"],
    ["251612000002", "Ravi Kumar", "Anil Kumar", "2020-07-02", "2000-12-30"],
    ["251612000002", "Ravi Kumar", "Anil Kumar", "", "2000-12-30"],
]


def cells(spark, grid):
    rows = [("f", "S", i + 1, j, v) for i, row in enumerate(grid) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "source string, sheet string, row_no int, col_no int, value string")


def test_header_scores(spark):
    heads = spark.createDataFrame([("Registration No.",), ("College Name",), ("Surname",), ("D.O.B",), ("Issue date",), (None,)], "h string")
    got = heads.select(*[D.header_score(f, F.col("h")).alias(f) for f in ("reg", "name", "name_last", "dob")]).collect()
    assert [tuple(r) for r in got] == [(1.0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1.0, 0), (0, 0, 0, 1.0), (0, 0, 0, 0), (0, 0, 0, 0)]
    roles = spark.createDataFrame([("Expected data",), ("Wrong, expected",), ("Remarks",)], "h string")
    assert [tuple(r) for r in roles.select(*[D.role_score(x, F.col("h")) for x in ("expected", "claimed", "remark")]).collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_header_rows(spark):
    assert [r["header_row"] for r in D.detect_header_row(cells(spark, GRID)).collect()] == [2]
    assert [r["header_row"] for r in D.detect_header_row(cells(spark, [["a", "b"], ["1", "2"]])).collect()] == [-1]
    roles = [["x", ""], ["Enrolment no", "Remarks"]]
    assert [r["header_row"] for r in D.detect_role_header_row(cells(spark, roles)).collect()] == [2]
    assert [r["header_row"] for r in D.detect_role_header_row(cells(spark, roles[:1])).collect()] == [-1]


def test_columns_are_given_out(spark):
    grid = cells(spark, GRID)
    records = spark.createDataFrame([("251612000001", None, "Asha Rao", "Mohan Rao", None, "03-04-1999"), ("9", None, "X", None, None, None)], "reg string, abc string, name string, father string, mother string, dob string")
    headers = D.detect_header_row(grid)
    scores = D.column_scores(grid, headers, records)
    got = {r["field"]: (r["col"], r["confidence"]) for r in D.assign_columns(scores).collect()}
    assert got == {"reg": (0, "high"), "name": (1, "high"), "father": (2, "high"), "dob": (4, "high"), "mother": (None, "none"), "abc": (None, "none"), "name_last": (None, "none")}
    reason = scores.where("field = 'reg' and col_no = 0").first()["reason"]
    assert reason == 'header "Reg. No.", 1 of 2 PDF reg. numbers found'
    fixed = {r["field"]: (r["col"], r["confidence"]) for r in D.assign_columns(scores, {"dob": 3}).collect()}
    assert fixed["dob"] == (3, "manual")
    shape = D.profile_columns(grid, headers).where("col_no = 0").first()
    assert (shape["n"], shape["id_like"], round(shape["uniq"], 3), shape["date_like"]) == (3, 1.0, 0.667, 0.0)
