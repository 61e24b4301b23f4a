"""The list of checks as a report shows it."""

from pyspark.sql import functions as F
from test_checks import _tables as tables

import __spark_entry__ as entry
from rowproof.operators import checks as K
from rowproof.operators import report as A

COLUMNS = ["nth", "row_no", "line", "enroll", "student", "field", "expected", "claimed", "pdf_value", "status", "score", "pdf_file", "pdf_page", "note", "remark", "manual"]


def test_query_lists_values_places_and_notes(spark):
    found = entry.queries()["check_results"](spark, "/root/testdata/sf0.001")
    assert found.columns == COLUMNS
    rows = found.collect()
    met = [r for r in rows if r.status in ("Correct", "Mismatch", "Still wrong (same as old value)")]
    assert met and all(r.pdf_value and r.pdf_file and r.pdf_page == 1 and r.score is not None for r in met) and all(r.note for r in rows)
    bare = [r for r in met if r.enroll == ""]
    said = {r.row_no: r.note.split("Same student and field also on row(s) ")[1].split(", ") for r in bare}
    assert len(bare) > 1 and all("matched by ABC ID" in r.note for r in bare)
    assert all(set(rows) == {str(n) for n in said} - {str(own)} for own, rows in said.items())


def test_numbers_and_overrides(spark):
    """Numbers are those of all checks, in order; a check that was changed by hand still names its duplicates."""
    sheet, records = tables(spark)
    laid = spark.createDataFrame([(3, 0, "father", None, "b.pdf", "Asha Roy")], "row_no int, nth int, field string, expected string, force_pdf_path string, force_pdf_value string")
    done = K.run_checks(sheet, records, overrides=laid).cache()
    rows = A.check_results(done).orderBy("nth").collect()
    assert [r.nth for r in rows] == list(range(1, 11)) and [(r.row_no, r.line) for r in rows] == sorted((r.row_no, r.line) for r in rows)
    third = rows[2]
    assert (third.row_no, third.field, third.status, third.pdf_file, third.manual) == (3, "Father's Name", "Correct", "b.pdf", 'field set to Father\'s Name; PDF set to b.pdf; PDF value set to "Asha Roy"')
    assert third.note == "Exact; chosen by hand; Same student and field also on row(s) 2"
    assert [r.nth for r in A.check_needs_attention(done).orderBy("nth").collect()] == [r.nth for r in rows if r.row_no in (5, 11)]


def test_what_asks_for_no_record_is_dealt(spark):
    """Checks that need no record are half of a sheet or more; none of the joins brings them together."""
    sheet = spark.range(400).selectExpr("cast(id as int) as row_no", "'1' as enroll", "'Total marks 40' as expected")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = K.run_statuses(sheet, tables(spark)[1]).select("status", F.spark_partition_id().alias("part")).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert {r.status for r in got} == {"Marks row (not checked)"} and len(got) == 400
    assert len({r.part for r in got}) == spark.sparkContext.defaultParallelism
