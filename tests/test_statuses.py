"""Statuses of checks without their notes."""

from test_checks import _tables as tables

from rowproof.operators import checks as K


def test_statuses_meet_records_alone(spark):
    sheet, records = tables(spark)
    key = lambda rows: sorted(map(tuple, rows.select("row_no", "nth", "status").collect()))
    found = K.run_statuses(sheet, records)
    assert key(found) == key(K.run_checks(sheet, records))
    plan = found.select("row_no", "nth", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2
