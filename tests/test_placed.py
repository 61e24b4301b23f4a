"""Results that are saved by several runs."""

from rowproof.operators.reconcile import reconcile, unmatched_rows
from rowproof.sources import history as H
from rowproof.sources.scratch import written


def test_placed_results_are_saved_without_a_join(spark, tmp_path, monkeypatch):
    records = spark.createDataFrame([(1, "a.pdf", 1, "11", "A"), (2, "b.pdf", 2, None, "B")], "rec_seq long, file string, page int, reg string, name string")
    records = records.selectExpr("*", "string(null) abc", "string(null) father", "string(null) mother", "string(null) dob")
    sheet = spark.createDataFrame([(2, "11", "A"), (3, "12", "C")], "row_no int, reg string, name string")
    results, folder = reconcile(records, sheet), str(tmp_path)
    left = unmatched_rows(results, sheet)
    H.save_run(folder, 1, {}, results, records, left)
    results = written(H.placed(results, records))
    monkeypatch.setattr(H, "written", None)  # neither joined nor written once more
    H.save_run(folder, 2, {}, results, None, left)
    rows = lambda table, run: sorted(map(tuple, spark.read.parquet(f"{folder}/{table}/run_id={run}").collect()), key=str)
    for table in H.TABLES:
        assert rows(table, 1) == rows(table, 2) != []
