import pytest
from pyspark.sql import functions as F

from rowproof.operators.reconcile import reconcile, unmatched_rows
from rowproof.sources import history as H
from rowproof.sources import sheets as S
from rowproof.streaming import ingest as I

RECORDS = "rec_seq long, file string, page int, reg string, abc string, name string, father string, mother string, dob string"


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfreg,name\r\n1,"Rao, ""A"""\r\n\r\n2,"two\nlines"\r\n3\r\n')
    (tmp_path / "b.txt").write_bytes("x;y\n1;é \n".encode("latin-1"))
    (tmp_path / "c.tsv").write_bytes(b"x\ty\n1\t2\t3\n")
    (tmp_path / "d.csv").write_bytes(b"\n")
    (tmp_path / "f.csv").write_bytes(b"")
    (tmp_path / "e.doc").write_bytes(b"x,y")
    got = S.read_delimited(spark, str(tmp_path)).collect()
    grid = lambda n: {(r.row_no, r.col_no): r.value for r in got if r.source.endswith(n) and r.error is None}
    assert grid("a.csv") == {(1, 0): "reg", (1, 1): "name", (2, 0): "1", (2, 1): 'Rao, "A"', (3, 0): "2", (3, 1): "two\nlines", (4, 0): "3", (4, 1): ""}
    assert grid("b.txt")[2, 1] == "é"
    assert {r.source[-5:]: r.error for r in got if r.error} == {"c.tsv": "Expected 2 fields in line 2, saw 3", "d.csv": "Could not determine delimiter"}


def test_ingest_reads_each_file_once(spark, tmp_path):
    """Files that come between runs, a restart, a replayed batch, unreadable files, other suffixes."""
    folder, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("a.csv", b"x,y\n1,2\n"), put("b.csv", b"x,y\n1,2,3\n"), put("n.doc", b"x")
    run = lambda **more: I.ingest(spark, folder, out, log, **more).awaitTermination()
    run()
    put("deep/c.tsv", b"x\ty\n3\t4\n"), put("d.txt", b"\n"), put("e.csv", b"")
    run(files_a_batch=1)
    run()
    cells, failures = I.ingested(spark, out)
    got = sorted((r.source.rsplit("/", 1)[1], r.row_no, r.col_no, r.value) for r in cells.collect())
    assert got == [("a.csv", 1, 0, "x"), ("a.csv", 1, 1, "y"), ("a.csv", 2, 0, "1"), ("a.csv", 2, 1, "2"), ("c.tsv", 1, 0, "x"), ("c.tsv", 1, 1, "y"), ("c.tsv", 2, 0, "3"), ("c.tsv", 2, 1, "4")]
    assert {r.source.rsplit("/", 1)[1] for r in failures.collect()} == {"b.csv", "d.txt"}
    whole = S.read_delimited(spark, folder)
    assert sorted(cells.drop("batch").collect()) == sorted(whole.where("error is null").drop("error").collect())
    # the last commit of the checkpoint is lost: its batch runs again and replaces itself
    commits = sorted((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink()
    run()
    again = sorted((r.source.rsplit("/", 1)[1], r.row_no, r.col_no, r.value) for r in I.ingested(spark, out)[0].collect())
    assert again == got and I.ingested(spark, out)[1].count() == 2


def test_grids(spark):
    rows = [("b", "one", 0, 1, 0, "h"), ("b", "one", 0, 2, 0, "v"), ("b", "one", 0, 2, 3, " "), ("b", "one", 0, 3, 0, ""), ("b", "two", 1, 2, 0, "x"), ("b", "two", 1, 1, 1, None)]
    cells = spark.createDataFrame(rows, "source string, sheet string, sheet_order int, row_no int, col_no int, value string")
    trimmed = S.trim_grid(cells)
    assert {(r.sheet, r.row_no, r.col_no) for r in trimmed.collect()} == {("one", 1, 0), ("one", 2, 0), ("two", 2, 0)}
    assert {r.sheet for r in S.pick_sheet(trimmed).collect()} == {"one"} and {r.sheet for r in S.pick_sheet(cells, "two").collect()} == {"two"}
    assert {r.value for r in S.data_rows(trimmed, 1).collect()} == {"v", "x"}
    assert {(r.sheet, r.row_no): (r.a, r.b) for r in S.wide_rows(trimmed, {"a": 0, "b": 1}).collect()}["two", 2] == ("x", "")
    files = spark.createDataFrame([("x.PDF",), ("y.pdf",), ("z.txt",)], "path string")
    assert [r.path for r in S.ingest_unseen(files, files.where("path = 'y.pdf'")).collect()] == ["x.PDF"]


def test_history(spark, tmp_path, monkeypatch):
    records = spark.createDataFrame([(1, "a.pdf", 1, "11", None, "Asha", "F", "M", "01-02-2001"), (2, "b.pdf", 1, "99", None, "Ravi", None, None, None)], RECORDS)
    sheet = spark.createDataFrame([(2, "11", "", "Asha", "F", "M", "2001-02-01"), (3, "12", "", "No", "", "", "")], "row_no int, reg string, abc string, name string, father string, mother string, dob string")
    folder, results = str(tmp_path / "runs"), reconcile(records, sheet)
    for run in (1, 2):
        H.save_run(folder, run, {"created_at": "2024", "mapping": {"reg": 0}}, results, records, unmatched_rows(results, sheet))
    info, back, unmatched = H.load_run(spark, folder, 2)
    rows = {r.rec_seq: r for r in back.collect()}
    assert info["mapping"] == {"reg": 0} and (info["pdf_count"], info["n_verified"], info["n_notfound"]) == (2, 1, 1)
    assert rows[1].name.status == "Match" and rows[1].doc_fields["reg"] == "11" and rows[2].name is None and rows[2].doc_fields == {"reg": "99", "name": "Ravi"}
    assert [r.reg for r in unmatched.collect()] == ["12"]
    assert [r.run_id for r in H.lookup(spark, folder, " 1-1 ").collect()] == [2, 1] and H.lookup(spark, folder, " ").count() == 0
    H.delete_run(spark, folder, 2)
    assert [r.run_id for r in H.list_runs(spark, folder).select(F.col("run_id")).collect()] == [1]
    with pytest.raises(ValueError, match="no run"):
        H.load_run(spark, folder, 2)
    assert not (tmp_path / "runs" / "run_records" / "run_id=2").exists()

    def stop(*_):
        raise OSError("cut short")

    listed = lambda: [r.run_id for r in H.list_runs(spark, folder).collect()]
    save = lambda run: H.save_run(folder, run, {"mapping": {}}, results, records, unmatched_rows(results, sheet))
    for run in (1, 3):  # a save cut short, of a run that was there and of a new one
        with monkeypatch.context() as m, pytest.raises(OSError, match="cut short"):
            m.setattr(H, "_enter", stop)
            save(run)
    assert listed() == [] and H.history_for_key(spark, folder, "11").count() == 0 and (tmp_path / "runs" / "run_records" / "run_id=3").exists()
    save(3), save(1)
    assert listed() == [3, 1] and [r.run_id for r in H.history_for_key(spark, folder, "11").collect()] == [3, 1]
    drop = H._drop
    with monkeypatch.context() as m, pytest.raises(OSError, match="cut short"):  # a deletion cut short
        m.setattr(H, "_drop", lambda spark, path: stop() if "field_results" in path else drop(spark, path))
        H.delete_run(spark, folder, 3)
    assert listed() == [1] and [r.run_id for r in H.history_for_key(spark, folder, "11").collect()] == [1]
    H.delete_run(spark, folder, 3)
    assert not (tmp_path / "runs" / "field_results" / "run_id=3").exists() and H.load_run(spark, folder, 1)[0]["pdf_count"] == 2
