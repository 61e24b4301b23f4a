"""Agreement of columns with paired records."""

from pyspark.sql import functions as F

from rowproof.operators import columns as D


def test_pairs_do_not_grow_with_the_sheet(spark, monkeypatch):
    kept, put = [], D.written
    monkeypatch.setattr(D, "written", lambda rows: kept.append(put(rows)) or kept[-1])
    rows = spark.range(2, 202).select(F.lit("f").alias("source"), F.lit("S").alias("sheet"), F.col("id").cast("int").alias("row_no"), (251612000000 + F.col("id")).cast("string").alias("reg"))
    cells = rows.select("source", "sheet", "row_no", F.posexplode(F.array("reg", F.lit("Asha Rao"), F.lit("RAO, A."), F.lit("1999-04-03"))).alias("col_no", "value"))
    none = F.lit(None).cast("string")
    records = rows.select("reg", none.alias("abc"), F.lit("Mr. asha rao").alias("name"), F.lit("123").alias("father"), none.alias("mother"), F.lit("03-04-1999").alias("dob"))
    headers, keys = (rows.select("source", "sheet").distinct().withColumn(c, F.lit(v)) for c, v in (("header_row", 1), ("reg_col", 0)))
    found = {(r.col_no, r.field): (r.hits, r.told) for r in D.pair_agreement(cells, headers, records, keys).collect()}
    # names without letters agree with values without letters, initials with the words that they stand for
    right = {(1, "name"), (2, "name"), (0, "father"), (3, "father"), (3, "dob")}
    assert found == {(c, f): (200 if (c, f) in right else 0, 200) for c in range(4) for f in ("name", "father", "dob")}
    assert kept[0].count() < 20
