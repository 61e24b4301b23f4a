"""Derived inputs, as SQL that Spark and DuckDB both run (braces name the given tables)."""

from __future__ import annotations

from rowproof.sources.scratch import written

BASE_SHEET = """
SELECT c.c_custkey AS cid, CAST(c.c_custkey + 2 AS INT) AS row_no,
  CAST(251612000000 + c.c_custkey AS STRING) AS reg,
  CAST(900000000000 + c.c_custkey * 7 AS STRING) AS abc,
  concat(p1.p_name, ' ', n.n_name) AS name,
  concat('Shri ', p2.p_name) AS father, p3.p_name AS mother,
  CAST(DATE '1998-01-01' + CAST((c.c_custkey * 37) % 3000 AS INT) AS STRING) AS dob
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN part p1 ON p1.p_partkey = c.c_custkey % 200
JOIN part p2 ON p2.p_partkey = (c.c_custkey * 7 + 3) % 200
JOIN part p3 ON p3.p_partkey = (c.c_custkey * 11 + 5) % 200
"""

SHEET = """
SELECT * FROM base_sheet
UNION ALL SELECT cid, row_no + 1000000, reg, abc, name, father, mother, dob FROM base_sheet WHERE cid % 50 = 0
"""

RECORDS = """
SELECT o.o_orderkey AS rec_seq, concat('doc_', CAST(o.o_orderkey AS STRING), '.pdf') AS file, 1 AS page,
  CASE k WHEN 10 THEN concat(substr(s.reg, 1, 11), 'X') WHEN 11 THEN NULL WHEN 12 THEN NULL ELSE s.reg END AS reg,
  CASE k WHEN 12 THEN NULL WHEN 13 THEN concat('8', substr(s.abc, 2)) ELSE s.abc END AS abc,
  CASE k WHEN 1 THEN upper(s.name)
         WHEN 2 THEN concat(split_part(s.name, ' ', 2), ' ', split_part(s.name, ' ', 1), substr(s.name, length(split_part(s.name, ' ', 1)) + length(split_part(s.name, ' ', 2)) + 2))
         WHEN 3 THEN concat(substr(s.name, 1, 1), substr(s.name, 3))
         WHEN 4 THEN concat(substr(s.name, 1, 1), '. ', substr(s.name, length(split_part(s.name, ' ', 1)) + 2))
         WHEN 5 THEN replace(s.name, ' ', '')
         WHEN 6 THEN concat('Mr. ', s.name)
         WHEN 14 THEN 'Entirely Other Person'
         WHEN 15 THEN replace(s.name, 'e', 'é') ELSE s.name END AS name,
  CASE k WHEN 7 THEN NULL ELSE replace(s.father, 'Shri ', '') END AS father, CASE k WHEN 6 THEN substr(s.mother, 1, length(s.mother) - 3) ELSE s.mother END AS mother,
  CASE k WHEN 8 THEN concat(substr(s.dob, 6, 2), '-', substr(s.dob, 9, 2), '-', substr(s.dob, 1, 4))
         WHEN 9 THEN concat(substr(s.dob, 9, 2), '/', substr(s.dob, 6, 2), '/', CAST(CAST(substr(s.dob, 1, 4) AS INT) + 1 AS STRING))
         ELSE concat(substr(s.dob, 9, 2), '-', substr(s.dob, 6, 2), '-', substr(s.dob, 1, 4)) END AS dob
FROM (SELECT *, o_orderkey % 16 AS k FROM orders) o JOIN base_sheet s ON s.cid = o.o_custkey
"""

CHECKS = """
SELECT CAST(rec_seq + 2 AS INT) AS row_no, coalesce(reg, '') AS enroll, abc, name AS student,
  CASE rec_seq % 6
    WHEN 0 THEN concat('Student Name : ', name, chr(10), 'Date of Birth : ', dob)
    WHEN 1 THEN coalesce(father, '')
    WHEN 2 THEN concat('Total marks ', CAST(rec_seq AS STRING))
    WHEN 3 THEN concat('Aadhaar No : ', abc)
    WHEN 4 THEN concat('Mother''s Name : ', mother, ' Devi')
    ELSE 'Father''s Name :' END AS expected,
  CASE rec_seq % 6 WHEN 4 THEN concat('Mother''s Name : ', mother) ELSE '' END AS claimed,
  CASE rec_seq % 6 WHEN 1 THEN 'Father name wrong' ELSE '' END AS remark
FROM records
"""

# text runs: each record printed as one line a field, 6 points a character and 14 a line; mother and
# birth date stand in a second column beside name and father
RUNS = """
SELECT rec_seq, file, 1 AS page, nth AS run_seq, label || ' : ' || value AS str, CAST(0 AS DOUBLE) AS t2, CAST(10 AS DOUBLE) AS t3, CAST(x AS DOUBLE) AS x, CAST(700 - 14 * line AS DOUBLE) AS y,
  CAST(6 * length(label || ' : ' || value) AS DOUBLE) AS width, CAST(0 AS DOUBLE) AS descent
FROM (
  SELECT rec_seq, file, 1 AS nth, 'Registration No.' AS label, reg AS value, 40 AS x, 1 AS line FROM records
  UNION ALL SELECT rec_seq, file, 2, 'ABC ID', abc, 40, 2 FROM records
  UNION ALL SELECT rec_seq, file, 3, 'Student Name', name, 40, 3 FROM records
  UNION ALL SELECT rec_seq, file, 4, 'Mother''s Name', mother, 520, 3 FROM records
  UNION ALL SELECT rec_seq, file, 5, 'Father''s Name', father, 40, 4 FROM records
  UNION ALL SELECT rec_seq, file, 6, 'Date of Birth', dob, 520, 4 FROM records
) f WHERE value IS NOT NULL
"""

VIEWS = {"base_sheet": BASE_SHEET, "sheet": SHEET, "records": RECORDS, "checks": CHECKS, "runs": RUNS}
TABLES = ("customer", "nation", "part", "orders")


def with_views(query: str, names: tuple[str, ...] = ("base_sheet", "sheet", "records")) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + query


def dealt(rows):
    """A table of fewer files than there are cores, dealt to all of them: everything derived from it
    would run in as many tasks as it has files."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def checks_of(records):
    """The view ``checks`` of records that are worked out already."""
    return records.sparkSession.sql(CHECKS.replace("FROM records", "FROM {records}"), records=records)


def view(spark, sf_dir: str, name: str):
    """One derived view as a DataFrame over the tables of ``sf_dir``."""
    if name == "runs":  # six parts of the records, which are worked out once
        return spark.sql(RUNS.replace("FROM records", "FROM {records}"), records=written(view(spark, sf_dir, "records")))
    sql = with_views(f"SELECT * FROM {name}", ("base_sheet", "sheet", "records", *([name] if name == "checks" else [])))
    tables = {t: dealt(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES}
    for t in TABLES:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})")
    return spark.sql(sql, **{t: df for t, df in tables.items() if f"{{{t}}}" in sql})
