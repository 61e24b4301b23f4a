"""Exact duplicates by deterministic block naming.

Texts are cut into fixed-size byte blocks. The distinct blocks are sorted and numbered,
which gives every block a collision-free integer name; then the names of adjacent blocks
are paired and the distinct pairs are sorted and numbered in turn, until one name is left
for each text. Equal names mean equal bytes; no hash decides.

Only texts that share byte length and a 64-bit hash with another row are named: a row
alone with its (length, hash) differs from every other text, so it is its own group.

Defined cases: a null text counts as empty; of equal texts exactly one row is kept, that with
the largest doc_id: rows without doc_id come last, and of rows that repeat the largest one any
one stays; every row counts in group_size; long texts are named whole; an empty table gives an
empty result. All columns are referred to by the given names, others, whatever their names,
are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, documents

BLOCK_BYTES = 4096


def _numbered(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct ``keys`` in sorted order with an integer ``name``; written once, so the
    numbers stay what they are when a later task is repeated. The order is that of (hash, key):
    the driver draws the ranges from a sample of 8-byte hashes instead of whole blocks, and
    keys of one hash still get a name each."""
    first = F.xxhash64(*cols)
    ordered = keys.select(*cols).distinct().repartitionByRange(first).sortWithinPartitions(first, *cols)
    return cut(ordered.withColumn("name", F.monotonically_increasing_id()))


def name_texts(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (rid, body binary) -> (rid, name, levels): equal (name, levels) iff equal bytes."""
    n_blocks = F.greatest(F.ceil(F.octet_length("body") / block_bytes), F.lit(1)).cast("int")
    blocks = rows.select(
        "rid",
        F.posexplode(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring("body", i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
    )
    names = _numbered(blocks, ["block"])
    named = blocks.join(names.hint("merge"), "block").select("rid", "pos", "name")
    longest = rows.agg(F.max(n_blocks)).first()[0] or 1
    for _ in range(max(0, (longest - 1).bit_length())):
        pairs = cut(
            named.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        named = pairs.join(_numbered(pairs, ["a", "b"]).hint("merge"), ["a", "b"]).select("rid", "pos", "name")
    return named.select("rid", "name")


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: list[str], block_bytes: int):
    """(single, copies): the rows of ``docs`` whose text no other row can have, and the others with
    rid, keep_id, keep_rid and group_size. Both have id, n, h, body and ``keep`` in ``row``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*keep).alias("row"), text.alias("body")).withColumns({"n": F.octet_length("body"), "h": F.xxhash64("body")})
    shared = cut(rows.groupBy("n", "h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("n", "h"))
    suspects = cut(rows.join(shared, ["n", "h"], "left_semi").select("id", "row", "n", "h", "body", F.monotonically_increasing_id().alias("rid")))
    named = name_texts(suspects.select("rid", F.encode("body", "utf-8").alias("body")), block_bytes)
    of = cut(named.join(suspects.select("rid", "id", "n").hint("merge"), "rid"))
    last = F.max(F.struct("id", "rid"))  # rows without id come last, of equal ids one stays
    groups = of.groupBy("n", "name").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size"))
    report = of.join(groups.hint("merge"), ["n", "name"]).select("rid", F.col("last.id").alias("keep_id"), F.col("last.rid").alias("keep_rid"), "group_size")
    return rows.join(shared, ["n", "h"], "left_anti"), suspects.join(report.hint("merge"), "rid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    single, copies = _grouped(docs, id_col, text_col, [id_col], block_bytes)
    one = {"keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    cols = [F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.sha2("body", 256).alias("text_sha256")]
    return single.withColumns(one).select(*cols).unionByName(copies.withColumn("kept", F.col("rid") == F.col("keep_rid")).select(*cols))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops: decided row by row, never by id."""
    single, copies = _grouped(docs, id_col, text_col, docs.columns, block_bytes)
    return single.select("row.*").unionByName(copies.where("rid = keep_rid").select("row.*"))


def op8_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
