"""Every stage of the pipeline on a small table, against plain Python."""

import random
import re

import pytest

import corpus_pipeline
from rowproof.llm import bpe, exact_dedup, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    good = lambda n=40: " ".join(f"word{rng.randrange(300)}" for _ in range(n))
    bad = lambda: " ".join(f"#@!{rng.randrange(9)}" for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "en" if i % 4 else None, f"s{i % 3}" if i % 5 else None) for i in range(240)]
    shared = good(60)
    rows += [(300, shared, "en", "s0"), (301, shared, "en", "s0"), (302, shared + " end", "en", "s1"), (1, rows[1][1], "en", "s1"), (None, good(), "en", "s1"), (None, None, None, None), (303, "", "en", "s2")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, lang, s, len(t or ""), f"r{k}") for k, (i, t, lang, s) in enumerate(rows)], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(6, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, folder)
    judged = {r.rid: r.accepted for r in quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).join(docs.select("doc_id", "text", "rid"), "doc_id").collect()}
    mine = {r.rid: r for r in kept.collect()}
    assert kept.columns == docs.columns and all(judged[r] == (r in mine) for r in judged)
    assert sum(int(r.rid[1:]) % 3 == 0 for r in mine.values() if int(r.rid[1:]) < 240) == 0 and sum(int(r[1:]) < 240 for r in mine) == 160

    once = stages["exact dedup"](spark, kept, folder).collect()
    best = {}
    for r in mine.values():
        best.setdefault(r.text or "", []).append(r)
    assert len(once) == len(best) == len({r.text or "" for r in once})
    for r in once:
        ids = [x.doc_id for x in best[r.text or ""] if x.doc_id is not None]
        assert r.doc_id == (max(ids) if ids else None)

    single = spark.createDataFrame(once, docs.schema)
    far = stages["near dedup"](spark, single, folder).collect()
    sets = {r.rid: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())) for r in once}
    gone = {r.rid for r in once} - {r.rid for r in far}
    assert gone and all(any(len(sets[g] & sets[r.rid]) * 100 >= 80 * len(sets[g] | sets[r.rid]) for r in far) for g in gone)

    mixed = stages["mixing"](spark, spark.createDataFrame(far, docs.schema), folder)
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(spark.createDataFrame(far, docs.schema)).where("doc_id is not null").collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns and {i: n for i, n in times.items() if i is not None} == {i: n for i, n in plan.items() if n}

    path, pattern = bpe.default_tokenizer()
    coder = bpe.ByteBpe(open(path, "rb").read(), pattern)
    coded = stages["byte-level BPE"](spark, mixed, folder).collect()
    by_id = {r.doc_id: r.text or "" for r in mixed.collect() if r.doc_id is not None}
    assert len(coded) == mixed.count() and all(coder.decode(bytes(r.ids)).decode() == by_id[r.doc_id] for r in coded if r.doc_id is not None)


def test_run(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_copies_by_row(spark):
    rows = [(5, "a"), (5, "b"), (9, "a"), (None, "n"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(exact_dedup.drop_exact_copies(docs)) == sorted([(5, "b"), (9, "a"), (None, "n")], key=str)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 9, 2, False), (9, 9, 2, True), (5, 5, 1, True), (None, None, 2, True), (None, None, 2, False)], key=str)
    wide = spark.createDataFrame([(1, "x", "r", "i", 2, 3)], "doc_id long, text string, rid string, id string, n int, h int")
    assert _rows(exact_dedup.drop_exact_copies(wide)) == [(1, "x", "r", "i", 2, 3)]


def test_clashing_names(spark):
    path, pattern = bpe.default_tokenizer()
    rows = spark.createDataFrame([(1, "ab c", "x")], "doc_id long, text string, ids string")
    assert bpe.encode(rows, path, pattern).columns == ["doc_id", "ids"]
    assert bpe.encode(rows, path, pattern, ids_col="coded").columns == ["doc_id", "ids", "coded"]
    odd = spark.createDataFrame([(1, "ab c", None, None, "s", "n")], "doc_id long, text string, lang string, source string, stats string, nth string")
    assert quality.drop_low_quality(odd, spark.createDataFrame([], "doc_id long, quality int")).collect() == odd.collect()
