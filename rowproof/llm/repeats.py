"""Substring dedup: words covered by a 50-word window that starts in an earlier document.

Windows are suffixes of the texts, of which the first 50 words count. Prefixes of varying
length split them into groups, each group is a subtree of the suffix tree, and its internal
nodes at least 50 words deep are the repeats; the smallest doc_id of a node keeps it.

1. Places. Of each 50-word window the place with the smallest 8-word hash is chosen. Equal
   windows choose the same place, so windows fall into segments, runs of windows with one
   place, about one per 22 words. The 8 words at the place are the first prefix: windows whose
   place no other segment shares repeat nowhere and go no further.
2. Whole segments. Equal segments share all their windows at once: the smallest doc_id keeps
   them, later rows lose them. One segment of each kind goes deeper, so a passage held by a
   third of all documents is one row per task here and one row in its group.
3. Subtrees. The words of the segments of one 8-word prefix come together in one task, at most
   ``GROUP`` segments (about 1 MB). Their suffixes are sorted and the common prefixes of
   neighbours measured: runs with 50 common words are the deep internal nodes. A segment's
   windows on a node whose smallest doc_id is smaller than its own go.
4. Longer prefixes. A prefix with more segments than that, in any number, is split further: its
   windows become one row each, named by their whole 50 words, and each such node is one
   aggregated row.

Prefixes, segments and words are told apart by 64-bit hashes (see words.py).

Defined cases: null and empty texts have no words and lose none; windows repeated only within
their own document, or in rows of the same doc_id, stay; rows with a null doc_id come last, as
one document, and lose what others hold; rows are cut singly, whatever their id; texts are read
whole; an empty table gives an empty result; other columns, whatever their names, are passed
over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, documents, numbered
from .words import hashed_batches, mix, run_sums

WINDOW, PREFIX = 50, 8
GROUP = 1024  # segments of one prefix that a task takes together; more are split by longer prefixes
TOGETHER = 1 << 16  # words of whole groups that are solved at once
LAST = (1 << 63) - 1  # stands for a null doc_id
_Q = 0xD6E8FEB86659FD93
_I64 = np.int64


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by doubling."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(h: np.ndarray, at: np.ndarray, window: int, prefix: int):
    """Windows of the texts grouped by the place they choose.
    Returns text index, first window (in the piece), number of windows, place."""
    width = window - prefix + 1
    grams = run_sums(h, np.arange(max(0, len(h) - prefix + 1)), np.arange(prefix, len(h) + 1), _Q) if len(h) >= prefix else np.zeros(0, np.uint64)
    empty = np.zeros(0, _I64)
    if len(grams) < width:
        return empty, empty, empty, empty, grams
    # the place is packed under the hash: ties go to the leftmost, alike in equal windows
    bits = np.uint64(max(24, int(len(h)).bit_length()))  # the same in every piece
    low = _window_min((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), width)
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(_I64)
    first = np.arange(len(place))
    text = np.searchsorted(at, first, "right") - 1
    whole = first + window <= at[text + 1]
    first, place, text = first[whole], place[whole], text[whole]
    if not len(first):
        return empty, empty, empty, empty, grams
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    return text[new], first[new], np.diff(np.r_[new, len(first)]), place[new], grams


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(_I64))


def segment_rows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """``docs`` (rid, doc, text) -> one row per segment: first word, number of windows n."""

    def run(batches):
        for rows, _, h, at, _, _ in hashed_batches(batches):
            text, first, n, place, grams = segments(h, at, window, prefix)
            if len(text):
                whole = mix(run_sums(h, first, first + n + window - 1, _Q) + ((place - first) * 65_537 + n).astype(np.uint64))
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays([_signed(grams[place]), _signed(whole), rows.column(1).take(of), rows.column(0).take(of), pa.array((first - at[text]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["prefix", "segment", "doc", "rid", "first", "n"])

    return docs.select("rid", "doc", "text").mapInArrow(run, "prefix long, segment long, doc long, rid long, first int, n int")


def _spans(rows: pa.RecordBatch, at: np.ndarray):
    """(column of structs, text index, first word in the piece, windows) of all spans."""
    spans = rows.column(rows.schema.get_field_index("spans"))
    inner = spans.flatten()
    text = np.repeat(np.arange(len(rows)), np.asarray(spans.value_lengths()))
    get = lambda name: inner.field(inner.type.get_field_index(name))
    return get, text, at[text] + np.asarray(get("first"), dtype=_I64), np.asarray(get("n"), dtype=_I64)


def segment_words(todo: DataFrame, window: int) -> DataFrame:
    """(text, spans) -> prefix, segment, doc, words (the hashes of a segment's words)."""

    def run(batches):
        for rows, _, h, at, _, _ in hashed_batches(batches):
            get, _, first, n = _spans(rows, at)
            words = pa.array([h[a : a + k + window - 1].tobytes() for a, k in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([get("prefix"), get("segment"), get("doc"), words], names=["prefix", "segment", "doc", "words"])

    return todo.select("text", "spans").mapInArrow(run, "prefix long, segment long, doc long, words binary")


def window_rows(todo: DataFrame, window: int) -> DataFrame:
    """(text, spans) -> one row per window: node (its words), prefix, segment, doc, off."""

    def run(batches):
        for rows, _, h, at, _, _ in hashed_batches(batches):
            get, _, first, n = _spans(rows, at)
            each = np.repeat(np.arange(len(first)), n)
            off = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            start, of = first[each] + off, pa.array(each)
            yield pa.RecordBatch.from_arrays([_signed(run_sums(h, start, start + window, _Q)), *[get(c).take(of) for c in ("prefix", "segment", "doc")], pa.array(off.astype(np.int32))], names=["node", "prefix", "segment", "doc", "off"])

    return todo.select("text", "spans").mapInArrow(run, "node long, prefix long, segment long, doc long, off int")


def deep_nodes(suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of the deep internal node, or leaf, of each suffix (a row of words) of its group's
    subtree. Sorted, the suffixes of a node are neighbours that have all words in common."""
    keyed = np.column_stack([group.astype(np.uint64), suffixes])
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1] * 8}").ravel(), kind="stable")
    common = np.ones(len(order), bool)
    if len(order):
        common[0] = False
        for i in range(1, len(order), 4096):  # neighbours, a few at a time
            j = min(i + 4096, len(order))
            common[i:j] = (keyed[order[i:j]] == keyed[order[i - 1 : j - 1]]).all(1)
    node = np.empty(len(order), _I64)
    node[order] = np.cumsum(~common)
    return node


def subtrees(rows: DataFrame, window: int) -> DataFrame:
    """(prefix, segment, doc, words), sorted by prefix -> prefix, segment, off: the windows that
    start in a smaller doc too."""
    names = ["prefix", "segment", "off"]

    def solve(held):
        """held: lists of (prefix, segment, doc, words), whole groups."""
        words = [np.frombuffer(w, np.uint64) for w in held[3]]
        n = np.array([len(w) - window + 1 for w in words])
        which = np.repeat(np.arange(len(words)), n)
        suffixes = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, window) for w in words])
        prefix, segment, doc = (np.array(held[k], _I64) for k in range(3))
        node = deep_nodes(suffixes, prefix[which].view(np.uint64))
        order = np.argsort(node, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0])
        least = np.minimum.reduceat(doc[which][order], begin)
        gone = np.empty(len(order), bool)
        gone[order] = doc[which][order] > np.repeat(least, np.diff(np.r_[begin, len(order)]))
        off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return pa.RecordBatch.from_arrays([pa.array(prefix[which][gone]), pa.array(segment[which][gone]), pa.array(off[gone].astype(np.int32))], names=names)

    def run(batches):
        held, size = ([], [], [], []), 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if size >= TOGETHER and row[0] != held[0][-1]:
                    yield solve(held)
                    held, size = ([], [], [], []), 0
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                size += len(row[3]) // 8
        if size:
            yield solve(held)

    return rows.mapInArrow(run, "prefix long, segment long, off int")


def _of_rows(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """(text, spans): each row's own segments of ``segs`` beside its text."""
    own = segs.groupBy("rid").agg(F.collect_list(F.struct("prefix", "segment", "doc", "first", "n")).alias("spans"))
    return docs.select("rid", "text").join(own, "rid")


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """``docs`` (rid, doc, text) -> (rid, spans): first word and number of words of what is
    repeated; spans may overlap."""
    rows, key = cut(segment_rows(docs, window, prefix)), ["prefix", "segment"]
    held = cut(rows.groupBy(*key).agg(F.min(F.struct("doc", "rid", "first", "n")).alias("owner"), F.max("doc").alias("last")))
    shared = held.groupBy("prefix").agg(F.count(F.lit(1)).alias("k"), F.min("owner.doc").alias("a"), F.max("owner.doc").alias("b")).where("a < b").select("prefix", "k")
    open_ = cut(held.join(shared, "prefix").select(*key, "k", "owner.*"))
    parts = cut(subtrees(segment_words(_of_rows(docs, open_.where(F.col("k") <= group)), window).repartition("prefix").sortWithinPartitions("prefix"), window).groupBy(*key).agg(F.collect_list("off").alias("offs")))
    hot = open_.where(F.col("k") > group)
    if not hot.isEmpty():
        windows = cut(window_rows(_of_rows(docs, hot), window))
        nodes = windows.groupBy("node").agg(F.min("doc").alias("holder"), F.max("doc").alias("of")).where("of > holder").select("node", "holder")
        more = windows.join(nodes, "node").where("doc > holder").groupBy(*key).agg(F.collect_list("off").alias("offs"))
        parts = parts.unionByName(cut(more))
    # what rows lose: later holders the whole segment, the owner's rows the windows found above
    lost = cut(held.join(parts, key, "left").where("last > owner.doc or offs is not null").select(*key, F.col("owner.doc").alias("holder"), "offs"))
    met = rows.join(lost, key).where("doc > holder or offs is not null")
    whole = F.array(F.lit(0).cast("int"))
    each = met.select("rid", "first", (F.col("doc") > F.col("holder")).alias("later"), "n", F.explode(F.when(F.col("doc") > F.col("holder"), whole).otherwise(F.col("offs"))).alias("off"))
    found = each.select("rid", (F.col("first") + F.col("off")).alias("first"), (F.when(F.col("later"), F.col("n")).otherwise(1) + window - 1).alias("n"))
    return found.groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def cut_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by
    one space)."""
    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    keyed = own.select("rid", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")
    spans = cut(repeated_spans(keyed, window, prefix, group))

    def run(batches):
        for rows, data, h, at, begins, ends in hashed_batches(batches):
            found = rows.column(2).to_pylist()
            raw, total, gone, kept = data.tobytes(), [], [], []
            for k in range(len(rows)):
                a, b = at[k], at[k + 1]
                keep = np.ones(b - a, bool)
                if found[k]:
                    edge = np.zeros(b - a + 1, np.int64)
                    first = np.array([s["first"] for s in found[k]])
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + np.array([s["n"] for s in found[k]]), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                total.append(int(b - a))
                gone.append(int((~keep).sum()))
                kept.append(b" ".join([raw[x:y] for x, y in zip(begins[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return own.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text binary")


def op5_repeats(spark, sf_dir):
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
