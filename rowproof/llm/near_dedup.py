"""Near duplicates by a chosen-path set similarity join.

Each row's set of word shingles gets a signature of 64 minwise tokens. In each of ``TREES``
independent trees a row walks down from the root: a node chooses one coordinate, or two with
probability 1/4 (5/4 = 1/similarity on average), by a hash of its path, and the row goes to
the child named by its own minwise token there. Two rows of the wanted similarity stay
together in about one child a level. All rows walk ``START`` levels; a node of more than
``SMALL`` rows then has its smallest row confirmed against all others, and walks on, ``STEP``
levels at a time, unless that made it one component. A node whose rows mostly stay together
on the way gains nothing from it, and is dealt into blocks instead, every two of which meet.

The nodes at the end are compared exhaustively, in two passes. First each row proposes the
row that it resembles most and the row that resembles most of the node, by the signatures;
both are confirmed on full shingle sets. After that most nodes are one component. In those
that are not, rows whose signatures allow a link into another component bring their full
sets, once for nodes of the same rows, and every such pair is tested: the intersection sizes
of a node are one product of its row-by-shingle matrices. So no pair that a node holds and the
signatures allow (within 4.5 standard deviations of the wanted similarity) is left untried
unless its ends are linked already, and a node gives a few rows a member, never its pairs.

Rows of equal sets are one class from the start (equal size and two 64-bit sums of the set,
mixed differently), so exact copies cost one row each and are never paired.

Defined cases: a text with fewer words than a shingle is one shingle, its whole sequence; a
text without words has the empty set and is linked with nothing; null texts count as empty.
Links join rows, whatever their ids: rows that repeat an id, or have none, are linked as their
texts are. component_id is the smallest id of the component, null if no row of it has one; of
each component one row is kept, that with the smallest id (rows without id come last; of rows
that repeat the smallest id one stays). Texts are read whole; an empty table gives an empty
result; other columns, whatever their names, are passed over by the report and kept by the
filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blas import one_thread
from .components import connected
from .store import cut, documents, free_name, numbered
from .words import hashed_batches, mix, run_sums

SHINGLE, PERCENT = 5, 80
COORDS, TREES = 64, 12
START, STEP, SMALL, BLOCK = 4, 2, 1024, 1024
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(11))
_A = _rng.integers(0, 1 << 63, COORDS, dtype=_U) * _U(2) + _U(1)
_B = _rng.integers(0, 1 << 63, COORDS, dtype=_U)
_P = 0xC2B2AE3D27D4EB4F
_OTHER = _U(0x9E3779B97F4A7C15)
CLASS = ["n", "sum", "sum2"]


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int):
    """(sorted distinct shingle hashes) of each text, from its words' hashes."""
    runs = run_sums(h, np.arange(max(0, len(h) - k + 1)), np.arange(k, len(h) + 1), _P) if len(h) >= k else np.zeros(0, _U)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield run_sums(h[a:b], np.array([0]), np.array([b - a]), _P)
        else:
            yield np.zeros(0, _U)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 (texts, COORDS); all sets are non-empty."""
    flat, begin = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), COORDS), np.uint16)
    for k in range(COORDS):
        out[:, k] = mix(np.minimum.reduceat(flat * _A[k] + _B[k], begin)) & _U(0xFFFF)
    return out


def _fixed(values: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as binary values."""
    width = values.shape[1] * values.itemsize
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    offsets = pa.py_buffer((np.arange(len(values) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(values), [None, offsets, data])


def sketches(rows: DataFrame, k: int) -> DataFrame:
    """(doc, n, sum, sum2, sig): set size, two order-free 64-bit sums of the set, signature; sig
    is null for the empty set."""
    names = ["doc", *CLASS, "sig"]

    def run(batches):
        for part, _, h, at, _, _ in hashed_batches(batches, lower=True):
            sets = list(shingle_sets(h, at, k))
            some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            none = pa.array([i for i, s in enumerate(sets) if not len(s)], pa.int64())
            if len(some):
                size = pa.array([len(sets[i]) for i in some], pa.int64())
                sums = [np.array([mix(sets[i] * odd).sum(dtype=_U) for i in some], _U) for odd in (_U(1), _OTHER)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), size, *[pa.array(s.view(np.int64)) for s in sums], _fixed(_signatures([sets[i] for i in some]))], names=names)
            if len(none):
                zero = pa.array(np.zeros(len(none), np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(none), zero, zero, zero, pa.nulls(len(none), pa.binary())], names=names)

    return rows.mapInArrow(run, "doc long, n long, sum long, sum2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COORDS)


def descend(path: np.ndarray, row: np.ndarray, sig: np.ndarray, levels: int):
    """Nodes ``levels`` below (path, row), where row is a row of ``sig``."""
    for _ in range(levels):
        first = (mix(path + _U(1)) % _U(COORDS)).astype(np.int64)
        second = (mix(path + _U(3)) % _U(COORDS)).astype(np.int64)
        two = np.flatnonzero((mix(path + _U(2)) < _U(1 << 62)) & (second != first))
        path, row, coord = np.r_[path, path[two]], np.r_[row, row[two]], np.r_[first, second[two]]
        path = mix(path ^ mix((coord.astype(_U) << _U(16)) + sig[row, coord] + _U(1)))
    return path, row


def branch(rows: DataFrame, levels: int, roots: bool) -> DataFrame:
    """(doc, sig[, node]) -> (parent, node, doc), ``levels`` further down every path."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                sig = _matrix(part.column(1))
                if roots:
                    path, row = mix(np.repeat(np.arange(1, TREES + 1, dtype=_U), len(part))), np.tile(np.arange(len(part)), TREES)
                    above = None
                else:
                    path, row = part.column(2).to_numpy().view(_U), np.arange(len(part))
                    above = part.column(2)
                path, row = descend(path, row, sig, levels)
                at = pa.array(row)
                parent = pa.nulls(len(row), pa.int64()) if above is None else above.take(at)
                yield pa.RecordBatch.from_arrays([parent, pa.array(path.view(np.int64)), part.column(0).take(at)], names=["parent", "node", "doc"])

    return rows.mapInArrow(run, "parent long, node long, doc long")


def _least(percent: int) -> float:
    """Equal tokens that a pair of the wanted similarity has but for 4.5 standard deviations."""
    return COORDS * percent / 100 - 4.5 * (COORDS * percent / 100 * (1 - percent / 100)) ** 0.5


def alike(sig: np.ndarray) -> np.ndarray:
    """Equal tokens of every two rows of ``sig``, as uint8."""
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(COORDS):
        c = np.ascontiguousarray(sig[:, k])
        out += c[:, None] == c[None, :]
    return out


def possible(n: np.ndarray, comp: np.ndarray, same: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a node sizes and signatures allow, between two components."""
    can = same >= _least(percent)
    for i in range(0, len(n), 128):  # a few rows at a time: no large temporary matrices
        a, part = n[i : i + 128, None], can[i : i + 128]
        part &= 100 * np.minimum(a, n) >= percent * np.maximum(a, n)
        part &= comp[i : i + 128, None] != comp
    return can


def _first_pass(node, rows, percent):
    """(row, other, tokens alike, hub) twice a row: the row it resembles most, and the one that
    resembles most rows of the node."""
    doc = np.array([x[0] for x in rows])
    same = alike(np.frombuffer(b"".join(x[3] for x in rows), np.uint16).reshape(-1, COORDS))
    can = possible(np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), same, percent)
    some = np.flatnonzero(can.any(1))
    if not len(some):
        return None
    weight = same * can
    best, hub = weight[some].argmax(1), int(weight.sum(1, dtype=np.int64).argmax())
    near = some[can[some, hub]]
    a, b = np.r_[doc[some], doc[near]], np.r_[doc[best], np.full(len(near), doc[hub])]
    return [np.full(len(a), node), a, b, np.r_[weight[some, best], weight[near, hub]], np.r_[np.zeros(len(some), int), np.full(len(near), int(can[hub].sum()))]]


def _open_rows(node, rows, percent):
    """The rows that a pair between two components may still link."""
    same = alike(np.frombuffer(b"".join(x[3] for x in rows), np.uint16).reshape(-1, COORDS))
    can = possible(np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), same, percent)
    some = np.flatnonzero(can.any(1))
    return [np.full(len(some), node), np.array([x[0] for x in rows])[some]] if len(some) else None


def intersections(sets: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """Sizes of all pairwise intersections; shingles that only one set has are left out, the
    others are columns of a 0/1 matrix, a thousand of which are multiplied at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[word] > 1
    word, owner = shared[word[keep]], owner[keep]
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 2^24 shingles
    for low in range(0, int(word[-1]) + 1 if len(word) else 0, columns):
        a, b = np.searchsorted(word, [low, low + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], word[a:b] - low] = 1
        total += part @ part.T
    return total


def _confirmed(node, rows, percent):
    """Every pair of a node between two components, tested on full sets; (row, smallest row
    that it reaches over links) for the rows that a link joins."""
    doc, n, comp = (np.array([x[c] for x in rows]) for c in range(3))
    same = alike(np.frombuffer(b"".join(x[3] for x in rows), np.uint16).reshape(-1, COORDS))
    both = intersections([np.frombuffer(x[4], _U) for x in rows])
    link = possible(n, comp, same, percent)
    for i in range(0, len(n), 128):
        link[i : i + 128] &= 100 * both[i : i + 128] >= percent * (n[i : i + 128, None] + n - both[i : i + 128])
    label = np.arange(len(doc))
    while True:
        least = np.array([min(label[i], label[link[i]].min(initial=len(doc))) for i in range(len(doc))])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(doc)))
    return [doc[label[moved]], doc[moved]] if len(moved) else None


def by_node(rows: DataFrame, one, schema: str) -> DataFrame:
    """``rows`` (node, doc, n, comp, sig[, items]), sorted by node, through ``one`` node by node."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        one_thread()
        held, node = [], None

        def packed(found):
            cols = [np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            found = []
            for at, *row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if at != node:
                    if len(held) > 1 and (made := one(node, held)) is not None:
                        found.append(made)
                    held, node = [], at
                held.append(row)
            yield packed(found)
        yield packed([made] if len(held) > 1 and (made := one(node, held)) is not None else [])

    return rows.mapInArrow(run, schema)


def labelled(rows: DataFrame, merged: DataFrame | None, doc: str = "doc", name: str = "comp") -> DataFrame:
    """``rows`` with the component of column ``doc``, itself where it has no link."""
    if merged is None:
        return rows.withColumn(name, F.col(doc))
    of = merged.select(F.col("doc").alias(doc), F.col("component").alias("_component"))
    return rows.join(of, doc, "left").withColumn(name, F.coalesce("_component", doc)).drop("_component")


def mixed_nodes(rows: DataFrame, merged: DataFrame | None) -> DataFrame:
    """(node) of the nodes of ``rows`` (node, doc) that are not one component."""
    return labelled(rows.select("node", "doc"), merged).groupBy("node").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d").select("node")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc, items): the shingle set as sorted little 64-bit integers."""

    def run(batches):
        for rows, _, h, at, _, _ in hashed_batches(batches, lower=True):
            items = pa.array([s.tobytes() for s in shingle_sets(h, at, k)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), items], names=["doc", "items"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, items binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(batch)):
                s, t = np.frombuffer(x[i].as_buffer(), _U), np.frombuffer(y[i].as_buffer(), _U)
                at = np.searchsorted(s, t)
                both = int((s[np.minimum(at, len(s) - 1)] == t).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    wide = pairs.select("a", "b").join(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (node, doc, size) of nodes that are too large -> (node, doc) of nodes of about two
    blocks each: every two blocks of an old node are a new one."""
    n = F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(2)).cast("int")
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("doc"), n).cast("int")).withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j != F.pmod(F.xxhash64("doc"), n))))
    return dealt.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "doc")


def leaf_nodes(reps: DataFrame, own: DataFrame, k: int, percent: int):
    """(nodes, links): what is to be compared whole (node, doc), at most about 2 * BLOCK rows a
    node, and the links (a, b) that were confirmed on the way, or None."""
    rows, leaves, links, merged = cut(branch(reps.select("doc", "sig"), START, True)), [], None, None
    while True:
        sizes = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("least")).where("size > 1"))
        # written: a union of joins on one key is made partition by partition, which fails in Spark 4.1
        # once a join of them is read locally
        leaves.append(cut(rows.join(sizes.where(F.col("size") <= SMALL).select("node"), "node").select("node", "doc")))
        large = sizes.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        rows = cut(rows.join(large, "node").select("node", "doc", "size", "least"))
        stars = rows.where("doc != least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct()
        stars = cut(labelled(labelled(stars, merged, "a", "ca"), merged, "b", "cb").where("ca != cb").select("a", "b"))
        wanted = stars.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        found = cut(confirm(stars, cut(full_sets(own.join(wanted, "doc", "left_semi"), k)), percent))
        links = found if links is None else links.unionByName(found)
        merged = cut(connected(links))
        rows = cut(rows.join(mixed_nodes(rows, merged), "node", "left_semi"))
        if rows.isEmpty():
            break
        below = cut(branch(rows.select("node", "doc").join(reps, "doc").select("doc", "sig", "node"), STEP, False))
        # a child that holds most of its parent: the parent's rows do not part, it is dealt out
        kept = below.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("of")).groupBy("parent").agg(F.max("of").alias("of"))
        stuck = cut(rows.groupBy("node").agg(F.max("size").alias("size")).join(kept.withColumnRenamed("parent", "node"), "node").where("2 * of > size").select("node"))
        leaves.append(blocks(rows.join(stuck, "node", "left_semi").select("node", "doc", "size")))
        rows = below.join(stuck.withColumnRenamed("node", "parent"), "parent", "left_anti")
    small = leaves[0]
    for x in leaves[1:]:
        small = small.unionByName(x)
    return small, links


def once(rows: DataFrame) -> DataFrame:
    """``rows`` (node, doc) without the nodes whose rows are all those of another node, and no more:
    the trees bring the same rows together again and again. Equal sets of rows are told by size and
    two 64-bit sums."""
    sums = [F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"sum{i}") for i in range(2)]
    by = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *sums)
    return rows.join(by.groupBy("size", "sum0", "sum1").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", "doc")


def links_of(reps: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect every component of ``reps`` (doc, n, sig)."""
    nodes, links = leaf_nodes(reps, own, k, percent)
    merged = None if links is None else cut(connected(links))
    wide = lambda rows, *more: labelled(rows, merged).join(reps, "doc").select("node", "doc", "n", "comp", "sig", *more)
    asked = cut(by_node(_in_order(wide(nodes)), lambda node, rows: _first_pass(node, rows, percent), "node long, doc long, other long, alike long, hub long"))
    # over all nodes, a row's closest row and the hub of most rows: two pairs a row at most
    best = asked.where("doc != other").groupBy("doc").agg(F.max_by("other", F.struct("alike", -F.col("other"))).alias("x"), F.max_by("other", F.struct("hub", "alike", -F.col("other"))).alias("y"))
    two = best.select("doc", F.explode(F.array_distinct(F.array("x", "y"))).alias("other"))
    pairs = cut(two.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = cut(full_sets(own.join(wanted, "doc", "left_semi"), k))
    found = cut(confirm(pairs, sets, percent))
    links = found if links is None else links.unionByName(found)
    merged = cut(connected(links))
    # nodes that proposed something and are still not one component
    left = nodes.join(asked.select("node").distinct(), "node", "left_semi")
    left = cut(left.join(mixed_nodes(left, merged), "node", "left_semi"))
    open_ = cut(by_node(_in_order(wide(left)), lambda node, rows: _open_rows(node, rows, percent), "node long, doc long"))
    exact = by_node(_in_order(wide(cut(once(open_))).join(sets, "doc").select("node", "doc", "n", "comp", "sig", "items")), lambda node, rows: _confirmed(node, rows, percent), "a long, b long")
    return links.unionByName(exact)


def grouped(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``rows`` (rid, doc_id, text), written with their rids -> rid, doc_id, n_shingles,
    component_id, kept."""
    own = rows.select(F.col("rid").alias("doc"), F.col("text").cast("string").alias("text"))
    sketch = cut(sketches(own, k))
    reps = cut(sketch.where("n > 0").groupBy(*CLASS).agg(F.min("doc").alias("doc"), F.min_by("sig", "doc").alias("sig")))
    found = cut(connected(links_of(reps.select("doc", "n", "sig"), own, k, percent)))
    named = labelled(reps.select(*CLASS, "doc"), found).select(*CLASS, "comp")
    of = sketch.select("doc", *CLASS).join(named, CLASS, "left").select(F.col("doc").alias("rid"), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("comp"))
    of = cut(of.join(rows.select("rid", "doc_id"), "rid"))
    first = of.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    return of.join(first, "comp").select("rid", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return grouped(numbered(docs.select("doc_id", "text")), k, percent).drop("rid")


def drop_near_copies(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component; columns unchanged."""
    name = free_name(docs, "rid")
    rows = cut(docs.withColumn(name, F.monotonically_increasing_id()))
    gone = cut(grouped(rows.select(F.col(name).alias("rid"), "doc_id", "text"), k, percent).where("not kept").select(F.col("rid").alias(name)))
    return rows.join(gone, name, "left_anti").select(*docs.columns)


def op3_near_dedup(spark, sf_dir):
    return near_groups(documents(spark, sf_dir), k=2)
