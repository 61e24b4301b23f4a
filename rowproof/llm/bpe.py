"""Byte-level BPE encoding and decoding, exact and linear in the text.

A text is split by the tokenizer's pattern; each piece is encoded on its own. The piece's
bytes are mapped to Latin-1, one Aho-Corasick pass finds the longest vocabulary token at
every offset, and the encoder walks over those: it takes the longest token that may stand
next to the previous one, tries shorter ones where it may not, and steps back one token
where none fits, never trying an offset twice. Whether two tokens may be adjacent in a
BPE result is decided from the merge tree and memoised. Pieces recur, so their ids are
memoised too: those of the last ``MEMO`` to twice as many distinct pieces in use per worker, so
that frequent ones stay while rare ones pass; pieces beyond ``KEPT`` characters are not kept.

The rank file is read by the driver and broadcast (under 1 MB); texts are encoded in Arrow
batches within each partition, with no shuffle.

Defined cases: a null or empty text has no tokens and decodes to no bytes; every text is
encoded whole, whatever its length; repeated rows, null ids and further columns pass
through, but one of a new column's name is replaced, and the new names can be chosen; an
empty table gives an empty result. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import documents

MEMO = 200_000
KEPT = 32
SLICE = 4 << 20  # bytes of text that a worker takes at once, or one longer text
_ARROW = {"binary": pa.binary(), "string": pa.string()}
RANKS = "byte_bpe_multi_50k.tiktoken"


class ByteBpe:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.token = {int(r): base64.b64decode(t) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        # \s of the pattern is Unicode White_Space, without the separators U+001C to U+001F
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks = {t: r for r, t in self.token.items()}
        self.longest = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            self.longest.add_word(t.decode("latin-1"), (r, len(t)))
        self.longest.make_automaton()
        self.shorter = {r: self._prefix(t) for t, r in self.ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.token):
            self.halves[rank] = self._split(rank)
        self.fits.clear()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the memo before this one
        self.bytes_of = pa.array([self.token.get(r) for r in range(max(self.token, default=-1) + 1)], pa.binary())

    def decode(self, ids: bytes) -> bytes:
        found = self.bytes_of.take(pa.array(np.frombuffer(ids, "<u4").astype("u4", copy=False)))
        if found.null_count:
            raise KeyError("an id without a token")
        values = found.buffers()[2]  # the tokens' bytes, one after the other
        return values.to_pybytes() if len(found) else b""

    def _prefix(self, token: bytes) -> int:
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), -1)

    def _split(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``rank``; a single byte is its own halves."""
        token, left = self.token[rank], self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[len(self.token[left]) :], rank)
            if left < rank and right < rank and self._adjacent(left, right):
                self.merged[left, right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` as neighbours: walking down the inner
        edges of both merge trees, newest merge first, no pair may have merged earlier
        than the merges that hid it."""
        hidden = 1 << 40
        while True:
            if self.merged.get((left, right), hidden) < hidden:
                return False
            if left > right:
                hidden, left = left, self.halves[left][1]
                if left == hidden:
                    hidden, right = right + 1, self.halves[right][0]
                    if right + 1 == hidden:
                        return True
            else:
                hidden, right = right + 1, self.halves[right][0]
                if right + 1 == hidden:
                    hidden, left = left, self.halves[left][1]
                    if left == hidden:
                        return True

    def adjacent(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[left, right] = self._adjacent(left, right)
        return known

    def piece(self, piece: bytes) -> array:
        """Token ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return array("I", (whole,))
        size, token, shorter = len(piece), self.token, self.shorter
        best = [-1] * size
        for end, (rank, n) in self.longest.iter(piece.decode("latin-1")):
            best[end - n + 1] = rank  # ends ascend, so the longest stays
        ids, ends, tried = array("I"), [0], bytearray(size + 1)
        at, take = 0, best[0]
        while at < size:
            end = at + len(token[take])
            if not tried[end] and (not ids or self.adjacent(ids[-1], take)):
                ids.append(take)
                ends.append(end)
                at = end
                take = best[at] if at < size else -1
            elif shorter[take] >= 0:
                take = shorter[take]
            else:
                tried[at] = 1
                take = ids.pop()
                ends.pop()
                at = ends[-1]
        return ids

    def kept(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers, from the memos or worked out."""
        ids = self.memo.get(piece)
        if ids is not None:
            return ids
        ids = self.older.get(piece)
        if ids is None:
            found = self.piece(piece.encode())
            if sys.byteorder == "big":
                found.byteswap()
            ids = found.tobytes()
        if len(piece) <= KEPT:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.find(text)
        out = list(map(self.memo.get, pieces))
        if None in out:
            out = [self.kept(p) if ids is None else ids for p, ids in zip(pieces, out, strict=True)]
        return b"".join(out)


_BUILT: dict[tuple[bytes, str], ByteBpe] = {}


def _bpe(rank_file: bytes, pattern: str) -> ByteBpe:
    """One coder at most per worker process, kept between tasks."""
    if (rank_file, pattern) not in _BUILT:
        _BUILT.clear()
        _BUILT[rank_file, pattern] = ByteBpe(rank_file, pattern)
    return _BUILT[rank_file, pattern]


def _slices(column: pa.Array, most: int = SLICE):
    """(first, number) of runs of rows with about ``most`` bytes together; a longer value alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(size.tolist()):
        if i > begin and total + n > most:
            yield begin, i - begin
            begin, total = i, 0
        total += n
    if len(size) > begin:
        yield begin, len(size) - begin


def _with_columns(df: DataFrame, source: str, made: dict[str, str], make, rank_path: str, pattern: str) -> DataFrame:
    """``df`` with ``source`` replaced by the columns ``made`` (name -> type), worked out by
    make(coder)(value) -> their values. Rows are taken a few MB of ``source`` at a time."""
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    taken = {c.lower() for c in (source, *made)}
    rest = [c for c in df.columns if c.lower() not in taken]
    schema = df.select(*rest, *[F.lit(None).cast(t).alias(c) for c, t in made.items()]).schema

    def run(batches):
        one = make(_bpe(ranks.value, pattern))
        for batch in batches:
            values = batch.column(len(rest))
            for first, n in _slices(values):
                found = [one(x.as_py()) for x in values.slice(first, n)]
                cols = [pa.array([x[i] for x in found], _ARROW[t]) for i, t in enumerate(made.values())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, n) for i in range(len(rest))), *cols], names=[*rest, *made])

    return df.select(*rest, source).mapInArrow(run, schema)


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``text_col`` replaced by ``ids_col`` (binary, little-endian uint32)."""
    return _with_columns(_texts(df, text_col), text_col, {ids_col: "binary"}, lambda coder: lambda x: (coder.encode(x),), rank_path, pattern)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with ``ids_col`` replaced by ``decoded_col`` (binary, the bytes of the text)."""
    return _with_columns(df, ids_col, {decoded_col: "binary"}, lambda coder: lambda x: (None if x is None else coder.decode(x),), rank_path, pattern)


def encode_decoded(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", sha_col: str = "decoded_sha256") -> DataFrame:
    """As ``encode``, with the SHA-256 of what the ids decode to: both ways in one worker, so
    that a task holds one vocabulary and never ships the decoded text."""

    def both(coder):
        def one(text):
            ids = coder.encode(text)
            return ids, hashlib.sha256(coder.decode(ids)).hexdigest()

        return one

    return _with_columns(_texts(df, text_col), text_col, {ids_col: "binary", sha_col: "string"}, both, rank_path, pattern)


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``."""
    coded = encode_decoded(docs.select("doc_id", "text"), rank_path, pattern)
    n, sha = (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    return coded.select("doc_id", n, sha, "decoded_sha256")


def default_tokenizer() -> tuple[str, str]:
    """(path of the rank file, pattern) of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op4_bpe(spark, sf_dir):
    return round_trip(documents(spark, sf_dir), *default_tokenizer())
