"""Language identification by compression.

Every language gets a zstandard dictionary of raw content: excerpts of its training texts. A
text is cut into pieces of ``PIECE`` bytes, each piece is compressed with the dictionary of
every language, and the language whose pieces take the fewest bytes is chosen. Pieces keep
the dictionary in use through a long text, which would otherwise soon be described by its own
beginning. Letters are lower-cased first, as texts in capitals match nothing otherwise. Narrow
margins are rejected: the margin is the share of the second-best size that the best one saves,
and the least margin accepted is calibrated on excerpts that are in no dictionary, so that
``SURE`` of the accepted ones are right. Texts of a few words often take the same bytes in every
language; these ties are rejected too.

The dictionaries and the calibration come from a bounded sample of training rows: about
``ROWS`` rows a language, drawn by hash, with one excerpt of at most ``EXCERPT`` characters at a
hashed place of each; half of them fill dictionaries of at most ``DICTIONARY`` bytes. At most
``LANGUAGES`` languages, those with most training rows, are learnt. Every document is judged by
its whole text, in one pass without a shuffle.

Defined cases: a text that is null or holds no letter is ``und`` with score 0; so is every text
when nothing could be learnt; equal sizes go to the language with more training rows, then to
the smaller name, with margin 0 (rejected when there are others); with one language alone, texts
with a letter are of that language; documents without doc_id are held out (never learnt from);
rows that repeat are judged each; further columns of ``documents`` are never read; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, documents, free_name
from .words import texts

ROWS, EXCERPT, DICTIONARY, LANGUAGES = 800, 1024, 128 << 10, 256
PIECE, LEVEL, SURE = 4096, 6, 0.99
UNKNOWN = "und"


class Profiles:
    """The languages with their dictionaries, and the least margin that is accepted."""

    def __init__(self, languages: list[str], contents: list[bytes], least: float = 0.0):
        self.languages, self.contents, self.least, self._made = languages, contents, least, None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        if self._made is None:
            bare = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._made = []
            for content in self.contents:
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=bare)
                self._made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=bare).compress)
        return self._made

    def sizes(self, data) -> np.ndarray:
        """Compressed bytes of ``data`` in each language, over all its pieces."""
        parts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return np.array([sum(len(compress(x)) for x in parts) for compress in self._compressors()], float)

    def judge(self, data) -> tuple[int, float, float]:
        """(language, score, margin). The score is what the sizes, read as code lengths, leave to
        the language on a piece of average length."""
        size = self.sizes(data)
        best = int(size.argmin())  # the first of equals: languages come by training rows
        if len(size) == 1:
            return best, 1.0, 1.0
        pieces = -(-len(data) // PIECE)
        score = 1 / np.exp2(-8 * np.minimum((size - size[best]) / pieces, 100)).sum()
        second = np.partition(size, 1)[1]
        return best, float(score), float(1 - size[best] / second)


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", rows: int = ROWS) -> Profiles | None:
    """Profiles from the rows that are not held out; None without any."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), "text", F.xxhash64(id_col, "text").alias("h"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    spark = docs.sparkSession
    rates = spark.createDataFrame([(r["lang"], rows / r["count"]) for r in counts], "lang string, rate double")
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    drawn = known.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    drawn = drawn.select("lang", F.lower(F.substring(F.col("text"), place, F.lit(EXCERPT))).alias("text"), "h").orderBy("h", "text")
    by: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in drawn.limit(2 * rows * len(counts)).collect():
        by[r["lang"]].append(r["text"].encode())
    languages = [x for x, found in by.items() if found]
    learnt = Profiles(languages, [b"\n".join(by[x][::2])[-DICTIONARY:] or b" " for x in languages])
    learnt.least = _least_margin(learnt, [(k, x) for k, lang in enumerate(languages) for x in by[lang][1::2] if x])
    return learnt


def _least_margin(learnt: Profiles, probes: list[tuple[int, bytes]]) -> float:
    """The least margin above 0 from which ``SURE`` of the probes with it or more are right."""
    found = [(margin, best == k) for k, x in probes for best, _, margin in [learnt.judge(x)]]
    found = sorted((m, right) for m, right in found if m > 0)
    if not found:
        return 0.0
    margins, right = np.array([m for m, _ in found]), np.array([r for _, r in found], float)
    share = right[::-1].cumsum()[::-1] / np.arange(len(right), 0, -1)
    good = np.flatnonzero((share >= SURE) & np.r_[True, np.diff(margins) > 0])
    return float(margins[good[0]] if len(good) else margins[-1])


def identify(docs: DataFrame, learnt: Profiles | None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every row of ``docs``."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")).alias("text"))
    if learnt is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(True).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(learnt)

    def run(batches):
        know = held.value
        for batch in batches:
            data, off = texts(batch.column(2))
            view, found = memoryview(data), []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                best, score, margin = know.judge(view[i:j]) if j > i else (-1, 0.0, 0.0)
                narrow = best < 0 or len(know.languages) > 1 and (margin == 0 or margin < know.least)
                found.append((know.languages[best] if best >= 0 else UNKNOWN, score, margin, narrow))
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    return rows.mapInArrow(run, schema)


def keep_languages(docs: DataFrame, wanted: list[str], learnt: Profiles | None) -> DataFrame:
    """Rows of ``docs``, columns unchanged, whose text is surely of one of ``wanted``. Rows are told
    apart by a number of their own, so ids may repeat or be null."""
    rid = free_name(docs, "rid")
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()))
    sure = identify(rows.select(F.col(rid).alias("doc_id"), "text"), learnt).where(F.col("lang_pred").isin(list(wanted)) & ~F.col("rejected"))
    return rows.join(sure.select(F.col("doc_id").alias(rid)), rid, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def op12_languages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
