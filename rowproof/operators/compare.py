"""Comparison of one field, and the verdict over fields."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowproof.functions.dates import fmt_date, parse_date_any
from rowproof.functions.normalize import clean_name, norm_digits, norm_key, once, strip
from rowproof.functions.similarity import name_parts, name_similarity, strict_parts, strict_similarity

FIELDS = ("name", "father", "mother", "dob", "abc")
STATUSES = ("Match", "Close match", "Review", "Mismatch", "Missing", "Not compared")
VERDICTS = ("Verified", "Verified (minor differences)", "Needs review", "Mismatch", "Not in Excel", "No reg. no. in PDF")


@dataclass(frozen=True)
class Settings:
    day_first: bool = True
    match_threshold: float = 92.0
    review_threshold: float = 75.0
    ignore_titles: bool = True
    strict: bool = False

    def __post_init__(self):
        if self.review_threshold > self.match_threshold:
            raise ValueError("review_threshold must not exceed match_threshold")

    def with_threshold(self, **moved: float) -> Settings:
        """One threshold moved; the other is dragged along so that review stays at or below match."""
        if len(moved) != 1 or (name := next(iter(moved))) not in ("match_threshold", "review_threshold"):
            raise ValueError("move match_threshold or review_threshold")
        to = moved[name]
        other = {"review_threshold": min(self.review_threshold, to)} if name == "match_threshold" else {"match_threshold": max(self.match_threshold, to)}
        return replace(self, **moved, **other)


def _result(status, score=None, note=""):
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(status).alias("status"), (F.lit(score) if score is None or isinstance(score, float) else score).cast("double").alias("score"), as_column(note).alias("note"))


def prepared(field: str, value, settings: Settings):
    """The date or cleaned name that a value is compared by; worked out once as a column."""
    return parse_date_any(value, settings.day_first) if field == "dob" else clean_name(value, settings.ignore_titles)


def compare_field(field: str, doc, sheet, settings: Settings = Settings(), known=None):  # noqa: B008
    """struct(status, score, note, doc, sheet); the values as they are shown. ``known``: what
    ``prepared`` makes of both values, where these are columns already."""
    return compare_stripped(field, strip(doc), strip(sheet), settings, known)


def compare_stripped(field: str, p, e, settings: Settings, known=None):
    """``compare_field`` of two values that are stripped already."""
    if field == "abc":
        return once(F.struct(p.alias("p"), e.alias("e"), norm_digits(p).alias("a"), norm_digits(e).alias("b")), _compare_abc)
    empty = F.when((p == "") & (e == ""), _result("Missing", None, "Empty in both")).when(p == "", _result("Missing", None, "Not found in PDF")).when(e == "", _result("Missing", None, "Empty in Excel"))
    if field == "dob":
        x, y = known or (prepared(field, p, settings), prepared(field, e, settings))
        swapped = (F.year(x) == F.year(y)) & (F.month(x) == F.day(y)) & (F.day(x) == F.month(y))
        dates = F.when(x == y, _result("Match", 100.0, "Same date")).when(swapped, _result("Review", 0.0, "Day and month look swapped")).otherwise(_result("Mismatch", 0.0, "Different dates"))
        texts = F.when(norm_key(p) == norm_key(e), _result("Match", 100.0, "Same text")).otherwise(_result("Mismatch", 0.0, "Could not read one of the dates"))
        found = empty.when(x.isNotNull() & y.isNotNull(), dates).otherwise(texts)
        return found.withField("doc", F.coalesce(fmt_date(x), p)).withField("sheet", F.coalesce(fmt_date(y), e))
    alike = (strict_similarity if settings.strict else name_similarity)(p, e, settings.ignore_titles, known)

    def told(found):
        score = found["score"]
        status = F.when(score >= 100, "Match").when(score >= settings.match_threshold, "Close match").when(score >= settings.review_threshold, "Review").otherwise("Mismatch")
        return _result(status, score, found["note"])

    return empty.otherwise(once(alike, told)).withField("doc", p).withField("sheet", e)


def _compare_abc(x):
    p, e, a, b = (x[c] for c in "peab")
    found = F.when(a == "", _result("Not compared", None, "No ABC ID on the marksheet")).when(b == "", _result("Missing", None, "Empty in Excel")).when(a == b, _result("Match", 100.0, "Same ABC ID")).otherwise(_result("Mismatch", 0.0, "Different ABC ID"))
    return found.withField("doc", F.when(a != "", a).otherwise(p)).withField("sheet", F.when(b != "", b).otherwise(e))


PARTS = ("status", "score", "note", "doc", "sheet")


def _parts(*parts):
    return [c.cast("double" if p == "score" else "string") for p, c in zip(PARTS, parts, strict=True)]


def _first(*cases, otherwise):
    """(status, score, note) of the first of ``cases`` (condition, status, score, note) that holds."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    found = [as_column(c) for c in otherwise]
    for when, *parts in reversed(cases):
        found = [F.when(when, as_column(new)).otherwise(c) for new, c in zip(parts, found, strict=True)]
    return found


def compare_parts(field: str, p, e, settings: Settings, known=None, settled=None):
    """``compare_field`` of two values that are stripped already, a column a part, so that a query that asks
    for one, as counts do for statuses, works out no other; ``settled`` as ``name_parts`` has it."""
    if field == "abc":
        return _abc_parts(p, e)
    empty = (((p == "") & (e == ""), "Missing", None, "Empty in both"), (p == "", "Missing", None, "Not found in PDF"), (e == "", "Missing", None, "Empty in Excel"))
    if field == "dob":
        x, y = known or (prepared(field, p, settings), prepared(field, e, settings))
        dates, swapped = x.isNotNull() & y.isNotNull(), (F.year(x) == F.year(y)) & (F.month(x) == F.day(y)) & (F.day(x) == F.month(y))
        found = _first(
            *empty, (dates & (x == y), "Match", 100.0, "Same date"), (dates & swapped, "Review", 0.0, "Day and month look swapped"), (dates, "Mismatch", 0.0, "Different dates"),
            (norm_key(p) == norm_key(e), "Match", 100.0, "Same text"), otherwise=("Mismatch", 0.0, "Could not read one of the dates"),
        )
        return _parts(*found, F.coalesce(fmt_date(x), p), F.coalesce(fmt_date(y), e))
    x, y = known or (prepared(field, p, settings), prepared(field, e, settings))
    score, note = strict_parts(p, e, x, y) if settings.strict else name_parts(p, e, x, y, settled)
    told = lambda s: F.when(s >= 100, "Match").when(s >= settings.match_threshold, "Close match").when(s >= settings.review_threshold, "Review").otherwise("Mismatch")
    status = told(score) if settings.strict or settled is not None else once(score, told)
    return _parts(*_first(*empty, otherwise=(status, score, note)), p, e)


def _abc_parts(p, e):
    a, b = norm_digits(p), norm_digits(e)
    found = _first(
        (a == "", "Not compared", None, "No ABC ID on the marksheet"), (b == "", "Missing", None, "Empty in Excel"), (a == b, "Match", 100.0, "Same ABC ID"),
        otherwise=("Mismatch", 0.0, "Different ABC ID"),
    )
    return _parts(*found, F.when(a != "", a).otherwise(p), F.when(b != "", b).otherwise(e))


def overall(statuses):
    """Verdict of field statuses: an array, or a column each, which is compiled code."""
    each = lambda *names: reduce(or_, [s.isin(*names) for s in statuses])
    has = each if isinstance(statuses, list) else lambda *names: F.exists(statuses, lambda s: s.isin(*names))
    return (
        F.when(has("Mismatch"), "Mismatch").when(has("Review", "Missing") | ~has("Match", "Close match"), "Needs review")
        .when(has("Close match"), "Verified (minor differences)").otherwise("Verified")
    )
