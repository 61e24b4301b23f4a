"""Normalisers of names, keys, labels and cell text, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import functions as F

# White space, title words, label words.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The same within a class of a pattern: those below 256 are one bit set, the others stand behind one range,
# as every range of a class is a test for each character that is none.
SPACE = r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
TITLES = ("MR", "MRS", "MS", "MISS", "DR", "SHRI", "SRI", "SMT", "KUMARI", "KUM", "LATE", "SHREE", "SHRIMATI")
NOT_A_NAME = "guardian|husband|institut|college|school|course|programme|program|exam|centre|center|university|parent|subject|paper"


def once(value, make):
    """make(value), with ``value`` worked out once however often it is used there."""
    return F.transform(F.array(value), make)[0]


def text(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c):
    return F.btrim(text(c), F.lit(WHITE))


def strip(c):
    """A text without outer white space. One that begins and ends with a visible ASCII character is told
    by comparisons and taken as it stands; ``trimmed`` is the same for what is costly to work out."""
    t = text(c)
    return F.when((t >= "!") & (t < "\x7f") & F.substring(t, -1, 1).between("!", "~"), t).otherwise(trimmed(c))


def squash(c):
    return F.regexp_replace(strip(c), rf"[{SPACE}]+", " ")


def _decomposed(c: str) -> str:
    """A character's compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII letter or digit, those letters, and a table of the
    characters that decompose to several characters with an ASCII letter among them."""
    single, several = {}, {}
    for c in map(chr, range(0x80, 0x20000)):
        plain = _decomposed(c)
        if plain != c and any(x.isascii() and x.isalnum() for x in plain):
            (single if len(plain) == 1 else several)[c] = plain
    return "".join(single), "".join(single.values()), several


@cache
def _digits() -> tuple[str, str]:
    """Decimal digits of other scripts, and what they stand for."""
    found = {c: str(unicodedata.digit(c)) for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd"}
    return "".join(found), "".join(found.values())


def is_ascii(t):
    return F.length(t) == F.octet_length(t)


def ascii_digits(c):
    """Decimal digits of any script as 0 to 9."""
    return F.when(is_ascii(c), c).otherwise(F.translate(c, *_digits()))


def strip_accents(c):
    """Letters as the ASCII letters that they decompose to, without combining marks; other
    characters stay. Built-in functions only."""
    return F.when(is_ascii(text(c)), text(c)).otherwise(once(text(c), _without_accents))


def _without_accents(t):
    one, plain, several = _plain_letters()
    # one literal, as a map of literals would be thousands of expressions to every rule of the planner
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{plain}" for c, plain in several.items())), F.lit("\x01"), F.lit("\x02"))
    spread = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    # a table tells whether there is any: a class of a pattern would be tested one character after the other
    wide = F.when(F.length(F.translate(t, "".join(several), "")) != F.length(t), spread).otherwise(t)
    return F.when(is_ascii(t), t).otherwise(F.translate(F.regexp_replace(wide, r"\p{M}+", ""), one, plain))


def clean_name(c, ignore_titles: bool = True):
    """Words of A to Z, without titles. No lambda but for accents: those are not compiled."""
    letters = F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z]+", " ")
    return F.trim(F.regexp_replace(letters, rf"\b(?:{'|'.join(TITLES)})\b ?", "") if ignore_titles else letters)


def norm_key(c):
    """Upper-case letters and digits; 2.516E+11 and 123.0 are read as the numbers they stand for,
    whatever the exponent. One that no int holds leaves the text as it stands: no column could
    hold so many digits. Keys that are such letters and digits already are compiled code."""
    return F.when(F.regexp_like(text(c), F.lit(r"\A[A-Z0-9]*+\z")), text(c)).otherwise(once(F.upper(strip(c)), _key_of))


def _key_of(t):
    numeral = F.regexp_like(t, F.lit(r"\A\p{Nd}+(?:\.\p{Nd}+)?E\+\p{Nd}+\z"))
    plain = F.regexp_replace(F.regexp_replace(t, r"\A(\p{Nd}+)\.0+\z", "$1"), "[^A-Z0-9]", "")
    return F.when(numeral, F.coalesce(once(ascii_digits(t), _shifted), plain)).otherwise(plain)


def _shifted(t):
    """The whole digits of 2.516E+11."""
    part = lambda k: F.regexp_extract(t, r"\A([0-9]+)(?:\.([0-9]+))?E\+([0-9]+)\z", k)
    return F.regexp_replace(F.rpad(F.concat(part(1), part(2)), F.length(part(1)) + part(3).try_cast("int"), F.lit("0")), r"\A0+(?=\d)", "")


def norm_digits(c):
    return F.when(F.regexp_like(text(c), F.lit(r"\A[0-9]*+\z")), text(c)).otherwise(F.regexp_replace(norm_key(c), "[^0-9]", ""))


def label_field(c):
    """The field that a label names, or null."""
    return once(F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z]+", " ")), _field_of)


def _field_of(t):
    has = lambda pattern: F.regexp_like(t, F.lit(pattern))
    return (
        F.when(has("mother"), "mother").when(has("father"), "father").when(has("birth") | t.isin("dob", "d o b"), "dob")
        .when(has(r"regist|enrol|\Areg(?: no| number)?\z"), "reg").when(has(r"\babc\b|\bapaar\b"), "abc")
        .when(has("name") & ~has(NOT_A_NAME), "name")
    )


# What a value of a field looks like, a line "label : value", a label with a value.
VALUE_FORMS = {
    "reg": r"[A-Za-z0-9/\-]{4,}",
    "dob": rf"\p{{Nd}}{{1,4}}[\-/.{SPACE}][\p{{L}}\p{{N}}_]{{1,9}}[\-/.{SPACE},]*\p{{Nd}}{{2,4}}",
    "abc": rf"\p{{Nd}}[\p{{Nd}}{SPACE}\-]{{6,}}\p{{Nd}}",
}
LINE_FORM = rf"\A([^:：\n]{{2,60}}[{SPACE}]*)[:：]([^\n]*)\z"  # of a stripped line; both parts are stripped after it
LABEL_FORM = rf"\A([^\n]{{2,60}}?)[{SPACE}]*[:：][{SPACE}]*([^\n]+)\n?\z"


def clean_value(field: str, c):
    """What a document prints as a field's value, cut to the part that is the value."""
    t = strip(c)
    if field not in VALUE_FORMS:
        return F.regexp_replace(t, r"\A[ .,:;]+|[ .,:;]+\z", "")
    part = F.regexp_extract(t, f"({VALUE_FORMS[field]})", 1)
    part_shown = F.regexp_replace(part, r"\P{Nd}", "") if field == "abc" else part
    return F.when(part != "", part_shown).otherwise(t)


def parse_cell(c):
    """Lines of a cell as array<struct<label, field, value>>; blank lines are left out."""
    lines = F.filter(F.transform(F.split(text(c), r"[\r\n]+"), strip), lambda x: x != "")

    def told(label, value):
        return F.struct(label.alias("label"), label_field(label).alias("field"), value.alias("value"))

    def entry(x):
        plain = F.struct(F.lit("").alias("label"), F.lit(None).cast("string").alias("field"), x.alias("value"))
        both = F.struct(*[trimmed(F.regexp_extract(x, LINE_FORM, k)).alias(n) for k, n in ((1, "label"), (2, "value"))])
        return F.when(F.regexp_like(x, F.lit(LINE_FORM)), once(both, lambda b: told(b["label"], b["value"]))).otherwise(plain)

    return F.transform(lines, entry)


def row_label(sheet, row_no):
    return F.when(text(sheet) != "", F.concat(sheet, F.lit("!"), row_no.cast("string"))).otherwise(row_no.cast("string"))
