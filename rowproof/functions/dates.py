"""Dates written in any of five forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .normalize import SPACE, ascii_digits, once, strip, text

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


# The written forms of a date.
FORMS = {
    "year": r"\A(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[ T][^\n]*)?\z",
    "digits": rf"\A(\d{{1,2}})[-/.{SPACE}](\d{{1,2}})[-/.{SPACE}](\d{{2,4}})(?:[{SPACE}][^\n]*)?\z",
    "day": rf"\A(\d{{1,2}})(?:st|nd|rd|th)?[-/.{SPACE}]*([A-Za-z]{{3,}})[-/.,{SPACE}]*(\d{{2,4}})\z",
    "month": rf"\A([A-Za-z]{{3,}})[-.{SPACE}]*(\d{{1,2}})(?:st|nd|rd|th)?,?[-.{SPACE}]*(\d{{2,4}})\z",
    "serial": r"\A(\d{5})(?:\.\d+)?\z",
}


def _day(year, month, day):
    """The date, or null where there is none; the parts are whole numbers."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)).try_cast("date")


def parse_date_any(c, day_first: bool = True):
    """A date, or null: year first, day or month first, with a month's name, or a serial number.
    The first form that fits decides, but a name that is no month passes on to the next. 2001-02-03 and
    03-02-2001, of four digits for the year, are compiled code; all other forms are not."""
    t = text(c)
    a, b, year = F.substring(t, 1, 2), F.substring(t, 4, 2), F.substring(t, 7, 4)
    day_then = (a > "12") | (b <= "12") if day_first else (a > "12")
    digits = F.when(day_then, F.concat(year, F.lit("-"), b, F.lit("-"), a)).otherwise(F.concat(year, F.lit("-"), a, F.lit("-"), b))
    return (
        F.when(F.regexp_like(t, F.lit(r"\A\d{4}-\d\d-\d\d\z")), t.try_cast("date"))
        .when(F.regexp_like(t, F.lit(r"\A\d\d[-/.]\d\d[-/.][1-9]\d{3}\z")), digits.try_cast("date"))
        .otherwise(once(ascii_digits(strip(c)), lambda t: _parsed(t, day_first)))
    )


def _parsed(t, day_first: bool):
    has = {k: F.regexp_like(t, F.lit(form)) for k, form in FORMS.items()}
    # the groups of a form, matched once
    parts = lambda k, make: once(F.split(F.regexp_replace(t, FORMS[k], "$1/$2/$3"), "/"), make)
    number = lambda x: x.try_cast("int")
    year = lambda x: F.when(number(x) >= 100, number(x)).otherwise(number(x) + F.when(number(x) <= 30, 2000).otherwise(1900))
    named = lambda x: F.array_position(F.split(F.lit(MONTHS), " "), F.lower(F.substring(x, 1, 3))).cast("int")
    month_of = lambda k, g: named(F.regexp_extract(t, FORMS[k], g))

    def in_digits(x):
        a, b = number(x[0]), number(x[1])
        day_then = F.when(a > 12, True).when(b > 12, False).otherwise(day_first)
        return F.when(day_then, _day(year(x[2]), b, a)).otherwise(_day(year(x[2]), a, b))

    days = number(F.regexp_extract(t, FORMS["serial"], 1))
    return (
        F.when(has["year"], parts("year", lambda x: _day(number(x[0]), number(x[1]), number(x[2]))))
        .when(has["digits"], parts("digits", in_digits))
        .when(has["day"] & (month_of("day", 2) > 0), parts("day", lambda x: _day(year(x[2]), named(x[1]), number(x[0]))))
        .when(has["month"] & (month_of("month", 1) > 0), parts("month", lambda x: _day(year(x[2]), named(x[0]), number(x[1]))))
        .when(has["serial"] & days.between(10001, 79999), F.date_add(F.lit("1899-12-30").cast("date"), days))
    )


def fmt_date(d):
    return F.date_format(d, "dd-MM-y")
