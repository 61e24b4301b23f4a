"""Text of typed spreadsheet cells: numbers, dates, times, durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .normalize import once, strip, text

# What is left out of a number format, and what makes it a date or a duration.
LITERALS = r'(?s)".*?"|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]'
DATE_LETTERS = r"(?<![_\\])[dmhysDMHYS]"
DURATION = r"(?i)\[hh?\](?::mm(?::ss(?:\.0*)?)?)?|\[mm?\](?::ss(?:\.0*)?)?|\[ss?\](?:\.0*)?"
DAY_MS, DAY_US = 86_400_000, 86_400_000_000


def _first_part(form):
    return F.get(F.split(form, ";"), F.lit(0))


def is_date_format(form):
    """Whether a number format shows a date or time."""
    return F.coalesce(F.regexp_like(F.regexp_replace(_first_part(form), LITERALS, ""), F.lit(DATE_LETTERS)), F.lit(False))


def is_duration_format(form):
    """Whether a number format counts hours, minutes or seconds beyond their clock."""
    return F.coalesce(F.regexp_like(_first_part(form), F.lit(DURATION)), F.lit(False))


def _two(x):
    return F.lpad(x.cast("long").cast("string"), 2, "0")


def _clock(ms):
    """HH:mm:ss, with six digits of a second's parts where there are any."""
    part = F.when(ms % 1000 != 0, F.concat(F.lit("."), F.lpad((ms % 1000 * 1000).cast("string"), 6, "0"))).otherwise("")
    return F.concat(_two(F.floor(ms / 3_600_000)), F.lit(":"), _two(F.floor(ms % 3_600_000 / 60_000)), F.lit(":"), _two(F.floor(ms % 60_000 / 1000)), part)


def _duration(value):
    us = F.rint(value * DAY_US).cast("long")
    us = us - F.pmod(us, F.lit(1_000_000)) + F.rint(F.pmod(us, F.lit(1_000_000)) / 1000).cast("long") * 1000
    days, rest = F.floor(us / DAY_US), F.pmod(us, F.lit(DAY_US))
    part = F.when(rest % 1_000_000 != 0, F.concat(F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"))).otherwise("")
    clock = F.concat(F.floor(rest / 3_600_000_000).cast("string"), F.lit(":"), _two(F.floor(rest % 3_600_000_000 / 60_000_000)), F.lit(":"), _two(F.floor(rest % 60_000_000 / 1_000_000)), part)
    unit = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days != 0, F.concat(days.cast("string"), unit, clock)).otherwise(clock)


def serial_date_text(value, date1904, duration):
    """A serial number as yyyy-MM-dd, with the time where it has one; below 1 as a time of day. In
    the 1900 system numbers below 60 are a day later; dates outside the years 1 to 9999 are
    #VALUE!. ``date1904`` and ``duration`` are boolean columns."""
    day = F.floor(value)
    ms = F.rint((value - day) * 86400 * 1000).cast("long")
    early = (value > 0) & (value < 60) & ~date1904
    day = day + F.when(early, 1).otherwise(0) + F.floor(ms / DAY_MS)
    left = ms % DAY_MS
    start = F.when(date1904, F.lit("1904-01-01").cast("date")).otherwise(F.lit("1899-12-30").cast("date"))
    inside = day.between(-800_000, 3_000_000)
    date = F.date_add(start, F.when(inside, day).cast("int"))
    shown = F.when(inside & F.year(date).between(1, 9999), F.date_format(date, "yyyy-MM-dd"))
    whole = F.when(left < 1000, shown).otherwise(F.concat(shown, F.lit(" "), _clock(left)))
    return F.when(duration, _duration(value)).when((value >= 0) & (value < 1) & (ms < DAY_MS), _clock(ms)).otherwise(F.coalesce(whole, F.when(value.isNotNull(), "#VALUE!")))


LIMB = 10**9  # a natural number is its digits in groups of nine, the lowest first


def _over(a, b):
    return F.call_function("div", a, b)


def _times(limbs, factor, add=0):
    """limbs * factor + add, for a factor and a number of at most 2^32."""
    add = F.lit(add) if isinstance(add, int) else add
    start = F.struct(add.cast("long").alias("carry"), F.array().cast("array<bigint>").alias("done"))

    def step(state, limb):
        now = limb * factor + state["carry"]
        return F.struct(_over(now, F.lit(LIMB)).alias("carry"), F.concat(state["done"], F.array(now % LIMB)).alias("done"))

    return F.aggregate(limbs, start, step, lambda state: state["done"])


def _raised(limbs, base: int, group: int, power):
    """limbs * base^power; ``group`` powers are multiplied at once."""
    rounds = F.array_repeat(F.lit(0), _over(power, F.lit(group)).cast("int"))
    many = F.aggregate(rounds, limbs, lambda acc, _: _times(acc, F.lit(base**group).cast("long")))
    return _times(many, F.pow(F.lit(float(base)), (power % group).cast("double")).cast("long"))


def _limbs(number, n):
    """A number of at most 2^63 in ``n`` groups, as many as what it grows to needs."""
    high = _over(number, F.lit(LIMB))
    return F.concat(F.array(number % LIMB, high % LIMB, _over(high, F.lit(LIMB))), F.array_repeat(F.lit(0).cast("long"), (n - 3).cast("int")))


def _all_digits(value):
    """The digits of a whole double, from its 32-bit parts."""
    words = F.least(F.floor(F.log2(value) / 32) + 1, F.lit(31)).cast("int")
    parts = F.transform(F.sequence(words, F.lit(0), F.lit(-1)), lambda k: F.floor(value / F.pow(F.lit(2.0), 32.0 * k) % float(1 << 32)))
    limbs = F.aggregate(parts, _limbs(F.lit(0).cast("long"), words + 5), lambda acc, part: _times(acc, F.lit(1 << 32), part))
    return F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), r"\A0+(?=\d)", "")


def _beyond_half(value, n, place):
    """How the exact ``value`` lies to (n + 1/2) * 10^place: 1 above, 0 at, -1 below. Both are made
    whole and compared digit by digit."""
    k = F.lit(54) - F.floor(F.log2(value))
    some = F.floor(k / 2)
    whole = (value * F.pow(F.lit(2.0), some.cast("double")) * F.pow(F.lit(2.0), (k - some).cast("double"))).cast("long")
    n_limbs = F.when(value >= 1e-10, 8).otherwise(42)  # up to 10^72, 10^378
    left = _raised(_limbs(2 * whole, n_limbs), 10, 9, F.greatest(-place, F.lit(0)))
    right = _raised(_raised(_limbs(2 * n + 1, n_limbs), 10, 9, F.greatest(place, F.lit(0))), 2, 32, k)
    return once(F.struct(F.reverse(left).alias("a"), F.reverse(right).alias("b")), lambda x: F.when(x["a"] > x["b"], 1).when(x["a"] == x["b"], 0).otherwise(-1))


def _fifteen(value):
    """A positive double that is not whole, with 15 significant digits: the exact value is rounded,
    half to even. Its shortest text tells the digits unless the rest is near a half; only then
    the exact comparison runs."""
    part = lambda k: F.regexp_extract(value.cast("string"), r"\A([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?\z", k)
    told = F.struct(value.alias("v"), F.concat(part(1), part(2)).alias("all"), (F.length(part(1)) - 1 + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))).alias("e"))

    def digits(t):
        plain = F.regexp_replace(t["all"], r"\A0+", "")
        return F.struct(t["v"].alias("v"), F.rpad(F.substring(plain, 1, 15), 15, "0").cast("long").alias("n"), F.rpad(F.substring(plain, 16, 2), 2, "0").alias("next"), (t["e"] - F.length(t["all"]) + F.length(plain)).alias("e"))

    def rounded(t):
        side = once(_beyond_half(t["v"], t["n"], t["e"] - 14), lambda s: (s > 0) | ((s == 0) & (t["n"] % 2 == 1)))
        up = F.when(t["next"] < "38", False).when(t["next"] > "62", True).otherwise(side)  # the text lies within half a unit of the exact value's 53rd bit
        n = t["n"] + up.cast("int")
        return F.struct(F.regexp_replace(n.cast("string"), r"0+\z", "").alias("d"), (t["e"] + (n == 10**15).cast("int")).alias("e"))

    def shown(t):
        d, e = t["d"], t["e"]
        rest = lambda at: F.when(F.length(d) >= at, F.concat(F.lit("."), F.substr(d, at))).otherwise("")
        power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        return (
            F.when((e < -4) | (e >= 15), F.concat(F.substring(d, 1, 1), rest(F.lit(2)), power))
            .when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)).otherwise(F.concat(F.rpad(F.substr(d, F.lit(1), e + 1), e + 1, F.lit("0")), rest(e + 2)))
        )

    return once(once(once(told, digits), rounded), shown)


def number_text(value):
    """Whole numbers as all their digits, others with 15 significant digits; no number is blank.
    Built-in functions only. Below 2.3e-308, where doubles have fewer digits of their own, it is
    these that are shown."""
    size = F.abs(value)
    whole = value == F.rint(value)
    digits = F.when(size < 1e18, F.when(size < 1e18, size).cast("long").cast("string")).otherwise(_all_digits(size))
    shown = F.when(size == float("inf"), "inf").when(whole, digits).otherwise(_fifteen(size))
    return F.when(F.isnan(value) | value.isNull(), "").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), shown))


def cell_text(kind, number, words, form, date1904):
    """A typed cell as text. kind: s text, b boolean, e error, n number, anything else as text."""
    dated = (kind == "n") & (text(form) != "") & (form != "General") & is_date_format(form)
    shown = F.when(dated, serial_date_text(number, date1904, is_duration_format(form))).otherwise(number_text(number))
    return F.when(kind == "n", F.coalesce(shown, F.lit(""))).when(kind == "b", F.when(number != 0, "True").otherwise("False")).otherwise(strip(words))
