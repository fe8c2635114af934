"""Dates and times of partial precision, and ranges of them.

A partial date is struct<y, m, d> and a partial time struct<h, mi, s, frac, prec>; components that are not given
are NULL. A time of day is a LONG of microseconds, so that second 60 survives. What can't be parsed is NULL.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .binding import let

DAY_US = 86_400_000_000
DATE = "struct<y:int,m:int,d:int>"
TIME = "struct<h:int,mi:int,s:int,frac:int,prec:int>"


def _digits(text: Column, start: int, n: int) -> Column:
    """INT of ``n`` characters if all are digits, else NULL."""
    part = F.substring(text, start, n)
    return F.when(part.rlike(rf"^[0-9]{{{n}}}$"), part).cast("int")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \x00]+$", "")


def partial_date(text: Column) -> Column:
    """From YYYY, YYYYMM or YYYYMMDD; a month or day that is not digits is left out with all that follows; one out of range is an error."""
    y, m, d = _digits(text, 1, 4), _digits(text, 5, 2), _digits(text, 7, 2)
    d = F.when(m.isNotNull(), d)
    bad = y.isNull() | ~F.coalesce(m.between(1, 12), F.lit(True)) | ~F.coalesce(d.between(1, 31), F.lit(True))
    return F.when(~bad, F.struct(y.alias("y"), m.alias("m"), d.alias("d"))).cast(DATE)


def _date(y: Column, m: Column, d: Column) -> Column:
    """DATE, NULL where the day is not in the month."""
    first = F.make_date(y, m, F.lit(1))
    return F.when(d <= F.dayofmonth(F.last_day(first)), F.date_add(first, d - 1))


def date_earliest(p: Column) -> Column:
    return _date(p.y, F.coalesce(p.m, F.lit(1)), F.coalesce(p.d, F.lit(1)))


def date_latest(p: Column) -> Column:
    m = F.coalesce(p.m, F.lit(12))
    return F.when(p.d.isNotNull(), _date(p.y, m, p.d)).otherwise(F.last_day(F.make_date(p.y, m, F.lit(1))))


def date_is_precise(p: Column) -> Column:
    return p.d.isNotNull()


def exact_date(text: Column) -> Column:
    """DATE of the first 8 characters; 4 or 6 alone are incomplete and NULL."""
    return let(partial_date(F.substring(text, 1, 8)), lambda p: F.when(p.d.isNotNull(), date_earliest(p)))


def encode_date(p: Column) -> Column:
    """YYYY[MM[DD]], as precise as it is."""
    return F.concat(F.lpad(p.y.cast("string"), 4, "0"), F.coalesce(F.lpad(p.m.cast("string"), 2, "0"), F.lit("")), F.coalesce(F.lpad(p.d.cast("string"), 2, "0"), F.lit("")))


def partial_time(text: Column) -> Column:
    """From HH[MM[SS[.F{1,6}]]]; second 60 is allowed; parts that are not digits are left out with all that follows."""
    h, mi, s = _digits(text, 1, 2), _digits(text, 3, 2), _digits(text, 5, 2)
    mi = F.when(h.isNotNull(), mi)
    s = F.when(mi.isNotNull(), s)
    frac = F.when(s.isNotNull(), F.nullif(F.regexp_extract(text, r"^\d{6}\.(\d{1,6})", 1), F.lit("")))
    bad = h.isNull() | (h > 23) | F.coalesce(mi > 59, F.lit(False)) | F.coalesce(s > 60, F.lit(False))
    return F.when(~bad, F.struct(h.alias("h"), mi.alias("mi"), s.alias("s"), frac.cast("int").alias("frac"), F.length(frac).alias("prec"))).cast(TIME)


def _unit(prec: Column) -> Column:
    """Microseconds of the last digit of a fraction."""
    return F.element_at(F.array(*[F.lit(10 ** (6 - p)).cast("long") for p in range(7)]), prec + 1)


def time_earliest(p: Column) -> Column:
    """Microseconds of the day."""
    whole = (p.h.cast("long") * 60 + F.coalesce(p.mi, F.lit(0))) * 60 + F.coalesce(p.s, F.lit(0))
    return whole * 1_000_000 + F.coalesce(p.frac * _unit(p.prec), F.lit(0))


def time_latest(p: Column) -> Column:
    whole = (p.h.cast("long") * 60 + F.coalesce(p.mi, F.lit(59))) * 60 + F.coalesce(p.s, F.lit(59))
    return whole * 1_000_000 + F.coalesce((p.frac + 1) * _unit(p.prec) - 1, F.lit(999_999))


def time_is_precise(p: Column) -> Column:
    return F.coalesce(p.prec == 6, F.lit(False))


def encode_time(p: Column) -> Column:
    two = lambda c: F.coalesce(F.lpad(c.cast("string"), 2, "0"), F.lit(""))
    return F.concat(two(p.h), two(p.mi), two(p.s), F.coalesce(F.concat(F.lit("."), F.lpad(p.frac.cast("string"), F.coalesce(p.prec, F.lit(1)), F.lit("0"))), F.lit("")))


def partial_datetime(text: Column) -> Column:
    """struct<date, time, offset_min> of a date, a time if the date is precise, and an offset ±HHMM (west up to 12 h, east up to 14 h)."""
    def parsed(split: Column) -> Column:
        clock, offset = F.substring(split.body, 9, 16), split.offset
        minutes = F.when(offset != "", F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int"))
        minutes = F.when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes)
        return F.struct(partial_date(split.body).alias("date"), F.when(clock != "", partial_time(clock)).alias("time"), minutes.alias("offset_min"), (clock != "").alias("timed"), (F.length(split.body) + F.length(offset) == F.length(split.text)).alias("whole"))

    def checked(p: Column) -> Column:
        good = p.whole & p.date.isNotNull() & F.coalesce(p.offset_min.between(-12 * 60, 14 * 60), F.lit(True)) & (~p.timed | p.time.isNotNull() & p.date.d.isNotNull())
        return F.when(good, F.struct(p.date.alias("date"), p.time.alias("time"), p.offset_min.alias("offset_min")))

    split = F.struct(text.alias("text"), F.regexp_extract(text, r"^([0-9.]+)", 1).alias("body"), F.regexp_extract(text, r"^[0-9.]+([+-][0-9]{4})$", 1).alias("offset"))
    return let(let(split, parsed), checked)


def multi(text: Column, parse: Callable[[Column], Column]) -> Column:
    """Array of ``parse`` of each backslash-separated value; NULL if any can't be parsed. An empty text has no values."""
    parsed = F.transform(F.filter(F.split(_trim(text), r"\\"), lambda v: text != ""), parse)
    return let(parsed, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), v))


def make_date(y: Column, m: Column | None = None, d: Column | None = None) -> Column:
    """A partial date of its components; NULL if one is out of range, or a day has no month."""
    none = F.lit(None).cast("int")
    m, d = none if m is None else m, none if d is None else d
    good = y.between(0, 9999) & F.coalesce(m.between(1, 12), F.lit(True)) & F.coalesce(d.between(1, 31), F.lit(True)) & (m.isNotNull() | d.isNull())
    return F.when(good, F.struct(y.alias("y"), m.alias("m"), d.alias("d"))).cast(DATE)


def make_time(h: Column, mi: Column | None = None, s: Column | None = None, frac: Column | None = None, prec: int | None = None) -> Column:
    """A partial time of its components; ``prec``: digits of the fraction. NULL if one is out of range, or one is given without the coarser."""
    none = F.lit(None).cast("int")
    mi, s, frac = (none if c is None else c for c in (mi, s, frac))
    good = h.between(0, 23) & F.coalesce(mi.between(0, 59), F.lit(True)) & F.coalesce(s.between(0, 60), F.lit(True)) & (mi.isNotNull() | s.isNull()) & (s.isNotNull() | frac.isNull())
    if prec is not None:
        good = good & F.coalesce(frac.between(0, 10**prec - 1), F.lit(True))
    return F.when(good, F.struct(h.alias("h"), mi.alias("mi"), s.alias("s"), frac.alias("frac"), F.when(frac.isNotNull(), F.lit(prec)).alias("prec"))).cast(TIME)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def show_date(p: Column) -> Column:
    """YYYY[-MM[-DD]]."""
    part = lambda c: F.coalesce(F.concat(F.lit("-"), _two(c)), F.lit(""))
    return F.concat(F.lpad(p.y.cast("string"), 4, "0"), part(p.m), part(p.d))


def show_time(p: Column) -> Column:
    """HH[:MM[:SS[.F]]]; a fraction of zero is one digit."""
    part = lambda c: F.coalesce(F.concat(F.lit(":"), _two(c)), F.lit(""))
    digits = F.when(p.frac == 0, "0").otherwise(F.lpad(p.frac.cast("string"), F.coalesce(p.prec, F.lit(1)), F.lit("0")))
    return F.concat(_two(p.h), part(p.mi), part(p.s), F.coalesce(F.concat(F.lit("."), digits), F.lit("")))


def show_datetime(p: Column) -> Column:
    """The date, the time and the offset ±HH:MM, as far as they are given."""
    minutes = F.abs(p.offset_min)
    offset = F.concat(F.when(p.offset_min < 0, " -").otherwise(" +"), _two(F.floor(minutes / 60)), F.lit(":"), _two(minutes % 60))
    return F.concat(show_date(p.date), F.coalesce(F.concat(F.lit(" "), show_time(p.time)), F.lit("")), F.coalesce(offset, F.lit("")))


def _instant(date: Column, micros: Column, offset: Column, local_min: int) -> Column:
    """TIMESTAMP_NTZ in UTC of a local date and time of day."""
    day = F.unix_date(date).cast("long") * DAY_US
    return F.timestamp_micros(day + micros - F.coalesce(offset, F.lit(local_min)).cast("long") * 60_000_000).cast("timestamp_ntz")


def datetime_earliest(p: Column, local_min: int = 0) -> Column:
    """In UTC; without an own offset that of ``local_min`` minutes is taken. The session's time zone must be UTC."""
    return _instant(date_earliest(p.date), F.coalesce(time_earliest(p.time), F.lit(0).cast("long")), p.offset_min, local_min)


def datetime_latest(p: Column, local_min: int = 0) -> Column:
    return _instant(date_latest(p.date), F.coalesce(time_latest(p.time), F.lit(DAY_US - 1)), p.offset_min, local_min)


def _ordered(lo: Column, hi: Column, good: Column) -> Column:
    """struct<lo, hi>; NULL where a bound is not valid or they are inverted."""
    return let(F.struct(lo.alias("lo"), hi.alias("hi"), good.alias("good")), lambda r: F.when(r.good & F.coalesce(r.lo <= r.hi, F.lit(True)), F.struct(r.lo.alias("lo"), r.hi.alias("hi"))))


def _bounds(left: Column, right: Column, parse, earliest, latest) -> Column:
    """struct<lo, hi> of two texts, of which one may be empty for an open bound."""
    ends = F.struct(left.alias("left"), right.alias("right"), let(parse(left), earliest).alias("lo"), let(parse(right), latest).alias("hi"))
    return let(ends, lambda e: _ordered(e.lo, e.hi, ((e.left == "") | e.lo.isNotNull()) & ((e.right == "") | e.hi.isNotNull()) & ((e.left != "") | (e.right != ""))))


def _range(text: Column, least: int, parse, earliest, latest) -> Column:
    text = _trim(text)
    return F.when(text.contains("-") & (F.length(text) >= least), _bounds(F.substring_index(text, "-", 1), F.regexp_replace(text, "^[^-]*-", ""), parse, earliest, latest))


def date_range(text: Column) -> Column:
    """struct<lo date, hi date> of ``A-B``, ``A-`` or ``-B``; an open bound is NULL; without a dash or inverted NULL."""
    return _range(text, 5, partial_date, date_earliest, date_latest)


def time_range(text: Column) -> Column:
    """struct<lo long, hi long>, microseconds of the day."""
    return _range(text, 3, partial_time, time_earliest, time_latest)


def datetime_range(text: Column, local_min: int = 0) -> Column:
    """struct<lo, hi> timestamps in UTC. A dash may separate or begin an offset to the west.

    One dash separates; of two, the first does, or the second where the first gives no valid range; of three, the
    middle one does; more are an error.
    """
    text = _trim(text)

    def chosen(parts: Column) -> Column:
        n = F.size(parts) - 1

        def between(left: int, right: int) -> Column:
            """Of the first ``left`` parts and the next ``right`` ones."""
            text_of = lambda start, count: F.array_join(F.slice(parts, start, count), "-")
            return _bounds(text_of(1, left), text_of(left + 1, right), partial_datetime, lambda p: datetime_earliest(p, local_min), lambda p: datetime_latest(p, local_min))

        return F.when(n == 1, between(1, 1)).when(n == 2, F.coalesce(between(1, 2), between(2, 1))).when(n == 3, between(2, 2))

    return F.when(F.length(text) >= 5, let(F.split(text, "-"), chosen))


def combine_ranges(dates: Column, times: Column) -> Column:
    """struct<lo, hi> timestamps of a date range and a time range; a missing time is the day's first or last; both dates missing is NULL."""

    def combined(r: Column) -> Column:
        lo = _instant(r.d.lo, F.coalesce(r.t.lo, F.lit(0).cast("long")), F.lit(0), 0)
        hi = _instant(r.d.hi, F.coalesce(r.t.hi, F.lit(DAY_US - 1)), F.lit(0), 0)
        return _ordered(lo, hi, r.d.lo.isNotNull() | r.d.hi.isNotNull())

    return let(F.struct(dates.alias("d"), times.alias("t")), combined)


def fixed_bounds(bounds: Column) -> tuple | None:
    """(lo, hi) of a struct<lo, hi> of constants, worked out here and now, so that a scan gets plain comparisons; None if not valid."""
    row = SparkSession.active().sql("SELECT 1").select(bounds.alias("r")).first()
    return None if row.r is None else (row.r.lo, row.r.hi)


def within(value: Column, bounds: tuple | None) -> Column:
    """Whether a value is within (lo, hi), of which one may be None."""
    if bounds is None:
        return F.lit(False)
    lo, hi = bounds
    return (value >= F.lit(lo) if lo is not None else F.lit(True)) & (value <= F.lit(hi) if hi is not None else F.lit(True)) & value.isNotNull()


def day_within(value: Column, bounds: tuple | None) -> Column:
    """Whether a DATE or timestamp is on one of the days from lo to hi."""
    if bounds is None:
        return F.lit(False)
    lo, hi = bounds
    midnight = lambda day: F.lit(datetime.datetime.combine(day, datetime.time())).cast("timestamp_ntz")
    return (value >= midnight(lo) if lo is not None else F.lit(True)) & (value < midnight(hi + datetime.timedelta(days=1)) if hi is not None and hi < datetime.date.max else F.lit(True)) & value.isNotNull()


def in_range(value: Column, bounds: Column) -> Column:
    """Whether ``value`` is within struct<lo, hi>; a NULL bound is open."""
    return value.isNotNull() & F.coalesce(let(bounds, lambda b: b.isNotNull() & F.coalesce(value >= b.lo, F.lit(True)) & F.coalesce(value <= b.hi, F.lit(True))), F.lit(False))
