"""Column functions against vectors written down by hand."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgframe.functions import person, tags, temporal, values
from imgframe.operators.matching import QueryError, Term, literal, predicate


def evaluate(spark, inputs, *columns):
    """The columns' values for each input text ``x``, in order."""
    frame = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [tuple(r)[1:] for r in frame.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


@pytest.fixture
def X(spark):
    return F.col("x")

D = dt.date


def test_date_ranges(spark, X):
    cases = {
        "-19900201": (None, D(1990, 2, 1)),
        "-202002": (None, D(2020, 2, 29)),
        "-0020": (None, D(20, 12, 31)),
        "0002-": (D(2, 1, 1), None),
        "000203-": (D(2, 3, 1), None),
        "0002-202002  ": (D(2, 1, 1), D(2020, 2, 29)),
        "2021-2020": None,
        "0002": None,
        "0002x": None,
        " 2010-2020": None,
        "-": None,
        None: None,
    }
    got = evaluate(spark, list(cases), temporal.date_range(X))
    assert [None if r is None else tuple(r) for (r,) in got] == list(cases.values())


def test_time_ranges(spark, X):
    us = lambda h, m, s, f: ((h * 60 + m) * 60 + s) * 1_000_000 + f
    cases = {"-101010.123456789": (None, us(10, 10, 10, 123456)), "-101010.123 ": (None, us(10, 10, 10, 123999)), "-01 ": (None, us(1, 59, 59, 999999)), "101010.123-": (us(10, 10, 10, 123000), None), "1010-": (us(10, 10, 0, 0), None), "00-": (0, None), "24-": None, "105960-": (us(10, 59, 60, 0), None)}
    assert [None if r is None else tuple(r) for (r,) in evaluate(spark, list(cases), temporal.time_range(X))] == list(cases.values())


def test_datetime_ranges(spark, X):
    t = dt.datetime
    cases = {
        "-20200229153420.123": (None, t(2020, 2, 29, 15, 34, 20, 123999)),
        "-2020022915": (None, t(2020, 2, 29, 15, 59, 59, 999999)),
        "-202002": (None, t(2020, 2, 29, 23, 59, 59, 999999)),
        "00021231-": (t(2, 12, 31), None),
        "19900101+0500-1999+1400": (t(1989, 12, 31, 19), t(1999, 12, 31, 9, 59, 59, 999999)),
        "19900101-0500-1999-1200": (t(1990, 1, 1, 5), t(2000, 1, 1, 11, 59, 59, 999999)),
        "19900101-1200-1999": (t(1990, 1, 1, 12), t(1999, 12, 31, 23, 59, 59, 999999)),
        "0050-0500-1000": (t(50, 1, 1), t(501, 1, 1, 9, 59, 59, 999999)),
        "0001-00021231-2021-0100-0100": None,
        "00021231+0500": None,
    }
    assert [None if r is None else tuple(r) for (r,) in evaluate(spark, list(cases), temporal.datetime_range(X))] == list(cases.values())


def test_partial_dates(spark, X):
    cases = {"20180101": (2018, 1, 1), "201801xxxx": (2018, 1, None), "2018xxxx": (2018, None, None), "19140": (1914, None, None), "1914121": (1914, 12, None), "20210229": (2021, 2, 29), "19021515": None, "19021200": None, "19021232": None, "": None, None: None}
    got = evaluate(spark, list(cases), temporal.partial_date(X), temporal.exact_date(X), temporal.encode_date(temporal.partial_date(X)))
    assert [None if r[0] is None else tuple(r[0]) for r in got] == list(cases.values())
    assert [r[1] for r in got] == [D(2018, 1, 1)] + [None] * 10
    assert [r[2] for r in got][:3] == ["20180101", "201801", "2018"]


def test_partial_times(spark, X):
    cases = {"10": (10, None, None, None, None), "101": (10, None, None, None, None), "0755": (7, 55, None, None, None), "075501.5": (7, 55, 1, 5, 1), "075501.123": (7, 55, 1, 123, 3), "075501.9999994": (7, 55, 1, 999999, 6), "105960": (10, 59, 60, None, None), "24": None, "1061": None}
    got = evaluate(spark, list(cases), temporal.partial_time(X))
    assert [None if r is None else tuple(r) for (r,) in got] == list(cases.values())


def test_names(spark, X):
    cases = {"Adams^John": "John Adams", "^^^Rev.": "Rev.", "^^^^B.A. M.Div.": "B.A. M.Div.", "^^Robert": "Robert", "Adams^John^Robert^Rev.^B.A. M.Div.": "Rev. John Robert Adams B.A. M.Div.", "": ""}
    got = evaluate(spark, list(cases), person.format_name(person.name_parts(X)), person.display_name(person.name_parts(X)))
    assert got == [(k, v) for k, v in cases.items()]


def test_tags(spark, X):
    cases = {"(7FE0,0010)": 0x7FE00010, "0010,21C0": 0x001021C0, "7fe00010": 0x7FE00010, "": None, "1111,2222,3333": None, "0080 0010": None, "(0000.0600)": None, "OPERATORSNAME": None, None: None}
    assert [r for (r,) in evaluate(spark, list(cases), tags.parse_tag(X))] == list(cases.values())


def test_selectors(spark, X):
    cases = {"A[2].(0008,0100)": "(0040,A730)[2].(0008,0100)", "A.0008,0100": "(0040,A730)[0].(0008,0100)", "0008,0100": "(0008,0100)", "A[1]": None, "B.0008,0100": None, "": None}
    assert [r for (r,) in evaluate(spark, list(cases), tags.format_selector(tags.parse_selector(X, {"A": 0x0040A730})))] == list(cases.values())


def test_numbers(spark, X):
    cases = {" 12 \\x": (12, 12.0), "1e3": (None, 1000.0), "-.5": (None, -0.5), "x": (None, None), "99999999999999999999": (None, 1e20), "": (None, None), None: (None, None)}
    assert evaluate(spark, list(cases), values.to_int(X), values.to_float(X)) == list(cases.values())


def test_terms():
    assert Term.parse("a=b=c") == Term("a", "b=c")
    assert literal(" 7", "US") == 7
    for bad in (("70000", "US"), ("x", "FL"), ("1", "OB")):
        with pytest.raises(QueryError):
            literal(*bad)
    with pytest.raises(QueryError):
        Term.parse("=x")


def test_wildcards(spark, X):
    cases = ["a.b", "axb", "a\nb", "ab", None]
    got = [r for (r,) in evaluate(spark, cases, predicate(X, "LO", "a?b"))]
    assert got == [True, True, True, False, None]
    assert [r for (r,) in evaluate(spark, cases, predicate(X, "LO", "a.*"))] == [True, False, False, False, None]


def test_bytes_of_floats(spark):
    """Every kind of number: denormal, largest, not finite, both zeros; and those that are rounded to four bytes."""
    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1e308, 1.7976931348623157e308, 2.2250738585072014e-308, 2.225073858507201e-308, 5e-324, -5e-324, 3.4028234663852886e38, 1e39, 1e-40, 1.401298464324817e-45, 1e-46, float("inf"), float("-inf"), float("nan"), 2.0**-1022, 2.0**1023, 8.0, 1 - 2.0**-53, 1 + 2.0**-52]
    row = spark.createDataFrame([(numbers,)], "v array<double>").select(values.float_bytes(F.col("v"), 8).alias("d"), values.float_bytes(F.col("v"), 4).alias("s")).first()
    assert bytes(row.d) == struct.pack(f"<{len(numbers)}d", *numbers)
    with np.errstate(over="ignore"):
        assert bytes(row.s) == np.array(numbers).astype("<f4").tobytes()
    with pytest.raises(ValueError, match="2 bytes"):
        values.float_bytes(F.col("v"), 2)
