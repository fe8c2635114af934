"""Queries on partial dates, times and their ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal as T
from ..functions.binding import let
from .registry import query, table


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1997-12-31'")
def date_range_filter(spark: SparkSession, sf_dir: str, term: str = "199506-1997") -> DataFrame:
    """Orders in a date range of partial dates. The bounds fold to constants, so the filter reaches the scan."""
    bounds = T.fixed_bounds(T.date_range(F.lit(term)))
    return table(spark, sf_dir, "orders").where(T.day_within(F.col("o_orderdate"), bounds)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-02-29'")
def date_range_open_lo(spark, sf_dir):
    return date_range_filter(spark, sf_dir, "-199602")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1999-03-07'")
def date_range_open_hi(spark, sf_dir):
    return date_range_filter(spark, sf_dir, "19990307-")


PARTIAL = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y%m%d') END"


def _partial(orders: DataFrame) -> DataFrame:
    form = lambda p: F.date_format("o_orderdate", p)
    text = F.when(F.col("o_orderkey") % 3 == 0, form("yyyy")).when(F.col("o_orderkey") % 3 == 1, form("yyyyMM")).otherwise(form("yyyyMMdd"))
    return orders.select("o_orderkey", text.alias("t"))


@query(f"""WITH p AS (SELECT o_orderkey, {PARTIAL} AS t FROM orders),
b AS (SELECT o_orderkey, t, make_date(CAST(t[1:4] AS INT), CASE WHEN length(t) > 4 THEN CAST(t[5:6] AS INT) ELSE 1 END, CASE WHEN length(t) > 6 THEN CAST(t[7:8] AS INT) ELSE 1 END) AS earliest FROM p)
SELECT o_orderkey, t, earliest, CASE length(t) WHEN 4 THEN CAST(earliest + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) WHEN 6 THEN last_day(earliest) ELSE earliest END AS latest FROM b""")
def partial_date_bounds(spark, sf_dir):
    p = F.col("p")
    rows = _partial(table(spark, sf_dir, "orders")).select("o_orderkey", "t", T.partial_date(F.col("t")).alias("p"))
    return rows.select("o_orderkey", "t", T.date_earliest(p).alias("earliest"), T.date_latest(p).alias("latest"))


@query(f"SELECT o_orderkey, length({PARTIAL}) = 8 AS is_precise, {PARTIAL} AS encoded FROM orders")
def partial_date_precision(spark, sf_dir):
    p = F.col("p")
    return _partial(table(spark, sf_dir, "orders")).select("o_orderkey", T.partial_date(F.col("t")).alias("p")).select("o_orderkey", T.date_is_precise(p).alias("is_precise"), T.encode_date(p).alias("encoded"))


@query("""WITH e AS (SELECT event_id, strftime(ts, '%H%M%S') || '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') AS full_text FROM events),
t AS (SELECT event_id, full_text[1:CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 9 ELSE 13 END] AS t FROM e)
SELECT event_id, t, length(t) = 13 AS is_precise,
  (CAST(t[1:2] AS BIGINT) * 3600 + CASE WHEN length(t) > 2 THEN CAST(t[3:4] AS BIGINT) ELSE 0 END * 60 + CASE WHEN length(t) > 4 THEN CAST(t[5:6] AS BIGINT) ELSE 0 END) * 1000000
    + CASE WHEN length(t) > 7 THEN CAST(rpad(t[8:], 6, '0') AS BIGINT) ELSE 0 END AS earliest,
  (CAST(t[1:2] AS BIGINT) * 3600 + CASE WHEN length(t) > 2 THEN CAST(t[3:4] AS BIGINT) ELSE 59 END * 60 + CASE WHEN length(t) > 4 THEN CAST(t[5:6] AS BIGINT) ELSE 59 END) * 1000000
    + CASE WHEN length(t) > 7 THEN CAST(rpad(t[8:], 6, '9') AS BIGINT) ELSE 999999 END AS latest FROM t""")
def time_partial_bounds(spark, sf_dir):
    n = F.element_at(F.array(*map(F.lit, (2, 4, 6, 9, 13))), (F.col("event_id") % 5 + 1).cast("int"))
    p = T.partial_time(F.col("t"))
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HHmmss.SSSSSS").substr(F.lit(1), n).alias("t"))
    return events.select("event_id", "t", T.time_is_precise(p).alias("is_precise"), T.time_earliest(p).alias("earliest"), T.time_latest(p).alias("latest"))


def micros_of_day(ts):
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long") * 1_000_000 + F.date_format(ts, "SSSSSS").cast("long")


@query("SELECT event_id, user_id FROM events WHERE CAST(strftime(ts, '%H%M') AS INT) BETWEEN 930 AND 1700")
def time_range_filter(spark, sf_dir):
    """Events from 09:30 to the end of the minute 17:00."""
    return table(spark, sf_dir, "events").where(T.within(micros_of_day(F.col("ts")), T.fixed_bounds(T.time_range(F.lit("0930-1700"))))).select("event_id", "user_id")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:29:59.999999'")
def datetime_range_combine(spark, sf_dir):
    bounds = T.fixed_bounds(T.combine_ranges(T.date_range(F.lit("20240105-20240120")), T.time_range(F.lit("06-1829"))))
    return table(spark, sf_dir, "events").where(T.within(F.col("ts"), bounds)).select("event_id", "ts")


@query("""WITH p AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 ELSE -300 END AS m FROM events)
SELECT event_id, ts - to_minutes(m) AS lo, date_trunc('hour', ts) - to_minutes(60) + INTERVAL '59 minutes 59.999999 seconds' AS hi_local FROM p""")
def datetime_tz_policy(spark, sf_dir):
    """An own offset counts; where there is none, the policy's does (here UTC, then an hour to the east)."""
    stamp = F.date_format("ts", "yyyyMMddHHmmss.SSSSSS")
    text = F.concat(stamp, F.element_at(F.array(*map(F.lit, ("", "+0530", "-0500"))), (F.col("event_id") % 3 + 1).cast("int")))
    hour = T.partial_datetime(F.date_format("ts", "yyyyMMddHH"))
    return table(spark, sf_dir, "events").select("event_id", let(T.partial_datetime(text), T.datetime_earliest).alias("lo"), let(hour, lambda p: T.datetime_latest(p, 60)).alias("hi_local"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d') || '-0500-' || strftime(ts + INTERVAL 1 DAY, '%Y%m%d') AS t,
CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 5 HOUR AS lo, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 2 DAY - INTERVAL 1 MICROSECOND AS hi FROM events""")
def datetime_range_dashes(spark, sf_dir):
    """Two dashes: the first can't separate here, so the second does."""
    text = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-0500-"), F.date_format(F.date_add(F.to_date("ts"), 1), "yyyyMMdd"))
    r = T.datetime_range(F.col("t"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("t")).select("event_id", "t", r.lo.alias("lo"), r.hi.alias("hi"))
