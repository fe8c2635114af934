"""Queries on pixel transforms, tables, frames and fragments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import frames as R
from .registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2.0::DOUBLE - 1024.0::DOUBLE AS y FROM lineitem")
def rescale(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.rescale(F.col("l_quantity"), 2.0, -1024.0).alias("y"))


def _windowed(spark, sf_dir, f):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f(F.col("l_quantity"), F.lit(30.0), F.lit(20.0), 255.0).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN 0::DOUBLE WHEN l_quantity > 34 THEN 255::DOUBLE ELSE ((l_quantity - 19.5::DOUBLE) / 29::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE END AS y FROM lineitem""")
def window_linear(spark, sf_dir):
    return _windowed(spark, sf_dir, P.window_linear)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN 0::DOUBLE WHEN l_quantity > 35 THEN 255::DOUBLE ELSE ((l_quantity - 20::DOUBLE) / 30::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE END AS y FROM lineitem""")
def window_linear_exact(spark, sf_dir):
    return _windowed(spark, sf_dir, P.window_linear_exact)


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(255::DOUBLE / (1 + exp(-4 * (l_quantity - 20) / 30::DOUBLE))) AS INTEGER) AS y FROM lineitem")
def window_sigmoid(spark, sf_dir):
    rows = _windowed(spark, sf_dir, P.window_sigmoid)
    return rows.withColumn("y", F.col("y").cast("int"))


LUT_SQL = """SELECT i AS entry, CAST(trunc(CASE WHEN x <= -600 THEN 0::DOUBLE WHEN x > 399 THEN 255::DOUBLE ELSE ((x + 100.5::DOUBLE) / 999::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE END) AS INTEGER) AS value
FROM (SELECT i, CASE WHEN i >= 128 THEN i - 256 ELSE i END * 10::DOUBLE AS x FROM range(256) r(i))"""


def _lut(spark):
    return R.lut(spark, 8, True, lambda x: P.window_linear(P.rescale(x, 10.0), F.lit(1000.0), F.lit(-100.0), 255.0))


@query(f"WITH t AS ({LUT_SQL}), n AS (SELECT l_partkey & 255 AS entry, count(*) AS n FROM lineitem GROUP BY 1) SELECT t.entry, value, coalesce(n, 0) AS n FROM t LEFT JOIN n ON n.entry = t.entry")
def lut_build(spark, sf_dir):
    """All entries of a table, and how many samples each of them is for."""
    used = table(spark, sf_dir, "lineitem").groupBy(P.lut_index(F.col("l_partkey"), 8).cast("long").alias("entry")).agg(F.count("*").alias("n"))
    return _lut(spark).join(used, "entry", "left").select("entry", "value", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH t AS ({LUT_SQL.replace('-600', '-600')}) SELECT l_orderkey, l_linenumber, value FROM lineitem JOIN t ON entry = l_partkey & 255")
def lut_apply_broadcast(spark, sf_dir):
    return R.apply_lut(table(spark, sf_dir, "lineitem"), _lut(spark), "l_partkey", 8).select("l_orderkey", "l_linenumber", "value")


@query("SELECT p_partkey, CAST(CASE WHEN p_size <= 10 THEN 0 WHEN p_size >= 41 THEN 31 ELSE p_size - 10 END * 4 * 16 AS INTEGER) AS y FROM part")
def voi_lut_explicit(spark, sf_dir):
    entries = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i * 4)
    return table(spark, sf_dir, "part").select("p_partkey", P.explicit_lut(F.col("p_size"), 10, entries, 4).alias("y"))


@query("""WITH m AS (SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_suppkey)
SELECT l_orderkey, l_linenumber, CAST(trunc(CASE WHEN l_quantity <= (lo + hi) / 2 - 0.5::DOUBLE - (greatest(hi - lo, 1) - 1) / 2 THEN 0::DOUBLE WHEN l_quantity > (lo + hi) / 2 - 0.5::DOUBLE + (greatest(hi - lo, 1) - 1) / 2 THEN 65535::DOUBLE
ELSE ((l_quantity - ((lo + hi) / 2 - 0.5::DOUBLE)) / nullif(greatest(hi - lo, 1) - 1, 0) + 0.5::DOUBLE) * 65535::DOUBLE END) AS INTEGER) AS y FROM lineitem JOIN m USING (l_suppkey)""")
def normalize_minmax(spark, sf_dir):
    """Extremes are aggregated by key, map side first, and joined back; no group is brought together."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    ends = rows.groupBy("l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return rows.join(ends, "l_suppkey").select("l_orderkey", "l_linenumber", P.normalize(F.col("l_quantity"), F.col("lo"), F.col("hi"), 65535.0).cast("int").alias("y"))


@query("""WITH q AS (SELECT p_partkey, p_partkey % 256 AS y, (p_partkey * 7) % 256 - 128 AS b, (p_partkey * 13) % 256 - 128 AS r FROM part)
SELECT p_partkey, CAST(least(greatest(floor(y + 1.402::DOUBLE * r + 0.5::DOUBLE), 0), 255) AS INTEGER) AS red,
CAST(least(greatest(floor(y - (0.114::DOUBLE * 1.772::DOUBLE / 0.587::DOUBLE) * b - (0.299::DOUBLE * 1.402::DOUBLE / 0.587::DOUBLE) * r + 0.5::DOUBLE), 0), 255) AS INTEGER) AS green,
CAST(least(greatest(floor(y + 1.772::DOUBLE * b + 0.5::DOUBLE), 0), 255) AS INTEGER) AS blue FROM q""")
def ybr_to_rgb(spark, sf_dir):
    k = F.col("p_partkey")
    red, green, blue = P.ybr_to_rgb(k % 256, k * 7 % 256, k * 13 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", red.alias("red"), green.alias("green"), blue.alias("blue"))


@query("SELECT vec_id, list_transform(range(0, 64), lambda i: embedding[(i % 4) * 16 + i // 4 + 1]) AS x FROM embeddings")
def planar_interleave(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", P.interleave(F.col("embedding"), 4).alias("x"))


@query("SELECT vec_id, f AS frame, embedding[f * 16 + 1 : f * 16 + 16] AS x FROM embeddings, range(4) r(f)")
def frame_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("frame"))
    return rows.select("vec_id", "frame", P.frame(F.col("e"), 16, F.col("frame").cast("int")).cast("array<float>").alias("x"))


@query("""SELECT p_partkey, CAST(p_partkey % 32768 - 16384 + 32768 AS BIGINT) AS shifted, CAST(255 - p_size AS INTEGER) AS inverted, CAST(p_partkey % 65536 // 256 AS BIGINT) AS narrow, CAST(p_size * 257 AS INTEGER) AS wide,
list_transform(range(0, 8), lambda i: CAST((p_size >> CAST(i AS INT)) % 2 * 255 AS INTEGER)) AS bits FROM part""")
def bit_depths(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", P.signed_to_unsigned(k % 32768 - 16384).alias("shifted"), P.invert(s, 255).alias("inverted"), P.narrow(k % 65536).alias("narrow"), P.widen(s).alias("wide"), P.expand_bits(s).alias("bits"))


OFFSETS_SQL = "SELECT source, doc_id, CAST(coalesce(sum((n_chars + 1) // 2 * 2 + 8) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents"


def _offsets(spark, sf_dir):
    return R.offset_table(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars")).drop("n_chars")


@query(OFFSETS_SQL)
def basic_offset_table(spark, sf_dir):
    return _offsets(spark, sf_dir)


@query(f"""WITH o AS ({OFFSETS_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM o), s AS (SELECT source, k // 3 AS frame, min("offset") AS start FROM n GROUP BY ALL)
SELECT n.source, doc_id, n."offset", CAST(frame AS BIGINT) AS frame FROM n ASOF JOIN s ON n.source = s.source AND n."offset" >= s.start""")
def frame_from_bot(spark, sf_dir):
    """Three fragments a frame; each fragment finds its frame by its offset."""
    rows = _offsets(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    starts = rows.withColumn("frame", F.floor(k / 3)).groupBy("source", "frame").agg(F.min("offset").alias("start"))
    return R.frames_of_fragments(rows, starts, "source")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_tax END, CASE WHEN l_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, 1::DOUBLE) AS slope
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def functional_group_coalesce(spark, sf_dir):
    """An attribute from the frame, else the series, else the study, else its default."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    value = R.first_known(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax")), F.when(F.col("l_orderkey") % 2 == 0, F.col("o_totalprice")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")), F.lit(1.0))
    return rows.select("l_orderkey", "l_linenumber", value.alias("slope"))


@query("""SELECT o_orderkey, n, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 3 = 1 THEN n * 10 ELSE 7 END AS v FROM orders, range(3) r(n)""")
def multi_value_arity(spark, sf_dir):
    """No value: the default; as many as frames: each frame's own; else the first for all."""
    k = F.col("o_orderkey") % 3
    values = F.when(k == 0, F.array().cast("array<bigint>")).when(k == 1, F.array(*[F.lit(x).cast("long") for x in (0, 10, 20)])).otherwise(F.array(F.lit(7).cast("long"), F.lit(8).cast("long")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", values.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    return rows.select("o_orderkey", F.col("n").cast("long").alias("n"), R.by_frame(F.col("v"), F.col("n"), F.lit(3), F.lit(-1).cast("long")).alias("v"))
