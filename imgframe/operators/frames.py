"""Frames and fragments: offset tables, byte ranges, attribute precedence, look-up tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels

#: Bytes before each fragment's data.
ITEM_HEADER = 8


def even(n: Column) -> Column:
    return n + n % 2


#: Rows from which a running sum is worked out in parts of about so many.
PART_ROWS = 1_000_000


def offset_table(fragments: DataFrame, key: str, order: str, length: Column, part_rows: int = PART_ROWS) -> DataFrame:
    """``fragments`` with offset: bytes of all fragments of the key before this one, headers and padding included; a running sum.

    A key with many fragments does not go to one task: fragments are cut into parts by the value of ``order``, each
    part is summed by itself, and begins at the sum of those before it. Where ``order`` is no number there is one part.
    """
    size = even(length) + ITEM_HEADER
    if fragments.schema[order].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return fragments.withColumn("offset", _sum_before(size, Window.partitionBy(key).orderBy(order)))
    ends = fragments.agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    parts = -(-ends.n // part_rows)
    if parts <= 1:
        return fragments.withColumn("offset", _sum_before(size, Window.partitionBy(key).orderBy(order)))
    width = max(1, -(-(ends.high - ends.low + 1) // parts))
    rows = fragments.withColumn("_part", F.floor((F.coalesce(order, F.lit(ends.low)) - F.lit(ends.low)) / width).cast("long"))
    totals = rows.groupBy(key, "_part").agg(F.sum(size).alias("_size")).withColumn("_before", _sum_before(F.col("_size"), Window.partitionBy(key).orderBy("_part"))).drop("_size")
    own = _sum_before(size, Window.partitionBy(key, "_part").orderBy(order))
    rows = rows.withColumn("_own", own)
    joined = rows.join(totals.withColumnRenamed(key, "_key").withColumnRenamed("_part", "_of"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("offset", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before", "_key", "_of")


def _sum_before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def fragment_totals(fragments: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """(keys, n_fragments, total_bytes, encapsulated_bytes): bytes of data, and with a header for each fragment and its padding."""
    return fragments.groupBy(*keys).agg(F.count("*").alias("n_fragments"), F.sum(length).cast("long").alias("total_bytes"), F.sum(even(length) + ITEM_HEADER).cast("long").alias("encapsulated_bytes"))


def cut_fragments(frames: DataFrame, data: str, size: int = 0) -> DataFrame:
    """``frames`` with fragment (from 0) and data cut to pieces of ``size`` bytes, an odd size being one more; 0 is the whole frame.

    The last piece is filled with zeros to the full size, a whole frame to an even length.
    """
    size += size % 2
    n = F.octet_length(data)
    width = F.lit(size) if size else n + n % 2
    pieces = F.greatest(F.ceil(n / width), F.lit(1)).cast("int") if size else F.lit(1)
    rows = frames.withColumns({"_n": pieces, "_w": F.greatest(width, F.lit(0))}).withColumn("fragment", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    piece = F.substring(F.col(data), F.col("fragment") * F.col("_w") + 1, F.col("_w"))
    padded = F.unhex(F.rpad(F.hex(piece), F.col("_w") * 2, F.lit("0")))
    return rows.withColumn(data, F.when(F.col("_w") == 0, piece).otherwise(padded)).drop("_n", "_w")


def frames_of_fragments(fragments: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Fragments (key, offset, ...) with the frame whose start is the last at or before their offset.

    ``starts``: (key, frame, start). Both are put in one order by key and place, and the last start is carried
    forward: a range join in one sort, without comparing pairs.
    """
    a = fragments.withColumns({"_place": F.col("offset"), "_kind": F.lit(1), "_frame": F.lit(None).cast("long")})
    b = starts.select(key, F.col("start").alias("_place"), F.lit(0).alias("_kind"), F.col("frame").cast("long").alias("_frame"))
    carried = F.last("_frame", ignorenulls=True).over(Window.partitionBy(key).orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b, allowMissingColumns=True).withColumn("frame", carried).where("_kind = 1").drop("_place", "_kind", "_frame")


def lut(spark: SparkSession, bits: int, signed: bool, function) -> DataFrame:
    """(entry, value) of a table of 2^bits entries: ``function`` of the stored value, cut towards zero."""
    return spark.range(1 << bits).select(F.col("id").alias("entry"), function(pixels.stored_value(F.col("id"), bits, signed).cast("double")).cast("int").alias("value"))


def wide_bits(bits: int) -> int:
    """The power of two of bits, 8 at least, that holds so many."""
    return 8 if bits <= 8 else 16 if bits <= 16 else 32


def make_lut(spark: SparkSession, bits: int, signed: bool = False, rescale: tuple[float, float] = (1.0, 0.0), window: tuple[float, float, str] | None = None, table: tuple[int, list[int], int] | None = None, depth: int | None = None) -> DataFrame:
    """(entry, value) for samples of ``bits``: rescaled by (slope, intercept), then through a window or a table, if one is given.

    window: (center, width, function), onto 0 to 2^depth - 1; depth is that of ``wide_bits`` unless it is given as 8 or
    16. table: (first sample, entries, bits of an entry), shifted up to the depth.
    """
    if window and table:
        raise ValueError("a window or a table, not both")
    depth = wide_bits(bits) if depth is None else depth
    top = float(2**depth - 1)
    windows = {"LINEAR": pixels.window_linear, "LINEAR_EXACT": pixels.window_linear_exact, "SIGMOID": pixels.window_sigmoid}

    def value(x: Column) -> Column:
        x = pixels.rescale(x, *rescale)
        if window:
            return windows[window[2]](x, F.lit(float(window[1])), F.lit(float(window[0])), top)
        if table:
            first, entries, entry_bits = table
            return pixels.explicit_lut(x, first, F.array(*map(F.lit, entries)), depth - entry_bits)
        return x

    return lut(spark, bits, signed, value)


def apply_lut(rows: DataFrame, table: DataFrame, sample: str, bits: int) -> DataFrame:
    """``rows`` with value from a table of 2^bits entries, which is broadcast; bits may be 16 at most."""
    if bits > 16:
        raise ValueError(f"a table of 2^{bits} entries is no look-up table")
    entry = pixels.lut_index(F.col(sample), bits).cast("long")
    return rows.withColumn("entry", entry).join(F.broadcast(table), "entry").drop("entry")


def first_known(*levels: Column) -> Column:
    """The value of the first level that has one: root, per frame, shared, default."""
    return F.coalesce(*levels)


def by_frame(values: Column, frame: Column, n_frames: Column, default: Column) -> Column:
    """Of several values the frame's own, if there are as many as frames; else the first; the default for none."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) == 0, default).when(F.size(values) == n_frames, F.get(values, frame)).otherwise(F.get(values, F.lit(0)))
