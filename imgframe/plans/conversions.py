"""Queries on conversions of values, dates, times and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import person, pixels, temporal, values
from ..operators import elements as E
from ..operators import frames as R
from ..operators import images as I
from ..operators import meta as M
from .registry import query, table

SL = "chr(92)"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE [p_partkey, p_size] END AS ints, CASE WHEN p_partkey % 3 = 2 OR p_partkey > 255 THEN NULL ELSE [p_partkey, p_size] END AS bytes,
CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE [p_partkey + 0.5::DOUBLE, p_size::DOUBLE] END AS floats, CASE WHEN p_partkey <= 32767 THEN p_partkey END AS small FROM part""")
def multi_numbers(spark, sf_dir):
    """All values of a text; one that is no number, or out of range, spoils all."""
    k = F.col("p_partkey")
    text = F.concat(k, F.lit("\\ "), "p_size", F.when(k % 3 == 2, "\\x").otherwise(""))
    real = F.concat(k, F.lit(".5\\"), "p_size", F.when(k % 3 == 2, "\\x").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", values.to_multi_int(text).alias("ints"), values.to_multi_int(text, "u8").alias("bytes"), values.to_multi_float(real).alias("floats"), values.to_narrow_int(k.cast("string"), "i16").alias("small"))


LE32 = "upper(lpad(to_hex(x & 255), 2, '0') || lpad(to_hex(x >> 8 & 255), 2, '0') || lpad(to_hex(x >> 16 & 255), 2, '0') || lpad(to_hex(x >> 24 & 255), 2, '0'))"


@query(f"SELECT p_partkey, upper(hex(encode(p_name || {SL} || p_brand))) AS text, (SELECT string_agg({LE32}, '' ORDER BY i) FROM (VALUES (0, CAST(p_partkey AS BIGINT)), (1, CAST(p_size AS BIGINT)), (2, 4294967294)) v(i, x)) AS numbers FROM part")
def value_bytes(spark, sf_dir):
    """Values as bytes: joined text, and whole numbers with the lowest byte first."""
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(values.text_bytes(F.array("p_name", "p_brand"))).alias("text"), F.hex(values.number_bytes(F.array(F.col("p_partkey"), F.col("p_size").cast("long"), F.lit(-2).cast("long")), 4)).alias("numbers"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS strict, CASE c_custkey % 3 WHEN 0 THEN c_name || '|2.5' WHEN 1 THEN c_name || '|2' ELSE c_name || '|2.5' END AS floats, CASE WHEN c_custkey % 3 = 0 THEN c_name || '|x' END AS texts FROM customer""")
def extend_kinds(spark, sf_dir):
    """Values of one kind with more of another at the end."""
    k = F.col("c_custkey") % 3
    held = F.when(k == 0, "text").when(k == 1, "int").otherwise("float")
    v = F.array("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(values.strict(v, held, "text"), F.lit(0)).alias("strict"), F.array_join(values.extend_as(v, held, "float", F.lit(2.5)), "|").alias("floats"), F.array_join(values.extend_as(v, held, "text", F.lit("x")), "|").alias("texts"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS exact, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS n_dates, strftime(o_orderdate, '%Y') || ' | ' || strftime(o_orderdate, '%Y%m%d') AS made FROM orders""")
def date_display(spark, sf_dir):
    """Dates of several values, made of components, shown and encoded."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    both = F.concat(day, F.lit("\\"), F.substring(day, 1, 6), F.when(F.col("o_orderkey") % 2 == 1, "\\x").otherwise(""))
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", temporal.multi(both, temporal.partial_date).alias("n"), temporal.partial_date(day).alias("p"), temporal.make_date(y, m).alias("ym"), temporal.make_date(y).alias("y"), temporal.make_date(y, m, d).alias("ymd"))
    return rows.select("o_orderkey", temporal.show_date(F.col("p")).alias("exact"), temporal.show_date(F.col("ym")).alias("month"), F.when(F.col("n").isNotNull(), F.size("n")).alias("n_dates"), F.concat(temporal.encode_date(F.col("y")), F.lit(" | "), temporal.encode_date(F.col("ymd"))).alias("made"))


@query("""SELECT event_id, strftime(ts, '%H:%M:%S') || CASE WHEN event_id % 10 = 0 THEN '.0' ELSE '.0' || event_id % 10 END AS shown, strftime(ts, '%H:%M') AS made, strftime(ts, '%Y-%m-%d %H:%M') || ' -03:30' AS instant FROM events""")
def time_display(spark, sf_dir):
    clock = F.date_format("ts", "HHmmss")
    text = F.concat(clock, F.lit(".0"), F.col("event_id") % 10)
    whole = F.concat(F.date_format("ts", "yyyyMMddHHmm"), F.lit("-0330"))
    rows = table(spark, sf_dir, "events").select("event_id", temporal.partial_time(text).alias("t"), temporal.make_time(F.hour("ts"), F.minute("ts")).alias("m"), temporal.partial_datetime(whole).alias("d"))
    return rows.select("event_id", temporal.show_time(F.col("t")).alias("shown"), temporal.show_time(F.col("m")).alias("made"), temporal.show_datetime(F.col("d")).alias("instant"))


@query("SELECT c_custkey, c_name || '^^^Dr.' AS text, 'Dr. ' || c_name AS shown FROM customer")
def pn_build(spark, sf_dir):
    name = person.make_name(family=F.col("c_name"), prefix=F.lit("Dr."), middle=F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("n")).select("c_custkey", person.format_name(F.col("n")).alias("text"), person.display_name(F.col("n")).alias("shown"))


@query("""SELECT c_custkey AS instance, '(0008,0005)' AS path, 'ISO_IR 192' AS text FROM customer UNION ALL SELECT c_custkey, '(0010,0010)', c_name FROM customer""")
def to_utf8(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("cs", F.when(F.col("c_custkey") % 2 == 0, "ISO_IR 100"))
    elements = E.elements_of(rows, "c_custkey", {"cs": (0x00080005, "CS"), "c_name": (0x00100010, "PN")})
    return E.convert_to_utf8(elements).select("instance", "path", F.array_join("values", "\\").alias("text"))


@query("SELECT source, count(*) AS n_fragments, CAST(sum(n_chars) AS BIGINT) AS total_bytes, CAST(sum((n_chars + 1) // 2 * 2 + 8) AS BIGINT) AS encapsulated_bytes FROM documents GROUP BY source")
def fragment_totals(spark, sf_dir):
    return R.fragment_totals(table(spark, sf_dir, "documents").select("source", "n_chars"), ["source"], F.col("n_chars"))


@query("""SELECT c_custkey, CAST(f AS INTEGER) AS fragment, rpad(upper(hex(encode(c_name)))[f * 12 + 1 : f * 12 + 12], 12, '0') AS data FROM customer, range(0, 20) r(f) WHERE f * 6 < strlen(c_name)""")
def cut_fragments(spark, sf_dir):
    """Frames cut to fragments of five bytes, which is made six; the last is filled with zeros."""
    frames = table(spark, sf_dir, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("data"))
    return R.cut_fragments(frames, "data", 5).select("c_custkey", "fragment", F.hex("data").alias("data"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size > 0 THEN p_size END AS n, CASE WHEN p_size % 3 = 0 AND p_size > 0 THEN -5 END AS first, CASE WHEN p_size % 3 = 0 AND p_size > 0 THEN 12 END AS bits, p_partkey % 2 = 0 AS monochrome, CASE WHEN p_partkey % 4 < 3 THEN ['MONOCHROME1', 'RGB', 'MONOCHROME2'][p_partkey % 4 + 1] END AS known FROM part""")
def lut_descriptor(spark, sf_dir):
    """Descriptors of look-up tables that fit their data, and kinds of images."""
    k, n = F.col("p_partkey"), F.col("p_size")
    given = F.array(n, F.lit(-5), F.when(n % 3 == 1, 17).otherwise(12))
    found = pixels.lut_descriptor(given, F.when(n % 3 == 2, n + 1).otherwise(n))
    kind = F.element_at(F.array(*map(F.lit, ("MONOCHROME1", "RGB ", "MONOCHROME2", "OTHER"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("d"), pixels.is_monochrome(kind).alias("monochrome"), pixels.interpretation(kind).alias("known")).select("p_partkey", "d.*", "monochrome", "known")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 256 AS u, CASE WHEN p_partkey % 256 >= 128 THEN p_partkey % 256 - 256 ELSE p_partkey % 256 END AS x FROM part)
SELECT p_partkey, CAST(x * 2 - 5 AS INTEGER) AS rescaled, CAST(trunc(CASE WHEN u <= 49.5::DOUBLE - 49.5::DOUBLE THEN 0 WHEN u > 49.5::DOUBLE + 49.5::DOUBLE THEN 65535 ELSE ((u - 49.5::DOUBLE) / 99::DOUBLE + 0.5::DOUBLE) * 65535::DOUBLE END) AS INTEGER) AS windowed,
CAST(least(greatest(u - 10, 0), 31) * 4 * 2 AS INTEGER) AS looked_up FROM p""")
def lut_kinds(spark, sf_dir):
    """Tables of a rescale alone, of a window to 16 bits, and of a table of 7-bit entries, each applied to all parts."""
    kinds = {"rescaled": R.make_lut(spark, 8, True, (2.0, -5.0)), "windowed": R.make_lut(spark, 8, window=(50, 100, "LINEAR"), depth=16), "looked_up": R.make_lut(spark, 8, table=(10, [4 * i for i in range(32)], 7))}
    out = table(spark, sf_dir, "part").select("p_partkey")
    for name, lut in kinds.items():
        out = R.apply_lut(out, lut, "p_partkey", 8).withColumnRenamed("value", name)
    return out


@query("""WITH p AS (SELECT p_partkey, p_partkey * 7 % 4096 AS v, p_size * 40 AS center, 100 + p_size % 5 * 200 AS width, p_size FROM part)
SELECT p_partkey, CAST(trunc(CASE WHEN p_size % 2 = 0 THEN least(greatest(2 * v - 100 - 50, 0), 255) * 256 WHEN 2 * v - 100 <= center - 0.5::DOUBLE - (width - 1) / 2::DOUBLE THEN 0 WHEN 2 * v - 100 > center - 0.5::DOUBLE + (width - 1) / 2::DOUBLE THEN 65535
ELSE ((2 * v - 100 - (center - 0.5::DOUBLE)) / (width - 1)::DOUBLE + 0.5::DOUBLE) * 65535::DOUBLE END) AS INTEGER) AS value FROM p""")
def lut_composed(spark, sf_dir):
    """A rescale with a window or a table of each part's own; of many parts with the same, one table is composed."""
    even = F.col("p_size") % 2 == 0
    entries = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.concat(F.lpad(F.hex(i), 2, "0"), F.lit("00"))), ""))
    params = {"bits": F.lit(12), "signed": F.lit(False), "slope": F.lit(2.0), "intercept": F.lit(-100.0), "center": F.when(~even, F.col("p_size") * 40.0), "width": F.when(~even, 100.0 + F.col("p_size") % 5 * 200), "function": F.lit("LINEAR"), "first": F.lit(50), "entry_bits": F.lit(8), "entries": F.when(even, entries)}
    rows, tables = I.composed_tables(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 4096).alias("sample"), "p_size").withColumns(params))
    return rows.join(tables, "table").select("p_partkey", I.table_value(F.col("values"), F.col("sample"), F.col("bits")).alias("value"))


@query("""SELECT s_suppkey AS instance, 'meta' AS part, '1.2.840.10008.1.2.1' AS value FROM supplier UNION ALL SELECT s_suppkey, 'data', s_name FROM supplier""")
def attribute_routing(spark, sf_dir):
    """Attributes of group 0002 come from the meta table, others from the data set."""
    rows = table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    meta = rows.select(F.col("s_suppkey").alias("instance"), *[(F.lit("1.2.840.10008.1.2.1") if c == "transfer_syntax" else none).alias(c) for c in M.COLUMNS.values()])
    elements = E.elements_of(rows, "s_suppkey", {"s_name": (0x00100010, "PN")})
    found = lambda tag, part: M.attribute(elements, meta, tag).select("instance", F.lit(part).alias("part"), F.get("values", F.lit(0)).alias("value"))
    return found(0x00020010, "meta").unionByName(found(0x00100010, "data")).unionByName(found(0x00020013, "meta"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_extendedprice / (l_partkey + 1) AS a, -l_discount AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, hex(CAST(CAST(CAST(a AS DOUBLE) AS BIT) AS BLOB)) || hex(CAST(CAST(CAST(b AS DOUBLE) AS BIT) AS BLOB)) AS doubles, hex(CAST(CAST(CAST(a AS FLOAT) AS BIT) AS BLOB)) AS single FROM v""")
def float_value_bytes(spark, sf_dir):
    """Bytes of floating-point values, shown with the highest byte first."""
    a, b = F.col("l_extendedprice").cast("double") / (F.col("l_partkey") + 1), -F.col("l_discount").cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.hex(values.float_bytes(F.array(a, b), 8)).alias("d"), F.hex(values.float_bytes(F.array(a), 4)).alias("s"))
    turned = lambda h, start, width: F.concat(*[F.substring(h, start + 2 * i, 2) for i in reversed(range(width))])
    return rows.select("l_orderkey", "l_linenumber", F.concat(turned("d", 1, 8), turned("d", 17, 8)).alias("doubles"), turned("s", 1, 4).alias("single"))
