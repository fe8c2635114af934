"""Queries on nested updates, typed pushes, private attributes, paths and the meta table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags
from ..operators import elements as E
from ..operators import meta as M
from .registry import query, table


def _texts(elements):
    return elements.select("instance", "path", "vr", F.concat_ws("\\", "values").alias("text"))


def _orders(spark, sf_dir):
    """Each order has none, one or two items in a sequence, each with a code in a sequence of its own."""
    row = lambda path, vr, *values: F.struct(path.alias("path"), F.lit(vr).alias("vr"), F.array(*values).cast("array<string>").alias("values"))

    def item(n):
        at = F.concat(F.lit("(0040,A730)["), n.cast("string"), F.lit("]."))
        return F.array(row(F.concat(at, F.lit("(0040,A160)")), "UT", F.col("o_orderpriority")), row(F.concat(at, F.lit("(0040,A168)")), "SQ"), row(F.concat(at, F.lit("(0040,A168)[0].(0008,0100)")), "SH", F.concat("o_orderstatus", n.cast("string"))))

    items = F.flatten(F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda n: n < F.col("o_orderkey") % 3), item))
    roots = F.array(row(F.lit("(0040,A730)"), "SQ"), row(F.lit("(0008,0060)"), "CS", F.col("o_orderstatus")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), F.explode(F.concat(roots, items)).alias("e")).select("instance", "e.*")
    return rows.select("instance", "path", tags.parse_tag(F.element_at(F.split("path", r"\."), -1)).alias("tag"), "vr", "values")


@query("""WITH i AS (SELECT o_orderkey AS instance, o_orderstatus AS status, o_orderpriority AS priority, n FROM orders, range(2) r(n) WHERE n < o_orderkey % 3)
SELECT o_orderkey AS instance, '(0040,A504)' AS path, 'SQ' AS vr, '' AS text FROM orders UNION ALL SELECT o_orderkey, '(0040,A504)[0].(0008,0100)', 'SH', 'new' FROM orders UNION ALL SELECT o_orderkey, '(0040,A504)[1].(0008,0100)', 'SH', 'next' || chr(92) || '7' FROM orders
UNION ALL SELECT o_orderkey, '(0008,0060)', 'CS', 'XX' FROM orders UNION ALL SELECT o_orderkey, '(0040,A730)', 'SQ', '' FROM orders UNION ALL SELECT o_orderkey, '(0040,A730)[1].(0040,A043)', 'LO', 'in item 1' FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT instance, '(0040,A730)[' || n || '].(0040,A160)', 'UT', CASE n WHEN 1 THEN '2nd' ELSE priority END FROM i
UNION ALL SELECT instance, '(0040,A730)[1].(0040,A168)', 'SQ', '' FROM i WHERE n = 1 UNION ALL SELECT instance, '(0040,A730)[1].(0040,A168)[0].(0008,0100)', 'SH', status || n FROM i WHERE n = 1""")
def ops_nested(spark, sf_dir):
    """Changes at nested paths: sequences and next items are made, others left; a sequence goes with its items."""
    ops = [
        E.Operation("set", "(0040,A504)[0].(0008,0100)", "new", "SH"),
        E.Operation("set", "(0040,A504)[1].(0008,0100)", "next", "SH"),
        E.Operation("push", "(0040,A504)[1].(0008,0100)", 7, kind="u16"),
        E.Operation("set", "(0040,A504)[7].(0008,0100)", "too far", "SH"),
        E.Operation("set", "(0008,0060)[0].(0008,0100)", "in no sequence", "SH"),
        E.Operation("set", "(0008,0060)", "XX"),
        E.Operation("replace", "(0040,A730)[1].(0040,A160)", "2nd"),
        E.Operation("set", "(0040,A730)[1].(0040,A043)", "in item 1", "LO"),
        E.Operation("remove", "(0040,A730)[0].(0040,A168)"),
    ]
    return _texts(E.apply(_orders(spark, sf_dir), ops))


@query("""SELECT p_partkey AS instance, path, vr, text FROM (SELECT p_partkey, '(0028,0010)' AS path, 'US' AS vr, p_size || chr(92) || '7' || chr(92) || '-3' AS text FROM part UNION ALL SELECT p_partkey, '(0028,1050)', 'FD', '0.5' || chr(92) || '2.0' FROM part
UNION ALL SELECT p_partkey, '(0020,4000)', 'LT', p_brand || chr(92) || '7' FROM part UNION ALL SELECT p_partkey, '(0028,0009)', 'AT', '(0018,1063)' FROM part UNION ALL SELECT p_partkey, '(0028,0011)', 'UL', '9' FROM part)""")
def ops_typed_push(spark, sf_dir):
    """Numbers pushed to numbers are cut to their type, to text become text; text is not pushed to numbers, nor anything to tags."""
    rows = table(spark, sf_dir, "part")
    one = lambda path, vr, value: F.struct(F.lit(path).alias("path"), F.lit(E.tag_at(path)).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(value.cast("string")).alias("values"))
    each = F.array(one("(0028,0010)", "US", F.col("p_size")), one("(0028,1050)", "FD", F.lit("0.5")), one("(0020,4000)", "LT", F.col("p_brand")), one("(0028,0009)", "AT", F.lit("(0018,1063)")))
    elements = rows.select(F.col("p_partkey").alias("instance"), F.explode(each).alias("e")).select("instance", "e.*")
    push = lambda path, value, kind, vr="UN": E.Operation("push", path, value, vr, kind)
    ops = [push("(0028,0010)", 7, "u16"), push("(0028,0010)", -3.9, "f32"), push("(0028,0010)", "x", "str"), push("(0028,1050)", 2, "i32"), push("(0020,4000)", 7, "i16"), push("(0028,0009)", 1, "u32"), push("(0028,0011)", 9, "u32", "UL")]
    return _texts(E.apply(elements, ops))


@query("""SELECT c_custkey AS instance, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE NULL END AS value, CASE c_custkey % 3 WHEN 1 THEN 'missing leaf (0040,A730)[0].(0008,0100)' WHEN 2 THEN 'not a sequence (0040,A730)' END AS failure FROM customer""")
def path_lookup(spark, sf_dir):
    """The value at a path, or the first step of it that fails."""
    k = F.col("c_custkey") % 3
    row = lambda path, vr, values: F.struct(F.lit(path).alias("path"), F.lit(vr).alias("vr"), values.alias("values"))
    root = F.when(k == 2, row("(0040,A730)", "LO", F.array(F.lit("text")))).otherwise(row("(0040,A730)", "SQ", E.none()))
    leaf = F.when(k == 0, row("(0040,A730)[0].(0008,0100)", "SH", F.array("c_name"))).when(k == 1, row("(0040,A730)[0].(0008,0104)", "LO", F.array("c_name")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance"), F.explode(F.array(root, leaf)).alias("e")).where("e IS NOT NULL").select("instance", "e.*")
    return E.value_at(rows, "(0040,A730)[0].(0008,0100)").select("instance", F.get("values", F.lit(0)).alias("value"), "failure")


@query("""SELECT s_suppkey AS instance, path, text FROM (SELECT s_suppkey, '(0009,00' || CASE WHEN s_suppkey % 2 = 0 THEN '10' ELSE '11' END || ')' AS path, 'OURS' AS text FROM supplier
UNION ALL SELECT s_suppkey, '(0009,' || CASE WHEN s_suppkey % 2 = 0 THEN '10' ELSE '11' END || '02)', s_name FROM supplier UNION ALL SELECT s_suppkey, '(0009,0010)', 'THEIRS' FROM supplier WHERE s_suppkey % 2 = 1)""")
def private_put(spark, sf_dir):
    """A private attribute goes to its creator's block; a creator that has none gets the first free one."""
    creator = F.when(F.col("s_suppkey") % 2 == 0, "OURS").otherwise("THEIRS")
    rows = table(spark, sf_dir, "supplier")
    held = rows.select(F.col("s_suppkey").alias("instance"), F.lit("(0009,0010)").alias("path"), F.lit(0x00090010).cast("long").alias("tag"), F.lit("LO").alias("vr"), F.array(creator).alias("values"))
    names = rows.select(F.col("s_suppkey").alias("instance"), "s_name")
    put = E.put_private(held, 0x0009, "OURS", 0x02, "LO", "name")
    named = put.join(names, "instance").withColumn("text", F.when(F.get("values", F.lit(0)) == "name", F.col("s_name")).otherwise(F.get("values", F.lit(0))))
    return named.select("instance", "path", "text")


META_SQL = """WITH m AS (SELECT s_suppkey AS instance, '1.2.' || s_suppkey AS c, s_name AS i, '1.2.840.10008.1.2.1' AS t, '1.2.3' AS p, 'VERSION 2' AS v, CASE WHEN s_suppkey % 2 = 0 THEN 'AE' || s_suppkey END AS ae FROM supplier)
SELECT instance, c AS sop_class, i AS sop_instance, t AS transfer_syntax, v AS version, ae AS source, CAST(14 + (8 + (strlen(c) + 1) // 2 * 2) + (8 + (strlen(i) + 1) // 2 * 2) + 28 + 14 + 18 + coalesce(8 + (strlen(ae) + 1) // 2 * 2, 0) AS BIGINT) AS group_length FROM m"""


@query(META_SQL)
def ops_meta(spark, sf_dir):
    """Defaults from the data set, operations on the meta table, and its group length."""
    rows = table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    columns = {c: none.alias(c) for c in M.COLUMNS.values()}
    columns["transfer_syntax"] = F.lit("1.2.840.10008.1.2\u0000").alias("transfer_syntax")
    columns["source_application_entity_title"] = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("AE"), "s_suppkey")).alias("source_application_entity_title")
    meta = rows.select(F.col("s_suppkey").alias("instance"), F.concat(F.lit("1.2."), "s_suppkey").alias("class"), F.col("s_name").alias("name"), *columns.values())
    meta = M.with_defaults(meta, F.col("class"), F.col("name"), "1.2.3")
    ops = [
        E.Operation("replace", "(0002,0010)", "1.2.840.10008.1.2.1"),
        E.Operation("set", "(0002,0013)", "VERSION 1"),
        E.Operation("replace", "(0002,0013)", "VERSION 2"),
        E.Operation("set_if_missing", "(0002,0013)", "VERSION 3"),
        E.Operation("set_if_missing", "(0002,0010)", "kept as it is"),
        E.Operation("set", "(0002,0017)", "OUT"),
        E.Operation("remove", "(0002,0017)"),
        E.Operation("remove", "(0002,0099)"),
        E.Operation("truncate", "(0002,0003)", 0),
    ]
    out = M.apply(meta, ops)
    return out.select("instance", F.col("media_storage_sop_class_uid").alias("sop_class"), F.col("media_storage_sop_instance_uid").alias("sop_instance"), F.col("transfer_syntax"), F.col("implementation_version_name").alias("version"), F.col("source_application_entity_title").alias("source"), F.col("information_group_length").alias("group_length"))


@query("""WITH i AS (SELECT o_orderkey AS instance, o_orderstatus AS status, o_orderpriority AS priority, n FROM orders, range(2) r(n) WHERE n < o_orderkey % 3)
SELECT o_orderkey AS instance, '(0008,0060)' AS path, 'CS' AS vr, o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey, '(0040,A730)', 'SQ', '' FROM orders
UNION ALL SELECT o_orderkey, '(0040,A730)[0].(0040,A160)', 'UT', 'new' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT instance, '(0040,A730)[' || n || '].(0040,A160)', 'UT', priority FROM i WHERE instance % 2 = 1 UNION ALL SELECT instance, '(0040,A730)[' || n || '].(0040,A168)', 'SQ', '' FROM i WHERE instance % 2 = 1
UNION ALL SELECT instance, '(0040,A730)[' || n || '].(0040,A168)[0].(0008,0100)', 'SH', CASE WHEN n = 0 THEN 'X' ELSE status || n END FROM i WHERE instance % 2 = 1""")
def extend_sequences(spark, sf_dir):
    """A sequence in place of another one leaves none of its items; an element of an item leaves the others."""
    old = _orders(spark, sf_dir)
    row = lambda path, vr, *values: F.struct(F.lit(path).alias("path"), F.lit(E.tag_at(path)).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(*values).cast("array<string>").alias("values"))
    whole = F.array(row("(0040,A730)", "SQ"), row("(0040,A730)[0].(0040,A160)", "UT", F.lit("new")))
    leaf = F.array(row("(0040,A730)[0].(0040,A168)[0].(0008,0100)", "SH", F.lit("X")))
    k = F.col("o_orderkey")
    new = table(spark, sf_dir, "orders").select(k.alias("instance"), F.explode(F.when(k % 2 == 0, whole).when(k % 3 > 0, leaf).otherwise(F.array().cast(E.ENTRIES))).alias("e")).select("instance", "e.*")
    return _texts(E.upsert(old, new))


@query("""SELECT s_suppkey AS instance, path, creator FROM (SELECT s_suppkey, '(0009,1001)' AS path, 'ROOT' AS creator FROM supplier UNION ALL SELECT s_suppkey, '(0040,A730)[0].(0009,1001)', 'ITEM' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, '(0040,A730)[1].(0009,1001)', NULL FROM supplier)""")
def private_in_items(spark, sf_dir):
    """The creator of a private element is that of its own item, not the root's or another item's of the same block."""
    row = lambda path, vr, value: F.struct(F.lit(path).alias("path"), F.lit(E.tag_at(path)).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(value).alias("values"))
    own = F.concat(F.lit("ITEM"), F.col("s_suppkey").cast("string"))
    each = [row("(0009,0010)", "LO", F.lit("ROOT")), row("(0009,1001)", "LO", F.lit("a")), row("(0040,A730)[0].(0009,0010)", "LO", own), row("(0040,A730)[0].(0009,1001)", "LO", F.lit("b")), row("(0040,A730)[1].(0009,1001)", "LO", F.lit("c"))]
    elements = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instance"), F.explode(F.array(*each)).alias("e")).select("instance", "e.*")
    return E.private_elements(elements).select("instance", "path", "creator")
