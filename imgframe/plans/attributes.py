"""Queries on tags, paths, values and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, person, tags, values
from .registry import query, table

TAG = "p_partkey * 7919 % 4294967296"


def _hex(width: int, of: str) -> str:
    return f"lpad(upper(to_hex(CAST({of} AS BIGINT))), {width}, '0')"


KEY_SQL = _hex(8, TAG)
TEXT_SQL = f"CASE p_partkey % 4 WHEN 0 THEN '(' || {KEY_SQL}[1:4] || ',' || {KEY_SQL}[5:8] || ')' WHEN 1 THEN lower({KEY_SQL}[1:4] || ',' || {KEY_SQL}[5:8]) WHEN 2 THEN {KEY_SQL} ELSE {KEY_SQL}[1:4] || ' ' || {KEY_SQL}[5:8] END"


@query(f"SELECT p_partkey, {TEXT_SQL} AS t, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST({TAG} AS BIGINT) END AS tag FROM part")
def tag_parse(spark, sf_dir):
    key = tags.tag_key(F.col("tag"))
    a, b = F.substring(key, 1, 4), F.substring(key, 5, 4)
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("("), a, F.lit(","), b, F.lit(")"))).when(k == 1, F.lower(F.concat_ws(",", a, b))).when(k == 2, key).otherwise(F.concat_ws(" ", a, b))
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(TAG).alias("tag")).select("p_partkey", text.alias("t")).select("p_partkey", "t", tags.parse_tag(F.col("t")).alias("tag"))


@query(f"""SELECT p_partkey, '(' || {KEY_SQL}[1:4] || ',' || {KEY_SQL}[5:8] || ')' AS text, CAST({TAG} AS BIGINT) // 65536 AS grp, CAST({TAG} AS BIGINT) % 65536 AS element,
(CAST({TAG} AS BIGINT) // 65536) % 2 = 1 AS private FROM part""")
def tag_format(spark, sf_dir):
    tag = F.col("tag")
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(TAG).alias("tag")).select("p_partkey", tags.format_tag(tag).alias("text"), tags.group_of(tag).alias("grp"), tags.element_of(tag).cast("long").alias("element"), tags.is_private(tag).alias("private"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INT) AS item, CAST(4237104 AS BIGINT) AS first_tag,
'(0040,A730)[' || l_linenumber || '].(0040,A168)[0].(0008,0100)' AS canonical, 3 AS depth FROM lineitem""")
def selector_parse(spark, sf_dir):
    text = F.concat(F.lit("ContentSequence["), F.col("l_linenumber"), F.lit("].0040,A168.(0008,0100)"))
    steps = F.col("steps")
    parsed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tags.parse_selector(text, {"ContentSequence": 0x0040A730}).alias("steps"))
    return parsed.select("l_orderkey", "l_linenumber", steps[0].item.alias("item"), steps[0].tag.alias("first_tag"), tags.format_selector(steps).alias("canonical"), F.size(steps).alias("depth"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Adams^John' WHEN 1 THEN ' ' || c_name || '^^Robert ' WHEN 2 THEN '^^^Rev.' ELSE c_name || '^J^R^Dr.^B.A. M.Div.^extra' END AS t FROM customer)
SELECT c_custkey, nullif(split_part(trim(t), '^', 1), '') AS family, nullif(split_part(trim(t), '^', 2), '') AS given, nullif(split_part(trim(t), '^', 3), '') AS middle,
nullif(split_part(trim(t), '^', 4), '') AS prefix, nullif(split_part(trim(t), '^', 5), '') AS suffix FROM n""")
def pn_components(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", "p.*")


def _names(spark, sf_dir):
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    text = F.when(k == 0, "Adams^John").when(k == 1, F.concat(F.lit(" "), name, F.lit("^^Robert "))).when(k == 2, "^^^Rev.").otherwise(F.concat(name, F.lit("^J^R^Dr.^B.A. M.Div.^extra")))
    return table(spark, sf_dir, "customer").select("c_custkey", person.name_parts(text).alias("p"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Adams^John' WHEN 1 THEN c_name || '^^Robert' WHEN 2 THEN '^^^Rev.' ELSE c_name || '^J^R^Dr.^B.A. M.Div.' END AS text,
CASE c_custkey % 4 WHEN 0 THEN 'John Adams' WHEN 1 THEN 'Robert ' || c_name WHEN 2 THEN 'Rev.' ELSE 'Dr. J R ' || c_name || ' B.A. M.Div.' END AS shown FROM customer""")
def pn_format(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", person.format_name(F.col("p")).alias("text"), person.display_name(F.col("p")).alias("shown"))


WORDS_SQL = "string_split(replace(text, chr(10), ' '), ' ')"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split(F.translate("text", "\n", " "), " ").alias("w"))


@query(f"""SELECT doc_id, array_to_string(list_transform({WORDS_SQL}, lambda w: rtrim(w, ' ')), chr(92)) AS joined, len(string_split(array_to_string({WORDS_SQL}, chr(92)), chr(92))) AS n FROM documents""")
def value_to_str(spark, sf_dir):
    w = F.transform("w", lambda x: F.concat(x, F.lit("  \u0000")))
    return _words(spark, sf_dir).select("doc_id", values.to_str(w).alias("joined"), F.size(values.to_multi_str(F.col("w"))).cast("long").alias("n"))


@query(f"""SELECT doc_id, array_to_string({WORDS_SQL}, chr(92)) AS joined, len(string_split(array_to_string({WORDS_SQL}, chr(92)), chr(92))) AS n FROM documents""")
def value_to_str_whole(spark, sf_dir):
    """``value_to_str`` over whole texts."""
    w = F.transform("w", lambda x: F.concat(x, F.lit("  \u0000")))
    return _words(spark, sf_dir).select("doc_id", values.to_str(w).alias("joined"), F.size(values.to_multi_str(F.col("w"))).cast("long").alias("n"))


@query("SELECT p_partkey, p_brand, p_partkey % 3 <> 2 AS same FROM part")
def value_eq(spark, sf_dir):
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(" "))).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit("\u0000"))).otherwise(F.concat(F.lit(" "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", values.values_equal(F.array("p_brand"), F.array(other)).alias("same"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) END AS n FROM events")
def try_int(spark, sf_dir):
    """The first of several values, white space around it; text that is no number is NULL."""
    n, k = F.regexp_extract("props", "-?[0-9]+", 0), F.col("event_id") % 4
    text = F.when(k == 0, n).when(k == 1, F.concat(F.lit(" "), n, F.lit(" \u0000"))).when(k == 2, F.concat(n, F.lit("\\7"))).otherwise(F.concat(n, F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", values.to_int(text).alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE round(o_totalprice, 2) END AS x FROM orders")
def try_float(spark, sf_dir):
    n, k = F.format_string("%.2f", "o_totalprice"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 1, F.concat(n, F.lit("\\1.5e3"))).otherwise(F.concat(n, F.lit("kg")))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.to_float(text).alias("x"))


@query("""SELECT o_orderkey, regexp_full_match(strftime(o_orderdate, '%Y%m%d'), '[0-9]*') AS da, regexp_full_match(o_orderpriority, '[A-Z0-9_ ]*') AS cs,
regexp_full_match(upper(replace(o_orderpriority, '-', '_')), '[A-Z0-9_ ]*') AS cs_upper, false AS tm FROM orders""")
def validators(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        values.is_valid(F.date_format("o_orderdate", "yyyyMMdd"), "DA").alias("da"),
        values.is_valid(F.col("o_orderpriority"), "CS").alias("cs"),
        values.is_valid(F.upper(F.regexp_replace("o_orderpriority", "-", "_")), "CS").alias("cs_upper"),
        values.is_valid(F.date_format("o_orderdate", "HH:mm"), "TM").alias("tm"),
    )


@query(f"""SELECT doc_id, CAST(len({WORDS_SQL}) AS BIGINT) AS vm, CAST((strlen(array_to_string({WORDS_SQL}, chr(92))) + 1) // 2 * 2 AS BIGINT) AS n_bytes FROM documents""")
def value_bytelen(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", values.multiplicity(F.col("w")).alias("vm"), values.text_byte_length(F.col("w")).alias("n_bytes"))


@query(f"""SELECT doc_id, CAST(len({WORDS_SQL}) AS BIGINT) AS vm, CAST((strlen(array_to_string({WORDS_SQL}, chr(92))) + 1) // 2 * 2 AS BIGINT) AS n_bytes FROM documents""")
def value_bytelen_whole(spark, sf_dir):
    """``value_bytelen`` over whole texts."""
    return _words(spark, sf_dir).select("doc_id", values.multiplicity(F.col("w")).alias("vm"), values.text_byte_length(F.col("w")).alias("n_bytes"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS vm, CAST(len(embedding) * 4 AS BIGINT) AS n_bytes, 16 AS n_first, len(embedding) + 2 AS n_more FROM embeddings")
def value_truncate_extend(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        values.multiplicity(e).alias("vm"),
        values.binary_byte_length(e, "F32").alias("n_bytes"),
        F.size(values.truncate(e, 16)).alias("n_first"),
        F.size(values.extend(e, F.lit(0.5).cast("float"), F.lit(1).cast("float"))).cast("long").alias("n_more"),
    )


@query("SELECT s_suppkey, '1.2.840.' || s_suppkey AS uid, 'AE' || s_suppkey AS title, 'host' || s_nationkey AS host, CAST(11112 AS INT) AS port FROM supplier")
def address_parse(spark, sf_dir):
    """Padding of identifiers goes; ``TITLE@host:port`` is taken apart."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("1.2.840."), "s_suppkey", F.lit("\u0000 ")).alias("u"), F.concat(F.lit("AE"), "s_suppkey", F.lit("@host"), "s_nationkey", F.lit(":11112")).alias("a"))
    return rows.select("s_suppkey", values.trim_padding(F.col("u")).alias("uid"), address.parse(F.col("a")).alias("p")).select("s_suppkey", "uid", "p.*")
