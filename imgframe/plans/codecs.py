"""Queries on JSON, dumps and binary codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators.elements import elements_of, wide
from ..sources import codec, tagged_json
from .registry import query, table

CUSTOMER = {"c_name": (0x00100010, "PN"), "c_custkey": (0x00200013, "IS"), "c_nationkey": (0x00000900, "US")}


def _customers(spark, sf_dir):
    return elements_of(table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey")), "id", CUSTOMER)


JSON_SQL = """'{"00000900":{"vr":"US","Value":[' || c_nationkey || ']},"00100010":{"vr":"PN","Value":[{"Alphabetic":"' || c_name || '"}]},"00200013":{"vr":"IS","Value":["' || c_custkey || '"]}}'"""


@query(f"SELECT c_custkey AS instance, {JSON_SQL} AS json FROM customer")
def json_encode_tags(spark, sf_dir):
    return tagged_json.to_json(_customers(spark, sf_dir))


@query("SELECT c_custkey AS instance, c_name AS name, CAST(c_custkey AS VARCHAR) AS number, CAST(c_nationkey AS VARCHAR) AS status FROM customer")
def json_round_trip(spark, sf_dir):
    back = tagged_json.from_json(tagged_json.to_json(_customers(spark, sf_dir)))
    return wide(back, {"name": "(0010,0010)", "number": "(0020,0013)", "status": "(0000,0900)"})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def _line_sql(head, alias, vr, value):
    return f"""SELECT c_custkey AS instance, '{head} ' || rpad('{alias}', 24, ' ') || ' {vr} (1, ' || (strlen({value}) + 1) // 2 * 2 || ' bytes): "' || {value} || '"' AS line FROM customer"""


@query(" UNION ALL ".join([_line_sql("(0010,0010)", "PatientName", "PN", "c_name"), _line_sql("(0020,0013)", "InstanceNumber", "IS", "c_custkey::VARCHAR"), _line_sql("(0000,0900)", "Status", "US", "c_nationkey::VARCHAR")]))
def dump_line(spark, sf_dir):
    found = D.lookup(_customers(spark, sf_dir).withColumnRenamed("vr", "own_vr"), D.dictionary(spark))
    return found.select("instance", tagged_json.dump_line(F.col("tag"), F.col("alias"), F.col("own_vr"), F.col("values")).alias("line"))


@query("SELECT o_orderkey AS instance, o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y%m%d') AS day FROM orders")
def binary_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyyMMdd"))
    elements = elements_of(rows, "o_orderkey", {"o_orderstatus": (0x00080060, "CS"), "o_orderpriority": (0x00100010, "LO"), "day": (0x00080020, "DA")})
    back = codec.decode_datasets(codec.encode_datasets(elements), "instance", "data")
    return wide(back, {"status": "(0008,0060)", "priority": "(0010,0010)", "day": "(0008,0020)"})


def _quantised(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 8).cast("int")).alias("x"))


QUANTISED_SQL = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 1) * 8) AS INTEGER)) AS x FROM embeddings"


@query(QUANTISED_SQL)
def rle_round_trip(spark, sf_dir):
    return codec.round_trip(_quantised(spark, sf_dir), "x", "rle")


@query(QUANTISED_SQL)
def deflate_round_trip(spark, sf_dir):
    return codec.round_trip(_quantised(spark, sf_dir), "x", "deflate")


@query("""SELECT c_custkey AS instance, CAST(place AS INTEGER) AS place, path FROM customer, (VALUES (0, '(0000,0900)'), (1, '(0010,0010)'), (2, '(0020,0013)')) AS p(place, path)""")
def token_stream(spark, sf_dir):
    """Elements in the order in which they stand in the encoded data set, as its headers say."""
    return codec.token_rows(codec.encode_datasets(_customers(spark, sf_dir)), "instance", "data", values=False).select("instance", "place", "path")
