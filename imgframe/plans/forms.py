"""Queries on the forms of data sets: binary, tokens, fragments, files and nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import meta as M
from ..operators.elements import Operation, elements_of, wide
from ..operators.store import ElementStore
from ..sources import codec, tagged_json
from ..sources.files import new_folder
from .registry import query, table
from .updates import _orders, _texts

ITEMS_SQL = "WITH i AS (SELECT o_orderkey AS instance, o_orderstatus AS status, o_orderpriority AS priority, n FROM orders, range(2) r(n) WHERE n < o_orderkey % 3)"
ELEMENTS_SQL = f"""{ITEMS_SQL}
SELECT o_orderkey AS instance, '(0040,A730)' AS path, 'SQ' AS vr, '' AS text FROM orders UNION ALL SELECT o_orderkey, '(0008,0060)', 'CS', o_orderstatus FROM orders
UNION ALL SELECT instance, '(0040,A730)[' || n || '].(0040,A160)', 'UT', priority FROM i UNION ALL SELECT instance, '(0040,A730)[' || n || '].(0040,A168)', 'SQ', '' FROM i
UNION ALL SELECT instance, '(0040,A730)[' || n || '].(0040,A168)[0].(0008,0100)', 'SH', status || n FROM i"""


@query(ELEMENTS_SQL)
def json_nested_round_trip(spark, sf_dir):
    """Sequences within sequences to JSON and back."""
    return _texts(tagged_json.from_json(tagged_json.to_json(_orders(spark, sf_dir))))


@query(f"""{ITEMS_SQL}, t AS (SELECT instance, string_agg('{{"0040A160":{{"vr":"UT","Value":["' || priority || '"]}},"0040A168":{{"vr":"SQ","Value":[{{"00080100":{{"vr":"SH","Value":["' || status || n || '"]}}}}]}}}}', ',' ORDER BY n) AS items FROM i GROUP BY instance)
SELECT o_orderkey AS instance, '{{"00080060":{{"vr":"CS","Value":["' || o_orderstatus || '"]}},"0040A730":{{"vr":"SQ"' || coalesce(',"Value":[' || items || ']', '') || '}}}}' AS json FROM orders LEFT JOIN t ON instance = o_orderkey""")
def json_nested(spark, sf_dir):
    return tagged_json.to_json(_orders(spark, sf_dir))


@query("""SELECT c_custkey AS instance, '{"00020002":{"vr":"UI","Value":["1.2"]},"00020010":{"vr":"UI","Value":["1.2.840.10008.1.2.1"]},"00100010":{"vr":"PN","Value":[{"Alphabetic":"' || c_name || '","Phonetic":"p"}]},"00280009":{"vr":"AT","Value":["00181063"]},"00420011":{"vr":"OB","InlineBinary":"' || base64(encode(c_name)) || '"},"00431001":{"vr":"UV","Value":["9000000000",7]},"00431002":{"vr":"FD","Value":[0.5,"NaN","-inf"]}}' AS json FROM customer""")
def json_typed(spark, sf_dir):
    """The meta table first, groups of names, tags, bytes, whole numbers beyond 32 bits and numbers that are not finite."""
    rows = table(spark, sf_dir, "customer")
    one = lambda tag, vr, *values: F.struct(F.lit(f"({tag >> 16:04X},{tag & 0xFFFF:04X})").alias("path"), F.lit(tag).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(*values).alias("values"))
    each = [one(0x00100010, "PN", F.concat("c_name", F.lit("==p"))), one(0x00280009, "AT", F.lit("(0018,1063)")), one(0x00420011, "OB", F.lower(F.hex(F.encode("c_name", "UTF-8")))), one(0x00431001, "UV", F.lit("9000000000"), F.lit("7")), one(0x00431002, "FD", F.lit("0.5"), F.lit("nan"), F.lit("-inf"))]
    elements = rows.select(F.col("c_custkey").alias("instance"), F.explode(F.array(*each)).alias("e")).select("instance", "e.*")
    none = F.lit(None).cast("string")
    known = {"media_storage_sop_class_uid": F.lit("1.2"), "transfer_syntax": F.lit("1.2.840.10008.1.2.1")}
    meta = rows.select(F.col("c_custkey").alias("instance"), *[known.get(c, none).alias(c) for c in M.COLUMNS.values()])
    return tagged_json.to_json(M.as_elements(meta).unionByName(elements), depth=0)


@query("""SELECT p_partkey AS instance, p_name || chr(CAST(p_partkey % 31 + 1 AS INTEGER)) || chr(34) || chr(92) || chr(12) || chr(27) || 'x' AS text FROM part""")
def json_controls(spark, sf_dir):
    """Control characters, quotes and backslashes in values to JSON and back."""
    held = F.concat(F.col("p_name"), F.char((F.col("p_partkey") % 31 + 1).cast("int")), F.lit('"\\\f\x1bx'))
    elements = elements_of(table(spark, sf_dir, "part").withColumn("held", held), "p_partkey", {"held": (0x00204000, "LT")})
    return tagged_json.from_json(tagged_json.to_json(elements, depth=0)).select("instance", F.get("values", F.lit(0)).alias("text"))


def _numbers(spark, sf_dir):
    row = lambda tag, vr, *values: F.struct(F.lit(f"({tag >> 16:04X},{tag & 0xFFFF:04X})").alias("path"), F.lit(tag).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(*values).cast("array<string>").alias("values"))
    each = [row(0x00100010, "PN", F.col("p_name")), row(0x00280010, "US", F.col("p_size"), F.lit(7)), row(0x00280009, "AT", F.lit("(0018,1063)")), row(0x00286010, "SL", -F.col("p_size")), row(0x00286020, "FD", F.lit(0.25)), row(0x7FE00010, "OW", F.lit("01020304"))]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("instance"), F.explode(F.array(*each)).alias("e")).select("instance", "e.*")


NUMBERS_SQL = """SELECT p_partkey AS instance, path, vr, text FROM (SELECT p_partkey, '(0010,0010)' AS path, 'PN' AS vr, p_name AS text FROM part UNION ALL SELECT p_partkey, '(0028,0010)', 'US', p_size || chr(92) || '7' FROM part
UNION ALL SELECT p_partkey, '(0028,0009)', 'AT', '(0018,1063)' FROM part UNION ALL SELECT p_partkey, '(0028,6010)', 'SL', CAST(-p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, '(0028,6020)', 'FD', '0.25' FROM part UNION ALL SELECT p_partkey, '(7FE0,0010)', 'OW', '01020304' FROM part)"""


@query(NUMBERS_SQL)
def big_endian_round_trip(spark, sf_dir):
    """Files in the retired big-endian form, which their meta table names."""
    files = codec.encode_datasets(_numbers(spark, sf_dir), syntax=codec.BIG)
    return _texts(codec.decode_datasets(files, "instance", "data", None).where("tag > 196607"))


@query(NUMBERS_SQL)
def deflated_file_round_trip(spark, sf_dir):
    files = codec.encode_datasets(_numbers(spark, sf_dir), syntax=codec.DEFLATED)
    return _texts(codec.decode_datasets(files, "instance", "data", None).where("tag > 196607"))


@query("""SELECT p_partkey AS instance, path, vr, text FROM (SELECT p_partkey, '(0010,0010)' AS path, 'PN' AS vr, p_name AS text FROM part UNION ALL SELECT p_partkey, '(0028,0010)', 'US', p_size || chr(92) || '7' FROM part
UNION ALL SELECT p_partkey, '(0028,6020)', 'UN', '000000000000d03f' FROM part)""")
def implicit_round_trip(spark, sf_dir):
    """The implicit form with a dictionary of the caller's; what it does not know comes back as bytes."""
    elements = _numbers(spark, sf_dir).where(F.col("tag").isin(0x00100010, 0x00280010, 0x00286020))
    data = codec.encode_datasets(elements, explicit=False)
    return _texts(codec.decode_datasets(data, "instance", "data", False, vrs={0x00100010: "PN", 0x00280010: "US"}))


CHARSET_SQL = "SELECT doc_id AS instance, path, text FROM (SELECT doc_id, '(0008,0005)' AS path, 'ISO_IR 100' AS text FROM documents UNION ALL SELECT doc_id, '(4008,0300)', rtrim(regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{FF}]', '?', 'g'), ' ') FROM documents)"


@query(CHARSET_SQL)
def charset_round_trip(spark, sf_dir):
    """Whole texts in a declared single-byte set and back; what the set lacks is replaced before."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("ISO_IR 100").alias("charset"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x{00}-\\x{FF}]", "?").alias("body"))
    elements = elements_of(rows, "doc_id", {"charset": (codec.CHARSET, "CS"), "body": (0x40080300, "UT")})
    return _texts(codec.decode_datasets(codec.encode_datasets(elements), "instance", "data")).drop("vr")


@query(f"""{ITEMS_SQL}, n AS (SELECT o_orderkey AS instance, o_orderkey % 3 AS k FROM orders), t AS (SELECT instance, 0 AS place, 'element' AS kind FROM n UNION ALL SELECT instance, 1, 'sequence' FROM n UNION ALL SELECT instance, 2 + 8 * n + p, kind FROM i,
(VALUES (0, 'item'), (1, 'element'), (2, 'sequence'), (3, 'item'), (4, 'element'), (5, 'item_end'), (6, 'sequence_end'), (7, 'item_end')) v(p, kind) UNION ALL SELECT instance, 2 + 8 * k, 'sequence_end' FROM n)
SELECT instance, CAST(place AS INTEGER) AS place, kind FROM t""")
def token_marks(spark, sf_dir):
    """The tokens of encoded data sets, with the begin and end of sequences and items; values are not taken out."""
    return codec.token_rows(codec.encode_datasets(_orders(spark, sf_dir)), "instance", "data", values=False).select("instance", "place", "kind")


@query("""SELECT c_custkey AS instance, CAST(f AS INTEGER) AS fragment, CASE WHEN f < 0 THEN '' ELSE upper(hex(encode(c_name[f * 6 + 1 : f * 6 + 6]))) || CASE WHEN strlen(c_name[f * 6 + 1 : f * 6 + 6]) % 2 = 1 THEN '00' ELSE '' END END AS data
FROM customer, range(-1, 3) r(f)""")
def fragment_rows(spark, sf_dir):
    """Encapsulated pixel data as one row a fragment, the offset table first."""
    pieces = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.lower(F.hex(F.encode(F.substring(F.col("c_name"), i * 6 + 1, F.lit(6)), "UTF-8")))))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance"), F.lit("(7FE0,0010)").alias("path"), F.lit(codec.PIXEL_DATA).cast("long").alias("tag"), F.lit("OB").alias("vr"), pieces.alias("values"))
    out = codec.pixel_fragments(codec.encode_datasets(rows), "instance", "data")
    return out.select("instance", "fragment", F.hex("data").alias("data"))


@query("""SELECT s_suppkey AS instance, CASE s_suppkey % 3 WHEN 1 THEN 'no magic' WHEN 2 THEN 'no transfer syntax' END AS error, CASE s_suppkey % 3 WHEN 0 THEN '1.2.840.10008.1.2.1' END AS syntax, CASE s_suppkey % 3 WHEN 0 THEN '' END AS sop_class, CASE s_suppkey % 3 WHEN 0 THEN '0001' END AS version FROM supplier""")
def file_meta_scan(spark, sf_dir):
    """Meta tables of whole files, with defaults, and what is wrong with those that have none."""
    elements = elements_of(table(spark, sf_dir, "supplier"), "s_suppkey", {"s_name": (0x00100010, "PN")})
    k = F.col("instance") % 3
    files = codec.encode_datasets(elements, syntax=codec.EXPLICIT)
    cut = F.concat(F.substring("data", 1, 132), F.unhex(F.lit("02000000554C04000000000010001000")))
    files = files.select("instance", F.when(k == 1, F.encode(F.lit("no file at all"), "UTF-8")).when(k == 2, cut).otherwise(F.col("data")).alias("data"))
    return codec.meta_tables(files, "instance", "data").select("instance", "error", F.col("transfer_syntax").alias("syntax"), F.col("media_storage_sop_class_uid").alias("sop_class"), F.col("information_version").alias("version"))


@query("""SELECT c_custkey AS instance, '(0008,0060) ' || rpad('Modality', 24, ' ') || ' CS (1, ' || (strlen(c_mktsegment) + 1) // 2 * 2 || ' bytes): "' || c_mktsegment || '"' AS line FROM customer
UNION ALL SELECT c_custkey, '(0010,0010) ' || rpad('PatientName', 24, ' ') || ' PN (1, ' || (strlen(c_name) + 1) // 2 * 2 || ' bytes): "' || c_name || '"' FROM customer
UNION ALL SELECT c_custkey, '(0099,0001) ' || rpad('«unknown»', 24, ' ') || ' LO (2, ' || (strlen(c_name) + 5) // 2 * 2 || ' bytes): ["' || c_name || '", "a.b"]' FROM customer""")
def dump_elements(spark, sf_dir):
    """Lines of all elements, known and unknown, of one value and of several."""
    rows = table(spark, sf_dir, "customer")
    one = lambda tag, vr, *values: F.struct(F.lit(tag).cast("long").alias("tag"), F.lit(vr).alias("own_vr"), F.array(*values).alias("values"))
    each = F.array(one(0x00080060, "CS", F.col("c_mktsegment")), one(0x00100010, "PN", F.col("c_name")), one(0x00990001, "LO", F.col("c_name"), F.lit("a\tb")))
    elements = rows.select(F.col("c_custkey").alias("instance"), F.explode(each).alias("e")).select("instance", "e.*")
    found = D.lookup(elements, D.dictionary(spark))
    return found.select("instance", tagged_json.dump_line(F.col("tag"), F.col("alias"), F.col("own_vr"), F.col("values")).alias("line"))


@query("SELECT o_orderkey AS instance, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def decode_wanted(spark, sf_dir):
    """Only the attributes before a tag are decoded, the rest of the data set is not read."""
    rows = table(spark, sf_dir, "orders").withColumn("long", F.repeat(F.lit("x"), 2000))
    elements = elements_of(rows, "o_orderkey", {"o_orderstatus": (0x00080060, "CS"), "o_orderpriority": (0x00100010, "LO"), "long": (0x00104000, "LT")})
    back = codec.decode_datasets(codec.encode_datasets(elements), "instance", "data", until=0x00104000)
    return wide(back, {"status": "(0008,0060)", "priority": "(0010,0010)"})


@query(f"""WITH e AS ({ELEMENTS_SQL}) SELECT instance, path, vr, CASE WHEN path = '(0008,0060)' AND o_orderstatus = 'P' THEN 'XX' ELSE text END AS text FROM e JOIN orders ON o_orderkey = instance WHERE NOT (o_orderstatus = 'P' AND starts_with(path, '(0040,A730)'))""")
def ops_stored(spark, sf_dir):
    """Operations on the orders in progress, in a stored table of all: their buckets are written anew, and the table is read back."""
    store = ElementStore.create(_orders(spark, sf_dir), new_folder(spark, "elements"), 16)
    progress = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("instance"))
    store.change([Operation("set", "(0008,0060)", "XX"), Operation("remove", "(0040,A730)")], progress)
    return _texts(store.elements())
