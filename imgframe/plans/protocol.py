"""Queries on protocol messages, associations and the store loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address
from ..operators import dictionary as D
from ..operators import negotiation as N
from ..operators.elements import elements_of
from ..sources import codec
from ..streaming import messages as M
from ..streaming import pdu
from .registry import query, table


def _data(context, command, last, data):
    return F.array(F.struct(context.cast("int").alias("context"), command.alias("command"), last.alias("last"), data.alias("data")))


def _text_messages(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.lit("p_data").alias("kind"), _data(k % 128 * 2 + 1, k % 2 == 0, k % 3 == 0, F.encode(F.concat("o_orderstatus", "o_orderpriority"), "UTF-8")).alias("pdvs"))
    return pdu.write(rows, ["id"])


HEX = "lpad(upper(to_hex({})), {}, '0')"
BODY = "o_orderstatus || o_orderpriority"
MESSAGE_SQL = f"'0400' || {HEX.format(f'strlen({BODY}) + 6', 8)} || {HEX.format(f'strlen({BODY}) + 2', 8)} || {HEX.format('o_orderkey % 128 * 2 + 1', 2)} || {HEX.format('CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END', 2)} || hex(encode({BODY}))"


@query(f"SELECT o_orderkey AS id, {MESSAGE_SQL} AS data FROM orders")
def pdu_write(spark, sf_dir):
    return _text_messages(spark, sf_dir).select("id", F.hex("data").alias("data"))


@query(f"""SELECT o_orderkey AS id, place, kind, context, command, last, text FROM (
SELECT o_orderkey, 0 AS place, 'p_data' AS kind, CAST(o_orderkey % 128 * 2 + 1 AS INTEGER) AS context, o_orderkey % 2 = 0 AS command, o_orderkey % 3 = 0 AS last, {BODY} AS text FROM orders
UNION ALL SELECT o_orderkey, 1, 'release_rq', NULL, NULL, NULL, NULL FROM orders UNION ALL SELECT o_orderkey, 2, 'unknown', NULL, NULL, NULL, NULL FROM orders UNION ALL SELECT o_orderkey, 3, CASE WHEN o_orderkey % 2 = 0 THEN 'incomplete' ELSE 'error' END, NULL, NULL, NULL, NULL FROM orders)""")
def pdu_parse(spark, sf_dir):
    """A captured stream of several messages; its last one has not wholly come, or is none."""
    tail = F.unhex(F.when(F.col("id") % 2 == 0, "0400000000FF01").otherwise("0400000000040000FFFF"))
    streams = _text_messages(spark, sf_dir).select("id", F.concat("data", F.unhex(F.lit("05000000000400000000")), F.unhex(F.lit("5500000000010A")), tail).alias("data"))
    value = F.get("pdvs", F.lit(0))
    return pdu.parse(streams, "id", "data").select("id", "place", "kind", value.context.alias("context"), value.command.alias("command"), value.last.alias("last"), F.decode(value.data, "UTF-8").alias("text"))


@query("""SELECT c_custkey AS id, 'associate_rq' AS kind, 'STORE' AS called, 'AE' || c_custkey AS calling, '1.2.840.10008.3.1.1.1' AS application_context, CAST(c_custkey % 5 * 16384 AS BIGINT) AS max_length, c_mktsegment AS version, 2 AS n_contexts, '1.2.' || c_custkey AS abstract_syntax, '1.2.840.10008.1.2|1.2.840.10008.1.2.1' AS syntaxes,
c_custkey % 2 = 0 AS scp, upper(hex(encode(c_name))) AS extended, c_custkey % 5 * 16384 BETWEEN 1 AND 200 AS too_long FROM customer""")
def association_round_trip(spark, sf_dir):
    """Requests with contexts, limits, roles and extended negotiation, written and read."""
    k = F.col("c_custkey")
    uid = F.concat(F.lit("1.2."), k)
    context = lambda n, uid: F.struct(F.lit(n).alias("id"), F.lit(None).cast("int").alias("result"), uid.alias("abstract_syntax"), F.array(F.lit("1.2.840.10008.1.2"), F.lit("1.2.840.10008.1.2.1")).alias("transfer_syntaxes"))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.lit("associate_rq").alias("kind"),
        F.lit("STORE").alias("called"),
        F.concat(F.lit("AE"), k).alias("calling"),
        F.lit("1.2.840.10008.3.1.1.1").alias("application_context"),
        F.array(context(1, uid), context(3, F.lit("1.3"))).alias("contexts"),
        (k % 5 * 16384).cast("long").alias("max_length"),
        F.lit("1.9").alias("implementation_class"),
        F.col("c_mktsegment").alias("implementation_version"),
        F.array(F.struct(uid.alias("uid"), F.lit(True).alias("scu"), (k % 2 == 0).alias("scp"))).alias("roles"),
        F.array(F.struct(uid.alias("uid"), F.encode("c_name", "UTF-8").alias("data"))).alias("extended"),
    )
    written = pdu.write(rows, ["id"])
    back = pdu.parse(written, "id", "data").join(written, "id")
    first = F.get("contexts", F.lit(0))
    return back.select("id", "kind", "called", "calling", "application_context", "max_length", F.col("implementation_version").alias("version"), F.size("contexts").alias("n_contexts"), first.abstract_syntax.alias("abstract_syntax"), F.array_join(first.transfer_syntaxes, "|").alias("syntaxes"), F.get("roles", F.lit(0)).scp.alias("scp"), F.hex(F.get("extended", F.lit(0)).data).alias("extended"), pdu.too_long(F.col("data"), F.col("max_length")).alias("too_long"))


@query("""SELECT p_partkey AS association, '1.2.' || p_size AS sop_class, '1.3.' || p_partkey AS sop_instance, CAST(7 AS BIGINT) AS message_id, p_name || '|' || p_brand AS text, 0 AS status FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, '1.2.' || p_size, '1.3.' || p_partkey, 7, 'second', 0 FROM part WHERE p_partkey % 2 = 1""")
def store_loop(spark, sf_dir):
    """Parts of commands and of data become instances; what a release cuts off, or no command asked for, does not."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").withColumns({"c": F.concat(F.lit("1.2."), "p_size"), "i": F.concat(F.lit("1.3."), k), "m": F.lit(7)})
    commands = codec.encode_datasets(elements_of(rows, "p_partkey", {"c": (M.SOP_CLASS, "UI"), "i": (M.SOP_INSTANCE, "UI"), "m": (M.MESSAGE_ID, "US")}), explicit=False)
    part = lambda seq, kind, data, last: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), data.alias("data"), F.lit(last).alias("is_last"))
    text = lambda c: F.encode(c, "UTF-8")
    first = F.array(part(0, "command", F.substring("data", 1, 10), False), part(1, "command", F.substring(F.col("data"), F.lit(11), F.octet_length("data")), True), part(2, "data", text(F.col("p_name")), False))
    end = F.when(k % 4 == 0, F.array(part(3, "release", text(F.lit("")), False))).otherwise(F.array(part(3, "data", text(F.concat(F.lit("|"), "p_brand")), True), part(4, "data", text(F.lit("not asked for")), True)))
    second = F.when(k % 2 == 1, F.array(part(5, "command", F.col("data"), True), part(6, "data", text(F.lit("second")), True))).otherwise(F.array(part(5, "command", F.col("data"), True), part(6, "data", text(F.lit("never ended")), False)))
    parts = rows.join(commands, k == F.col("instance")).select(k.alias("association"), F.explode(F.concat(first, end, second)).alias("e")).select("association", "e.*")
    return M.store_loop(parts).withColumn("text", F.decode("data", "UTF-8")).drop("data")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'AE' || s_suppkey END AS title, 'host' || s_nationkey AS host, CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 11112 END AS INTEGER) AS port FROM supplier""")
def address_parts(spark, sf_dir):
    """``TITLE@host:port`` with and without title, and with a port that is none."""
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 2 == 0, F.concat(F.lit("AE"), k, F.lit("@"))).otherwise(""), F.lit("host"), "s_nationkey", F.when(k % 3 == 0, ":x").otherwise(":11112"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", address.parse(text).alias("a")).select("s_suppkey", "a.*")


@query("""SELECT o_orderkey, ['1.2.840.10008.5.1.4.1.1.2', '1.2.840.10008.5.1.4.1.1.4', '1.2.840.10008.1.1', '1.2.3', 'MRImageStorage'][o_orderkey % 5 + 1] AS given, ['1.2.840.10008.5.1.4.1.1.2', '1.2.840.10008.5.1.4.1.1.4', '1.2.840.10008.1.1', NULL, '1.2.840.10008.5.1.4.1.1.4'][o_orderkey % 5 + 1] AS uid,
['CT Image Storage', 'MR Image Storage', 'Verification SOP Class', NULL, 'MR Image Storage'][o_orderkey % 5 + 1] AS name, ['sop_class', 'sop_class', 'sop_class', NULL, 'sop_class'][o_orderkey % 5 + 1] AS kind FROM orders""")
def uid_lookup(spark, sf_dir):
    """Entries of the identifier dictionary by identifier or keyword."""
    given = F.element_at(F.array(*map(F.lit, ("1.2.840.10008.5.1.4.1.1.2", "1.2.840.10008.5.1.4.1.1.4", "1.2.840.10008.1.1", "1.2.3", "MRImageStorage"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return D.lookup_uid(table(spark, sf_dir, "orders").select("o_orderkey", given.alias("given")), "given").select("o_orderkey", "given", "uid", "name", "kind")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PATIENT' WHEN 1 THEN 'STUDY' WHEN 2 THEN NULL ELSE 'SERIES' END AS level, CASE c_custkey % 4 WHEN 0 THEN '1.2.840.10008.5.1.4.1.2.1.1' WHEN 2 THEN '1.2.840.10008.5.1.4.31' ELSE '1.2.840.10008.5.1.4.1.2.2.1' END AS model FROM customer""")
def query_model(spark, sf_dir):
    """The information model that a query goes to, and the level that it asks for if it says none."""
    k = F.col("c_custkey") % 4
    model = F.when(k == 0, "patient").when(k == 2, "worklist").otherwise("study")
    given = F.when(k == 3, "SERIES")
    return table(spark, sf_dir, "customer").select("c_custkey", N.retrieve_level(model, given).alias("level"), N.find_model(model).alias("model"))


@query("""WITH p AS (SELECT c_nationkey, count(*) AS offered, count(*) FILTER (WHERE c_custkey % 3 = 0) AS accepted, count(DISTINCT (c_mktsegment, c_custkey % 2)) AS pairs FROM customer GROUP BY c_nationkey) SELECT c_nationkey, offered, accepted, pairs FROM p""")
def association_counts(spark, sf_dir):
    """For each association: contexts offered and accepted, and the distinct pairs of class and syntax that its files need."""
    k = F.col("c_custkey")
    proposed = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (k % 2).alias("ts"), F.when(k % 3 == 0, "A").otherwise("Z").alias("sop_class"), F.array(F.lit("a")).alias("transfer_syntaxes"))
    answered = N.negotiate(proposed, spark.createDataFrame([("A", ["a"])], "sop_class string, syntaxes array<string>"))
    return N.association_counts(answered, ["c_nationkey"], ["c_mktsegment", "ts"])
