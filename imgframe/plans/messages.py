"""Queries on elements, negotiation and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags
from ..operators import elements as E
from ..operators import negotiation as N
from ..operators.dictionary import TRANSFER_SYNTAXES, transfer_syntaxes
from ..streaming import messages as M
from .registry import query, table

ATTRIBUTES = {"c_name": (0x00100010, "PN"), "c_mktsegment": (0x00080060, "CS"), "c_nationkey": (0x00080090, "PN"), "c_acctbal": (0x00101010, "AS")}


def _elements(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).withColumn("c_acctbal", F.format_string("%.2f", "c_acctbal"))
    return E.elements_of(rows, "c_custkey", ATTRIBUTES)


def _texts(elements):
    return elements.select("instance", "path", "vr", F.concat_ws("\\", "values").alias("text"))


SEGMENT_SQL = "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END"


@query(f"""SELECT c_custkey AS instance, path, vr, text FROM (SELECT c_custkey, '(0010,0010)' AS path, 'LO' AS vr, 'X' AS text FROM customer UNION ALL SELECT c_custkey, '(0008,0060)', 'CS', coalesce({SEGMENT_SQL}, 'OT') FROM customer
UNION ALL SELECT c_custkey, '(0010,1010)', 'AS', printf('%.2f', c_acctbal) FROM customer UNION ALL SELECT c_custkey, '(0020,0013)', 'IS', '1' FROM customer)""")
def ops_set_replace_remove(spark, sf_dir):
    ops = [E.Operation("set_vr", "(0010,0010)", "LO"), E.Operation("set", "(0010,0010)", "X"), E.Operation("set_if_missing", "(0008,0060)", "OT", "CS"), E.Operation("remove", "(0008,0090)"), E.Operation("replace", "(0099,0001)", "never"), E.Operation("set", "(0020,0013)", "1", "IS")]
    return _texts(E.apply(_elements(spark, sf_dir), ops))


@query(f"""SELECT c_custkey AS instance, path, vr, text FROM (SELECT c_custkey, '(0010,0010)' AS path, 'PN' AS vr, c_name || chr(92) || 'B' AS text FROM customer UNION ALL SELECT c_custkey, '(0008,0060)', CASE WHEN c_custkey % 5 <> 0 THEN 'CS' ELSE 'LO' END, coalesce({SEGMENT_SQL} || chr(92) || '7', '7') FROM customer
UNION ALL SELECT c_custkey, '(0010,1010)', 'AS', '' FROM customer UNION ALL SELECT c_custkey, '(0008,0090)', 'PN', CAST(c_nationkey AS VARCHAR) FROM customer)""")
def ops_push_truncate(spark, sf_dir):
    path = "(0010,0010)"
    ops = [E.Operation("push", path, "B"), E.Operation("push", path, "C"), E.Operation("truncate", path, 2), E.Operation("push", "(0008,0060)", 7, "LO"), E.Operation("empty", "(0010,1010)")]
    return _texts(E.apply(_elements(spark, sf_dir), ops))


@query(f"""SELECT c_custkey AS instance, 'ANONYMOUS' AS name, {SEGMENT_SQL} AS modality, CAST(NULL AS VARCHAR) AS physician, 'YES' AS removed FROM customer""")
def anonymize(spark, sf_dir):
    out = E.anonymize(_elements(spark, sf_dir))
    return E.wide(out, {"name": "(0010,0010)", "modality": "(0008,0060)", "physician": "(0008,0090)", "removed": "(0012,0062)"})


@query("""SELECT event_id AS instance, '(0010,0010)' AS path, event_type || CASE WHEN event_id % 2 = 0 THEN ' new' ELSE ' old' END AS text FROM events UNION ALL SELECT event_id, '(0008,0060)', printf('%.2f', value) FROM events
UNION ALL SELECT event_id, '(0020,0013)', CAST(user_id AS VARCHAR) FROM events WHERE event_id % 2 = 0""")
def upsert_extend(spark, sf_dir):
    """Each event is an instance; every second one is extended with elements, of which one takes another's place."""
    events = table(spark, sf_dir, "events").withColumns({"old": F.concat("event_type", F.lit(" old")), "new": F.concat("event_type", F.lit(" new")), "v": F.format_string("%.2f", "value")})
    old = E.elements_of(events, "event_id", {"old": (0x00100010, "PN"), "v": (0x00080060, "CS")})
    new = E.elements_of(events.where("event_id % 2 = 0"), "event_id", {"new": (0x00100010, "PN"), "user_id": (0x00200013, "IS")})
    return _texts(E.upsert(old, new)).drop("vr")


@query("""SELECT user_id AS instance, path, 'DS' AS vr, printf('%.2f', value) AS text
FROM (SELECT *, '(001' || CAST(regexp_extract(props, '[0-9]+') AS BIGINT) // 25 * 2 || ',' || lpad(CAST(ascii(event_type) AS VARCHAR), 4, '0') || ')' AS path FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, path ORDER BY event_id % 10 = 0 DESC, ts DESC, event_id DESC) = 1""")
def upsert_events(spark, sf_dir):
    """Each event is an element of its user; every tenth is new. The last new one of a path stands, else the last old one."""
    group = F.floor(F.regexp_extract("props", "[0-9]+", 0).cast("long") / 25) * 2
    path = F.concat(F.lit("(001"), group, F.lit(","), F.lpad(F.ascii("event_type"), 4, "0"), F.lit(")"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("instance"), path.alias("path"), F.lit("DS").alias("vr"), F.array(F.format_string("%.2f", "value")).alias("values"), "ts", "event_id")
    rows = rows.withColumn("tag", tags.parse_tag(F.col("path")))
    new = F.col("event_id") % 10 == 0
    return _texts(E.upsert(rows.where(~new), rows.where(new), ["ts", "event_id"]))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def store_last_write_wins(spark, sf_dir):
    return E.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(f"""SELECT c_custkey AS instance, path FROM (SELECT c_custkey, '(0008,0090)' AS path FROM customer UNION ALL SELECT c_custkey, '(0010,0010)' FROM customer UNION ALL SELECT c_custkey, '(0008,0060)' FROM customer WHERE {SEGMENT_SQL} IS NOT NULL)""")
def early_stop_scan(spark, sf_dir):
    return E.read_until(_elements(spark, sf_dir), 0x00100010, inclusive=True).select("instance", "path")


@query("SELECT p_partkey AS instance, CAST(593921 + (p_partkey % 2) * 256 AS BIGINT) AS tag, CASE WHEN p_partkey % 2 = 0 THEN 'CREATOR ' || p_size END AS creator FROM part")
def private_element_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    row = lambda tag, value: part.select(F.col("p_partkey").alias("instance"), F.lit("").alias("path"), tag.cast("long").alias("tag"), F.lit("LO").alias("vr"), F.array(value).alias("values"))
    both = row(F.lit(0x00090010), F.concat(F.lit("CREATOR "), "p_size")).unionByName(row(F.lit(0x00091001) + F.col("p_partkey") % 2 * 256, F.lit("v")))
    return E.private_elements(both).select("instance", "tag", "creator")


CONTEXTS = ((1, "A", "1.2.840.10008.1.2"), (3, "A", "1.2.840.10008.1.2.1"), (5, "A", "1.2.840.10008.1.2.5"), (7, "B", "1.2.840.10008.1.2"), (9, "B", "1.2.840.10008.1.2.4.50"))
FILE_TS = ("1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.50")


@query(f"""WITH c AS (SELECT * FROM (VALUES {", ".join(map(str, CONTEXTS))}) AS c(context_id, sop_class, ts)), f AS (SELECT o_orderkey AS file, ['A', 'B', 'C'][o_orderkey % 3 + 1] AS sop_class, {list(FILE_TS)}[o_orderkey % 4 + 1] AS ts FROM orders)
SELECT file, first(context_id ORDER BY p, context_id) FILTER (WHERE p IS NOT NULL) AS context_id FROM (SELECT file, context_id, CASE WHEN c.ts = f.ts THEN 0 WHEN f.ts IN ('1.2.840.10008.1.2.1', '1.2.840.10008.1.2.2') AND c.ts = '1.2.840.10008.1.2.1' THEN 1
WHEN f.ts IN ('1.2.840.10008.1.2.1', '1.2.840.10008.1.2.2') AND c.ts = '1.2.840.10008.1.2' THEN 2 END AS p FROM f LEFT JOIN c USING (sop_class)) GROUP BY file""")
def presentation_context_pick(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (k % n + 1).cast("int"))
    files = table(spark, sf_dir, "orders").select(k.alias("file"), pick("ABC", 3).alias("sop_class"), pick(FILE_TS, 4).alias("ts")).withColumn("codec_free", F.col("ts").isin(*FILE_TS[:2]))
    return N.pick_context(files, spark.createDataFrame(list(CONTEXTS), "context_id int, sop_class string, ts string")).select("file", "context_id")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN NULL ELSE NULL END AS accepted, CASE c_custkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'transfer syntaxes not supported' ELSE 'abstract syntax not supported' END AS reason FROM customer""")
def negotiate_contexts(spark, sf_dir):
    k = F.col("c_custkey") % 3
    proposed = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 2, "Z").otherwise("A").alias("sop_class"), F.when(k == 0, F.array(F.lit("x"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("x"))).alias("transfer_syntaxes"))
    return N.negotiate(proposed, spark.createDataFrame([("A", ["a", "b"])], "sop_class string, syntaxes array<string>")).select("c_custkey", "accepted", "reason")


STATUSES = (0, 0xFF00, 0xFF01, 0xFE00, 0xB000, 0xA801, 0x0122, 0xC001)


@query(f"""WITH s AS (SELECT event_id, {list(STATUSES)}[event_id % 8 + 1] AS s FROM events) SELECT event_id, CASE WHEN s = 0 THEN 'success' WHEN s IN (65280, 65281) THEN 'pending' WHEN s = 65024 THEN 'cancel' WHEN s // 4096 = 11 THEN 'warning' ELSE 'failure' END AS kind,
CASE s WHEN 43009 THEN 'move destination unknown' WHEN 290 THEN 'class not supported' END AS text FROM s""")
def status_classify(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", N.status_kind(F.col("s")).alias("kind"), N.status_text(F.col("s")).alias("text"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 131072 ELSE least(s_suppkey % 4 * 60000, 131072) END AS BIGINT) AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'called AE title not recognized' END AS refused FROM supplier")
def peer_max_pdu(spark, sf_dir):
    k = F.col("s_suppkey")
    refused = N.admit(F.lit("ME"), F.when(k % 2 == 0, "YOU").otherwise("ME "), "ME", F.lit(1), F.lit("1.2.840.10008.3.1.1.1"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.peer_max_pdu(k % 4 * 60_000).cast("long").alias("n"), refused.alias("refused"))


@query(f"""WITH t AS (SELECT * FROM (VALUES {", ".join(map(str, TRANSFER_SYNTAXES))}) AS t(uid, name, codec)), u AS (SELECT list(uid ORDER BY uid) AS u FROM t)
SELECT o_orderkey, a.uid AS source, b.uid AS target, CASE WHEN a.uid = b.uid THEN 'nothing' WHEN a.codec IN ('none', 'dataset') AND b.codec IN ('none', 'dataset') THEN 'header' WHEN a.codec NOT IN ('full', 'read', 'none', 'dataset') THEN 'cannot decode'
WHEN b.codec IN ('none', 'dataset') THEN 'decode' WHEN b.codec NOT IN ('full', 'write') THEN 'cannot encode' WHEN a.codec IN ('none', 'dataset') THEN 'encode' ELSE 'decode and encode' END AS step
FROM orders, u JOIN t a ON a.uid = u[o_orderkey % len(u) + 1] JOIN t b ON b.uid = u[o_custkey % len(u) + 1]""")
def transcode_decision(spark, sf_dir):
    """What it takes to change each order's syntax to that of its customer; the registry has both."""
    uids = F.array(*[F.lit(uid) for uid in sorted(uid for uid, *_ in TRANSFER_SYNTAXES)])
    n = len(TRANSFER_SYNTAXES)
    at = lambda k: F.element_at(uids, (F.col(k) % n + 1).cast("int"))
    entry = lambda name: F.broadcast(transfer_syntaxes(spark).select(F.col("uid").alias(name), F.struct("uid", "codec").alias(f"{name}_entry")))  # noqa: E731  a fixed registry
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", at("o_orderkey").alias("source"), at("o_custkey").alias("target")).join(entry("source"), "source").join(entry("target"), "target")
    return pairs.select("o_orderkey", "source", "target", N.transcode_step(F.col("source_entry"), F.col("target_entry")).alias("step"))


@query("""SELECT doc_id, CAST(k AS INTEGER) AS seq, greatest(least(strlen(t) - k * 1012, 1012), 0) AS n, (k + 1) * 1012 >= strlen(t) AS is_last FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(0, greatest((strlen(coalesce(text, '')) + 1011) // 1012, 1))) AS k FROM documents)""")
def pdu_fragment(spark, sf_dir):
    out = M.fragment(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", N.MIN_PDU)
    return out.select("doc_id", "seq", F.octet_length("text").cast("long").alias("n"), "is_last")


@query("SELECT conv_id, CAST(0 AS BIGINT) AS message, string_agg(text, '' ORDER BY turn) AS text, true AS complete FROM conversations GROUP BY conv_id")
def pdu_reassemble(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("end"))
    marked = rows.join(ends, "conv_id").select("conv_id", "turn", "text", (F.col("turn") == F.col("end")).alias("is_last"))
    return M.reassemble(marked, ["conv_id"], ["turn"], "text")


@query("""WITH m AS (SELECT user_id, event_id, value, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS message, event_type FROM events)
SELECT user_id, CAST(message AS BIGINT) AS message, count(*) AS n, bool_or(event_type = 'error') AS complete FROM m GROUP BY ALL""")
def pdu_islands(spark, sf_dir):
    last = F.col("event_type") == "error"
    rows = table(spark, sf_dir, "events").withColumn("message", M.message_number(["user_id"], ["ts", "event_id"], last))
    return rows.groupBy("user_id", "message").agg(F.count("*").alias("n"), F.max(last).alias("complete"))
