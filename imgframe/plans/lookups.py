"""Queries on dictionaries, transfer syntaxes and key=value matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import matching as M
from ..operators.matching import select_where
from .registry import query, table

SEED_SQL = ", ".join(str(row) for row in D.SEED)
CHOICES = (0x00080060, 0x60023000, 0x00203107, 0x00090010, 0x00110000, 0x00091001, 0x7FE00010, 0x00100010)


@query(f"""WITH d AS (SELECT * FROM (VALUES {SEED_SQL}) AS d(tag, mask, alias, vr)),
p AS (SELECT p_partkey, CAST([{", ".join(map(str, CHOICES))}][p_partkey % 8 + 1] AS BIGINT) AS tag FROM part),
f AS (SELECT p.*, coalesce(a.alias, b.alias, c.alias, CASE WHEN (p.tag // 65536) % 2 = 1 AND p.tag % 65536 BETWEEN 16 AND 255 THEN 'PrivateCreator' END, CASE WHEN p.tag % 65536 = 0 THEN 'GenericGroupLength' END) AS alias,
 coalesce(a.vr, b.vr, c.vr, CASE WHEN (p.tag // 65536) % 2 = 1 AND p.tag % 65536 BETWEEN 16 AND 255 THEN 'LO' END, CASE WHEN p.tag % 65536 = 0 THEN 'UL' END) AS vr
 FROM p LEFT JOIN d a ON a.tag = p.tag AND a.mask = 4294967295 LEFT JOIN d b ON b.mask = 4278255615 AND b.tag = p.tag & 4278255615 LEFT JOIN d c ON c.mask = 4294967040 AND c.tag = p.tag & 4294967040)
SELECT p_partkey, tag, alias, CASE WHEN vr IN ('Ox', 'Px') THEN 'OW' ELSE vr END AS relaxed, CASE WHEN vr NOT IN ('Ox', 'Px') THEN vr END AS exact FROM f""")
def dict_lookup(spark, sf_dir):
    tag = F.element_at(F.array(*[F.lit(c).cast("long") for c in CHOICES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    found = D.lookup(table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag")), D.dictionary(spark))
    return found.select("p_partkey", "tag", "alias", D.relaxed_vr(F.col("vr")).alias("relaxed"), D.exact_vr(F.col("vr")).alias("exact"))


@query("SELECT p_partkey, ['Modality', '0010,0010', 'modality', '(7FE0,0010)', 'PixelData'][p_partkey % 5 + 1] AS name, CAST([524384, 1048592, NULL, 2145386512, 2145386512][p_partkey % 5 + 1] AS BIGINT) AS tag FROM part")
def dict_by_name(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Modality", "0010,0010", "modality", "(7FE0,0010)", "PixelData"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return D.lookup_name(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), D.dictionary(spark)).select("p_partkey", "name", "tag")


TS_SQL = ", ".join(str(row) for row in D.TRANSFER_SYNTAXES)
UIDS = tuple(t[0] for t in D.TRANSFER_SYNTAXES)


@query(f"""WITH t AS (SELECT * FROM (VALUES {TS_SQL}) AS t(uid, name, codec)), o AS (SELECT o_orderkey, [{", ".join(repr(u) for u in (*UIDS, "1.2.3"))}][o_orderkey % {len(UIDS) + 1} + 1] AS uid FROM orders)
SELECT o_orderkey, name, codec IN ('none', 'dataset', 'full') AS fully_supported, codec = 'none' AS codec_free, codec IN ('full', 'read', 'write', 'stub') AS encapsulated, codec <> 'dataset_stub' AS can_decode_dataset
FROM o LEFT JOIN t USING (uid)""")
def ts_lookup(spark, sf_dir):
    uid = F.element_at(F.array(*map(F.lit, (*UIDS, "1.2.3"))), (F.col("o_orderkey") % (len(UIDS) + 1) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(uid, F.lit("\u0000")).alias("uid"))
    return D.lookup_transfer_syntax(rows).select("o_orderkey", "name", "fully_supported", "codec_free", "encapsulated", "can_decode_dataset")


CUSTOMER = {"PatientName": ("c_name", "PN"), "Modality": ("c_mktsegment", "CS"), "PatientID": ("c_custkey", "SV")}
ORDER = {"StudyDate": ("o_orderdate", "DA"), "Status": ("o_orderstatus", "CS"), "Priority": ("o_orderpriority", "LO"), "Number": ("o_orderkey", "SV")}


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def term_query_eq(spark, sf_dir):
    return select_where(table(spark, sf_dir, "customer"), ["Modality=AUTOMOBILE", "PatientName=", "Modality=BUILDING"], CUSTOMER).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer%1_'")
def term_query_wildcard(spark, sf_dir):
    return select_where(table(spark, sf_dir, "customer"), ["PatientName=Customer*1?"], CUSTOMER).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority LIKE '5%'")
def term_query_list(spark, sf_dir):
    return select_where(table(spark, sf_dir, "orders"), ["Priority=1-URGENT\\2-HIGH\\5*"], ORDER).select("o_orderkey")


@query("SELECT o_orderkey FROM orders")
def term_query_universal(spark, sf_dir):
    return select_where(table(spark, sf_dir, "orders"), ["Priority=", "StudyDate="], ORDER).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size = 15")
def term_query_numeric(spark, sf_dir):
    return select_where(table(spark, sf_dir, "part"), ["Size= 15"], {"Size": ("p_size", "US")}).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def term_query_combined(spark, sf_dir):
    """A partial date without a dash matches all that it covers."""
    return select_where(table(spark, sf_dir, "orders"), ["StudyDate=199602", "Status=O"], ORDER).select("o_orderkey")


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS studies, count(DISTINCT (l_orderkey, l_suppkey)) AS series, count(l_orderkey) AS instances
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY' GROUP BY c_custkey""")
def query_retrieve_level(spark, sf_dir):
    """Patients with the numbers of their studies, series and instances: patients first, then their studies, then instances of these."""
    patients = select_where(table(spark, sf_dir, "customer"), ["Modality=MACHINERY"], CUSTOMER).select("c_custkey")
    studies = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(patients, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    instances = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(studies, F.col("l_orderkey") == F.col("o_orderkey"))
    series = instances.groupBy("o_custkey", "l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    by_study = series.groupBy("o_custkey", "l_orderkey").agg(F.count("*").alias("n_series"), F.sum("n").alias("n_instances"))
    return by_study.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("studies"), F.sum("n_series").alias("series"), F.sum("n_instances").alias("instances"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_or(l_returnflag = 'R') AND bool_or(CAST(l_suppkey AS VARCHAR) LIKE '1%'))
SELECT DISTINCT l_orderkey AS instance FROM i WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%H%')""")
def match_in_items(spark, sf_dir):
    """Orders with one line that is both returned and of some suppliers, in items and items of items; two lines that do one each don't count (some lines have one number, and so one item)."""
    lines = table(spark, sf_dir, "lineitem")
    at = F.concat(F.lit("(0040,A730)["), (F.col("l_linenumber") - 1).cast("string"), F.lit("]."))
    row = lambda path, tag, vr, *values: F.struct(path.alias("path"), F.lit(tag).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.array(*values).cast("array<string>").alias("values"))
    each = F.array(row(F.concat(at, F.lit("(0040,A160)")), 0x0040A160, "UT", F.col("l_suppkey")), row(F.concat(at, F.lit("(0040,A168)")), 0x0040A168, "SQ"), row(F.concat(at, F.lit("(0040,A168)[0].(0008,0100)")), 0x00080100, "SH", F.col("l_linestatus")), row(F.concat(at, F.lit("(0040,A168)[1].(0008,0100)")), 0x00080100, "SH", F.col("l_returnflag")))
    nested = lines.select(F.col("l_orderkey").alias("instance"), F.explode(each).alias("e")).select("instance", "e.*")
    root = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), F.lit("(0010,0010)").alias("path"), F.lit(0x00100010).cast("long").alias("tag"), F.lit("PN").alias("vr"), F.array("o_orderpriority").alias("values"))
    terms = ["PatientName=*H*", "(0040,A730).(0040,A160)=1*", "(0040,A730).(0040,A168).(0008,0100)=R", "Modality="]
    return M.match_in_items(nested.unionByName(root), M.build_identifier(terms))


@query("""WITH q AS (SELECT c_custkey AS query, DATE '1992-01-01' + CAST(c_custkey * 37 % 2500 AS INTEGER) AS lo, CASE WHEN c_custkey % 50 > 0 THEN DATE '1992-01-01' + CAST(c_custkey * 37 % 2500 + c_custkey % 40 AS INTEGER) END AS hi, CASE WHEN c_custkey % 3 = 0 THEN 'F' END AS status FROM customer)
SELECT query, count(o_orderkey) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM q JOIN orders ON CAST(o_orderdate AS DATE) >= lo AND (hi IS NULL OR CAST(o_orderdate AS DATE) <= hi) AND (status IS NULL OR status = o_orderstatus) GROUP BY query""")
def match_many(spark, sf_dir):
    """A range of days for each customer, some open, some with a status, against all orders: totals of the orders by day meet the ranges, not the orders."""
    k = F.col("c_custkey")
    day = lambda n: F.date_add(F.lit("1992-01-01").cast("date"), n.cast("int"))
    lo = k * 37 % 2500
    queries = table(spark, sf_dir, "customer").where(k.isNotNull()).select(k.alias("query"), day(lo).alias("lo"), F.when(k % 50 > 0, day(lo + k % 40)).alias("hi"), F.when(k % 3 == 0, "F").alias("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    totals = {"n": (F.count("o_orderkey"), F.sum), "first": (F.min("o_orderkey"), F.min), "last": (F.max("o_orderkey"), F.max)}
    return M.match_totals(queries, orders, "o_orderdate", ("o_orderstatus",), ("query",), totals)
