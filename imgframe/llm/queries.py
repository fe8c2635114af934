"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_template import BODY, CONTROL_STRINGS, END, TURN, conversation_digests, format_conversations
from .decontaminate import decontaminate
from .html_text import extract_main_text
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .periodic_runs import periodic_runs, repeated_tail
from .piece_viterbi import piece_digests
from .suffix_dedup import remove_repeated_bytes
from .token_orc import encode_to_orc, token_digests
from .toxicity import fit_on_documents, held_out, score_toxicity
from .url_reputation import STRONGEST, TWO_LABEL_SUFFIXES, WEAKEST, judge_urls, page_outcomes
from .vptree import nearest
from .whitening import whitened_components

#: Files of public tokenizers; each query takes another path as a parameter.
TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: A conversation of control strings alone, put beside those of the table.
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return conversation_digests(format_conversations(rows.unionByName(planted)))


def op4_token_orc(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return token_digests(encode_to_orc(table(spark, sf_dir, "documents"), tokenizer))


def op5_vptree(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20, factor=factor)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: (verdict, host, path) of the rules that come before reputations.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_pieces(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_documents(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), number).alias("text"))
    out = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.withColumn("best", best).withColumn("lines", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened_components(table(spark, sf_dir, "embeddings"), F.col("embedding"), components=8, scale=1024, offset=100_000)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat": op3_chat,
    "op4_token_orc": op4_token_orc,
    "op5_vptree": op5_vptree,
    "op6_line_dedup": op6_line_dedup,
    "op7_urls": op7_urls,
    "op8_pieces": op8_pieces,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, s, s + least(len(w), 10) - 1) AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win)),
hit AS (SELECT p.doc_id, p.s, p.k, win.item_id FROM p JOIN win ON win.k = p.k AND list_slice(p.w, p.s, p.s + p.k - 1) = win.g),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT doc_id, n, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id"""

# Every pair that shares a shingle is counted, and labels move along links until none changes.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 3) - 1) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
h AS (SELECT doc_id, md5_number(array_to_string(g, ' ')) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reached) AS m FROM r GROUP BY node) USING (doc_id)"""

# A byte is two digits of h; a window of 50 bytes starts at each byte i; far is the last removed window's start up to a byte.
OP11_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM h)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, i FROM w JOIN m USING (g) WHERE least < doc_id),
b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS d FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM h)),
c AS (SELECT b.doc_id, b.i, d, coalesce(max(f.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) > b.i - 50, false) AS gone FROM b LEFT JOIN f USING (doc_id, i)),
r AS (SELECT doc_id, i, d, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM c)
SELECT h.doc_id, count(i) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE first) AS n_spans,
       sha256(unhex(coalesce(string_agg(d, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM h LEFT JOIN r USING (doc_id) GROUP BY h.doc_id"""

# A run of 12 or more words and two periods or more repeats six words at the distance of its period. Such pairs, one
# after the other, make up stretches; of several periods of one stretch the smallest counts. t is the table of crc32.
OP12_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, tab),
e AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS one, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM d),
x AS (SELECT r, n, i, w[1 + CASE WHEN one AND i >= a THEN a + (i - a) % (1 + (n - a) // k) ELSE i END] AS x FROM (SELECT *, unnest(range(n)) AS i FROM e)),
g AS (SELECT r, n, i, md5_number(concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o)) AS g FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
q AS (SELECT a.r, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.r = b.r AND a.g = b.g AND a.i < b.i AND b.i <= b.n - 6 AND 2 * (b.i - a.i) <= a.n),
s AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q) GROUP BY r, q, island),
u AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
c AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN c USING (r)"""

SPECIAL_SQL = "'" + "|".join([r"\\", *(re.sub(r"([][|/<>])", r"\\\1", c) for c in sorted(CONTROL_STRINGS, key=len, reverse=True))]) + "'"
ESCAPED_SQL = f"(length({{0}}) + len(regexp_extract_all({{0}}, {SPECIAL_SQL})))"

OP3_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{PLANTED_TEXT}'), (-1, 1, 'assistant', '{PLANTED_TEXT}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TURN + BODY + END)} + {ESCAPED_SQL.format("role")} + {ESCAPED_SQL.format("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

OP5_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""


def strength_sql(name: str, level: str, above: str, parent: str) -> str:
    """Two CTEs that give the prior strength of a level as ``name.s``; see ``url_reputation.strength``."""
    return f"""
{name}_by AS (SELECT a.{parent}, sum(l.n * pow(l.k / l.n - a.k / a.n, 2)) AS x, count(*) - 1 AS free, sum(l.n * l.n) AS q, any_value(a.n) AS up, any_value(a.k / a.n) AS p
              FROM {level} l JOIN {above} a USING ({parent}) WHERE l.n > 0 GROUP BY a.{parent}),
{name} AS (SELECT CASE WHEN coalesce(scale, 0) <= 0 OR over_ <= 0 THEN {STRONGEST} ELSE least({STRONGEST}, greatest({WEAKEST}, scale / over_ - 1)) END AS s
           FROM (SELECT sum(x - p * (1 - p) * free) AS over_, sum(p * (1 - p) * (up - q / up - free)) AS scale FROM {name}_by))"""


OP7_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
n AS (SELECT DISTINCT page_id, host, TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/([0-9]{{1,18}})(?:\.[A-Za-z]+)?/?$', 1), '') AS BIGINT) AS doc FROM u WHERE page_id IS NOT NULL),
o AS (SELECT host, CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS INTEGER) AS bad FROM n JOIN labels ON doc_id = doc WHERE quality IS NOT NULL OR toxic IS NOT NULL),
h0 AS (SELECT DISTINCT host, string_split(regexp_replace(host, ':\d*$', ''), '.') AS w FROM u),
h1 AS (SELECT host, CASE WHEN regexp_full_match(array_to_string(w, '.'), '\d+(\.\d+){{3}}') THEN 4 WHEN array_to_string(w[-2:], '.') IN {TWO_LABEL_SUFFIXES} THEN 2 ELSE 1 END AS c, w FROM h0),
h2 AS (SELECT host, array_to_string(w[-c:], '.') AS suffix, array_to_string(w[-(c + 1):], '.') AS domain FROM h1),
h AS (SELECT h2.host, suffix, domain, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM h2 LEFT JOIN o USING (host) GROUP BY ALL),
t AS (SELECT 0 AS one, sum(n) AS n, sum(k) AS k FROM h),
s AS (SELECT 0 AS one, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix, domain),
{strength_sql("s1", "s", "t", "one")},
{strength_sql("s2", "d", "s", "suffix")},
{strength_sql("s3", "h", "d", "domain")},
m1 AS (SELECT suffix, (s.k + s1.s * (t.k + 1) / (t.n + 2)) / (s.n + s1.s) AS m FROM s, s1, t),
m2 AS (SELECT domain, (d.k + s2.s * m1.m) / (d.n + s2.s) AS m FROM d JOIN m1 USING (suffix), s2),
p AS (SELECT host, h.k + s3.s * m2.m AS a, h.n - h.k + s3.s * (1 - m2.m) AS b FROM h JOIN m2 USING (domain), s3),
r AS (SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) AS r(verdict, rule_host, rule_path)),
f AS (SELECT page_id, host, path, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule, first(verdict ORDER BY length(rule_host || rule_path) DESC) AS own
      FROM u JOIN r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (page_id, host, path) JOIN p USING (host)"""

ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op3_chat": OP3_SQL, "op5_vptree": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_urls": OP7_SQL, "op10_near_dedup": OP10_SQL, "op11_suffix_dedup": OP11_SQL, "op12_periodic_runs": OP12_SQL}
