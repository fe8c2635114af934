"""URL filters by empirical-Bayes host reputation, with rules that come first.

Labelled pages are bad or good. A host's share of bad pages is shrunk towards its registered domain's, that towards
its suffix's and that towards the share of all pages, each through a beta-binomial prior. A prior's mean is the
posterior mean of the level above; its strength comes from the data, by moments: the more the shares of a level
differ within their parents beyond what chance gives, the less they are shrunk. A host is blocked if even a lower
bound of its posterior is over a threshold. Everything is DataFrame functions.

Counts are aggregated by host before anything is joined back to pages. The few hosts that hold most pages are joined
by broadcast and the others by a shuffle, so no host's pages meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .decontaminate import ascii_lower

#: Suffixes under which names are registered, if no other list is given; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk")

#: Hosts up to which all are broadcast (under 300 bytes each). Beyond, only those with over 1 / HOT_PARTS of all pages: fewer than HOT_PARTS hosts.
BROADCAST_HOSTS, HOT_PARTS = 50_000, 1_000

#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 10_000.0

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without host or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_levels(hosts: DataFrame, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``hosts`` with suffix and domain (suffix and one label more) of column host, ports left out.

    The suffix is the longest of ``suffixes`` that fits, else the last label. A number is no name: it stands apart,
    with itself as domain and suffix.
    """
    name = F.regexp_replace("host", r":\d*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    number = name.rlike(r"^\d+(\.\d+){3}$|^\[.*\]$")
    suffix, domain = last(1), last(2)
    by_size: dict[int, list[str]] = {}
    for s in suffixes:
        by_size.setdefault(s.count(".") + 1, []).append(s)
    for n in sorted(by_size):
        fits = last(n).isin(*by_size[n])
        suffix, domain = F.when(fits, last(n)).otherwise(suffix), F.when(fits, last(n + 1)).otherwise(domain)
    return hosts.withColumn("suffix", F.when(number, name).otherwise(suffix)).withColumn("domain", F.when(number, name).otherwise(domain))


def strength(level: DataFrame, above: DataFrame, parent: str) -> float:
    """A level's prior strength by moments, from rows (parent, n, k) of the level and of the one above."""
    p = F.col("k_up") / F.col("n_up")
    rows = level.join(above.select(parent, F.col("n").alias("n_up"), F.col("k").alias("k_up")), parent).where("n > 0")
    by = rows.groupBy(parent).agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, F.lit(2.0))).alias("x"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("q"), F.first("n_up").alias("n_up"), F.first(p).alias("p"))
    v, free = F.col("p") * (1 - F.col("p")), F.col("g") - 1
    got = by.agg(F.sum(F.col("x") - v * free).alias("over"), F.sum(v * (F.col("n_up") - F.col("q") / F.col("n_up") - free)).alias("scale")).first()
    if not got.scale or got.scale <= 0 or got.over <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, got.scale / got.over - 1))


def reputations(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, k, mean, bound) of distinct ``hosts`` from ``outcomes`` (host, bad 0 or 1): posterior mean and its lower bound, ``z`` deviations down."""
    own = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    counts = hosts.select("host").join(own, "host", "left").na.fill(0, ["n", "k"])
    counts = materialize(with_levels(counts, suffixes), "host-counts")
    total = counts.select(F.lit(0).alias("all"), "n", "k").groupBy("all").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    sums = lambda *by: counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes, domains = sums("suffix").withColumn("all", F.lit(0)), sums("suffix", "domain")
    first = total.first()
    root = (first.k + 1) / (first.n + 2) if first else 0.5
    s1, s2, s3 = strength(suffixes, total, "all"), strength(domains, suffixes, "suffix"), strength(counts, domains, "domain")
    suffixes = suffixes.select("suffix", ((F.col("k") + s1 * root) / (F.col("n") + s1)).alias("m1"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("k") + s2 * F.col("m1")) / (F.col("n") + s2)).alias("m2"))
    a, b = F.col("k") + s3 * F.col("m2"), F.col("n") - F.col("k") + s3 * (1 - F.col("m2"))
    mean = a / (a + b)
    bound = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return counts.join(domains, "domain").select("host", "n", "k", mean.alias("mean"), bound.alias("bound"))


def rules_by_host(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, rules): for each host that any rule fits, the rules for it or a domain above it, longest first."""
    table = hosts.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(above).alias("rule_host")).join(F.broadcast(table) if len(rules) <= BROADCAST_HOSTS else table, "rule_host")
    rule = F.struct((-F.char_length("rule_host") - F.char_length("rule_path")).alias("shortness"), F.col("rule_host").alias("host"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set(rule)).alias("rules"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """For each row of ``pages``: page_id, host, path, rule, verdict, bound.

    ``outcomes``: rows (page_id, bad 0 or 1), for any of the pages. ``rules``: (verdict, host, path); a rule fits
    its host and all subdomains where the url's path starts with the rule's, and the longest that fits wins. Where
    none does, the verdict is block if the lower bound of the host's posterior is over ``threshold``, else allow.
    ``suffixes``: those under which names are registered, besides single labels; give the whole public list in use.

    Defined cases: a null url or one without ``://`` has an empty host and path and is judged as the host ``""``;
    outcomes without page_id or bad are left out, several of a page each count; hosts without outcomes have the
    posterior of what is above them, without any outcomes an even one; repeated pages are judged each; other columns are ignored; no pages in, no rows out.
    """
    rows = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "url-hosts")
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").select("page_id", "bad")
    sizes = materialize(rows.groupBy("host").agg(F.count("*").alias("n_pages")), "url-host-sizes")
    counted = reputations(sizes, rows.select("page_id", "host").join(known, "page_id").select("host", "bad"), z, suffixes)
    hosts = sizes.join(counted.select("host", "bound"), "host", "left").join(rules_by_host(sizes, rules), "host", "left")
    hosts = materialize(hosts, "url-host-table")
    seen = hosts.agg(F.count("*").alias("n_hosts"), F.sum("n_pages").alias("n_pages")).first()
    if seen.n_hosts <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(hosts), "host", "left")
    else:
        hot = hosts.where(F.col("n_pages") * HOT_PARTS > seen.n_pages)
        often = rows.join(F.broadcast(hot), "host")
        seldom = rows.join(F.broadcast(hot.select("host")), "host", "left_anti").join(hosts, "host", "left")
        joined = often.unionByName(seldom)
    fits = F.filter(F.coalesce("rules", F.array().cast(hosts.schema["rules"].dataType)), lambda r: F.startswith(F.col("path"), r.path))
    rule = F.get(fits, F.lit(0))
    verdict = F.coalesce(rule.verdict, F.when(F.col("bound") > threshold, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.concat(rule.host, rule.path).alias("rule"), verdict.alias("verdict"), "bound")


def doc_of(url: Column) -> Column:
    """The number of the document that a url's path ends in, as ``/en/7``, ``/en/7/`` or ``/en/7.html``; null for any other path."""
    return F.regexp_extract(path_of(url), r"^/[^/]+/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1).try_cast("long")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of ``pages`` (page_id, url) from labels (doc_id, quality, toxic) of the document in a page's url: bad if of low quality or toxic.

    Pages without a document, and labels that are null in both, have no outcome; a repeated row counts as one page.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    known = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select("doc_id", bad.alias("bad"))
    documents = pages.select("page_id", doc_of(F.col("url")).alias("doc_id")).where("page_id IS NOT NULL AND doc_id IS NOT NULL").distinct()
    return documents.join(known, "doc_id").select("page_id", "bad")
