import math

from imgframe.llm.queries import op7_urls
from imgframe.llm.url_reputation import judge_urls, page_outcomes, with_levels

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "spam.org", ""))


def judged(spark, pages, outcomes):
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, host string")
    labels = spark.createDataFrame(outcomes, "page_id long, bad int")
    return {r.page_id: r for r in judge_urls(frame, labels, RULES).collect()}


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("http://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        2: ("http://a.example.com/en/8#y", "a.example.com", "/en/8", "com/en/", "block"),
        3: ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        4: ("x://spam.org", "spam.org", "", "spam.org", "block"),
        5: ("x://b.spam.org?q", "b.spam.org", "", "spam.org", "block"),
        6: ("no scheme", "", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("a://b://c/d", "b:", "//c/d", None, "allow"),
        9: ("https://ÄX.net:80/\n?", "Äx.net:80", "/\n", None, "allow"),
        10: ("", "", "", None, "allow"),
    }
    got = judged(spark, [(k, v[0]) for k, v in urls.items()], [])
    assert {k: (urls[k][0], r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == urls


def test_shrinking(spark):
    """Many bad pages block a host, few do not; a bad domain pulls its unlabelled hosts down less than their own pages would."""
    pages, outcomes = [], []

    def add(host, bad, good, unlabelled=1):
        for kind, n in ((1, bad), (0, good), (None, unlabelled)):
            for _ in range(n):
                pages.append((len(pages), f"http://{host}/"))
                if kind is not None:
                    outcomes.append((len(pages) - 1, kind))

    for i in range(30):
        add(f"www.good{i}.net", 1, 20)
    add("www.bad.net", 60, 2)
    add("new.bad.net", 0, 0)
    add("once.good1.net", 1, 0)
    got = judged(spark, pages, outcomes)
    by_host = {r.host: r for r in got.values()}
    assert by_host["www.bad.net"].verdict == "block"
    assert by_host["www.good3.net"].verdict == by_host["once.good1.net"].verdict == "allow"
    assert by_host["www.good3.net"].bound < by_host["new.bad.net"].bound < by_host["www.bad.net"].bound
    assert not any(math.isnan(r.bound) for r in got.values())


def test_no_rows(spark):
    assert judged(spark, [], [(1, 1)]) == {}


def test_outcomes_are_of_the_document_in_the_url(spark):
    urls = ["https://a.net/en/70?x=1", "https://a.net/en/71.html", "https://a.net/en/72/#top", "https://a.net/en/73", "https://a.net/about", "https://a.net/en/70/more", None]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string")
    labels = spark.createDataFrame([(70, 0, None), (71, 1, 1), (72, 1, 0), (73, None, None), (4, 0, 1), (5, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in page_outcomes(pages, labels).collect()) == [(0, 1), (1, 1), (2, 0)]


def test_labels_that_differ_by_host_block_it(spark, tmp_path):
    """All documents of one host are bad, those of the others good; by page_id the labels would be of unrelated documents."""
    pages = [(i, f"https://{'www.bad.net' if i % 5 == 0 else f'www.good{i % 5}.net'}/en/{1000 - i}") for i in range(200)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(1000 - i, int(i % 5 > 0), 0) for i in range(200)] + [(i, int(i % 5 != 1), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    verdicts = {(r.host, r.verdict) for r in op7_urls(spark, str(tmp_path)).collect()}
    assert verdicts == {("www.bad.net", "block"), *((f"www.good{i}.net", "allow") for i in range(1, 5))}


def test_levels(spark):
    """Suffixes of the caller's list, the longest that fits; numbers stand apart from each other and from names."""
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.z.city.kawasaki.jp": ("city.kawasaki.jp", "z.city.kawasaki.jp"), "a.com:80": ("com", "a.com"), "": ("", ""), "192.168.0.1": ("192.168.0.1",) * 2, "10.1.0.1:8080": ("10.1.0.1",) * 2, "[::1]": ("[::1]",) * 2}
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = with_levels(frame, ["co.uk", "jp", "kawasaki.jp", "city.kawasaki.jp"]).collect()
    assert {r.host: (r.suffix, r.domain) for r in got} == hosts


def test_numeric_hosts_share_no_prior(spark):
    pages = [(i, f"http://10.0.0.{1 + i % 2}/") for i in range(80)] + [(100 + i, f"http://www.good{i % 9}.net/") for i in range(200)]
    got = judged(spark, pages, [(i, 1) for i in range(0, 80, 2)] + [(100 + i, 0) for i in range(200)])
    assert {(r.host, r.verdict) for r in got.values() if r.host[0] == "1"} == {("10.0.0.1", "block"), ("10.0.0.2", "allow")}
