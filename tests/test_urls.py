from pyspark.sql import functions as F

from pagemine.functions import urls as U
from pagemine.operators import links as L


def test_url_age(spark):
    urls = [
        ("http://a.cn/2020-1-2/x.html", True), ("http://a.cn/201901/t20190105_1.html", False), ("http://a.cn/201906/", False),
        ("http://a.cn/20201399/x", True), ("http://a.cn/2021/01/02/x", True), ("http://a.cn/x.html", True),
    ]
    df = spark.createDataFrame(urls, "url string, kept boolean")
    kept = {r.url for r in L.filter_recent(df, F.lit("2020-06-30").cast("date")).collect()}
    assert kept == {url for url, keep in urls if keep}


def test_anchor_texts(spark):
    df = spark.createDataFrame([("下一页",), ("12",), ("",), ("正文标题",), ("²",)], "link_text string")
    assert {r[0] for r in L.filter_anchor_text(df).collect()} == {"", "正文标题", "²"}


def test_file_urls(spark):
    urls = ["http://h/a/b.pdf", "http://h/a/b.PDF", "http://h/a/b.Pdf", "http://h/pdf/x.html", "http://h/x?f=pdf"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url for r in L.filter_file_urls(df).collect()} == {urls[2], urls[4]}


def test_trivial_rule_routes_html_pages_to_articles_only(spark):
    df = spark.createDataFrame([("http://h/a.html",), ("http://h/list/",)], "url string")
    routes = {r.url: r.route for r in L.route_links(df, "html$").collect()}
    assert routes == {"http://h/a.html": "article", "http://h/list/": "follow"}
    assert {r.route for r in L.route_links(df, ".*").collect()} == {"article"}


def test_site_root_ignores_the_suffix_inside_the_host(spark):
    df = spark.createDataFrame([("http://www.community.com/x?y",)], "url string")
    assert df.select(U.site_root(F.col("url"))).first()[0] == "http://www.community.com"


def test_resolve(spark):
    cases = [
        ("http://h/a/b.html?x=1#t", "c.html", "http://h/a/c.html"), ("http://h/a/b.html?x=1#t", "?y", "http://h/a/b.html?y"),
        ("http://h/a/b.html?x=1#t", "#z", "http://h/a/b.html?x=1#z"), ("http://h", "x", "http://h/x"),
        ("http://h/a/b/c", "../../../x/./y?u=/../", "http://h/x/y?u=/../"), ("https://h/a", "//o/p", "https://o/p"),
        ("http://h/a", "mailto:x@y", "mailto:x@y"), ("http://h/a/b", "..", "http://h/"), ("http://h/a/b#f", "", "http://h/a/b"),
    ]
    df = spark.createDataFrame(cases, "base string, href string, want string")
    for row in df.withColumn("got", U.resolve_url(F.col("base"), F.col("href"))).collect():
        assert row.got == row.want, row


def test_registered_domain_takes_the_longest_suffix(spark):
    df = spark.createDataFrame([("http://www.bjmy.gov.cn/x",), ("http://a.b.cn/",), ("http://localhost/x",)], "url string")
    suffixes = spark.createDataFrame([("cn",), ("gov.cn",)], "suffix string")
    found = {r.host: (r.subdomain, r.label, r.domain) for r in L.registered_domain(df, suffixes).collect()}
    assert found["www.bjmy.gov.cn"] == ("www", "bjmy", "bjmy.gov.cn")
    assert found["a.b.cn"] == ("a", "b", "b.cn")
    assert found["localhost"][2] == "localhost"


def test_links_keep_page_order_and_skip_scripts(spark, make_pages):
    html = '<script>"<a href=/no>"</script><A HREF="/1?a=1&amp;b=2">one <b>x</b></A><a name=q>n</a><area href=/2><a href=/3>three'
    rows = L.extract_links(make_pages([html])).orderBy("pos").collect()
    assert [(r.pos, r.href, r.link_text) for r in rows] == [(0, "/1?a=1&b=2", "one x"), (1, "/2", ""), (2, "/3", "three")]


def test_frontier_does_not_expand_visited_pages(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.hop for r in L.link_frontier(starts, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_cap_is_exact_with_one_hot_site(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("site"), F.col("id").alias("page_id"))
    kept = L.cap_pages_per_site(df, 100)
    assert kept.where("site = 'hot'").agg(F.count("*"), F.max("page_id")).first()[:] == (100, 99)
    assert kept.count() == 200


def test_sample_takes_half_per_route(spark):
    rows = [(1, "article", f"u{i}", i) for i in range(5)] + [(1, "follow", f"v{i}", i) for i in range(1)]
    df = spark.createDataFrame(rows, "page_id int, route string, url string, pos int")
    first = sorted(r.url for r in L.sample_links(df).collect())
    assert len(first) == 2 and first == sorted(r.url for r in L.sample_links(df.repartition(3)).collect())
