"""Site rules end to end, and inputs that were once lost or misread."""

import json

from pyspark.sql import functions as F

from pagemine.operators import records as P
from pagemine.operators.density import measured_tree
from pagemine.operators.dom import with_page_ids
from pagemine.operators.links import extract_links, registered_domain
from pagemine.operators.selectors import drop_noise, selector_key
from pagemine.plans import train as train_module
from pagemine.plans.train import train_sites
from pagemine.sources import files, tables
from pagemine.streaming import jobs

RULES = "site string, field string, kind string, priority int, expr string"


def test_area_has_no_text(make_pages):
    links = extract_links(make_pages(['<map><area href="/2">tail text<p>more</p></map><a href="/3">three</a>'])).orderBy("pos").collect()
    assert [r.link_text for r in links] == ["", "three"]


def test_suffixes_of_any_length(spark):
    suffixes = spark.createDataFrame([("a.b.c.d.e",), ("e",)], "suffix string")
    hosts = spark.createDataFrame([("http://www.x.a.b.c.d.e/",), ("http://y.e/",), ("http://none.f/",)], "url string")
    got = {r.url: r.domain for r in registered_domain(hosts, suffixes).collect()}
    assert got == {"http://www.x.a.b.c.d.e/": "x.a.b.c.d.e", "http://y.e/": "y.e", "http://none.f/": "none.f"}
    none = registered_domain(hosts, suffixes.limit(0)).select("domain", "suffix").collect()
    assert {tuple(r) for r in none} == {("www.x.a.b.c.d.e", ""), ("y.e", ""), ("none.f", "")}


def test_noise_without_children_loses_its_own_end_tag(make_pages):
    pages = make_pages(['<body><div id="m"><div class="ad">x</div><p>y</p></div></body>', '<body><div id="n"><p class="ad">open</div><p>z</p></body>'])
    clean = drop_noise(pages, ['//*[@class="ad"]'])
    html = {r.page_id: r.html for r in clean.collect()}
    assert html[0] == '<body><div id="m"><p>y</p></div></body>' and html[1] == '<body><div id="n"></div><p>z</p></body>'
    nodes = {(r.page_id, r.tag): r for r in measured_tree(clean).where("kind = 'node'").collect()}
    assert nodes[0, "p"].parent_seq == nodes[0, "div"].seq


def test_pages_without_id_are_kept(spark):
    pages = spark.createDataFrame([(None, "u1", "<p>one</p>"), (None, "u2", "<p>two</p>"), (3, "u3", "<p>three</p>")], "page_id long, url string, html string")
    got = P.extract_records(pages, fields=["content"]).collect()
    assert {r.url for r in got} == {"u1", "u2", "u3"} and all(r.page_id is not None for r in got)


def test_rules_of_every_kind_by_site(spark):
    html = '<html><head><title>T</title></head><body><div class="art"><h1>Big headline</h1><p>Posted Monday by x, long text, really.</p></div></body></html>'
    rows = [(1, "a", "http://a/1", html), (2, "b", "http://b/1", html)]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, html string")
    rules = spark.createDataFrame([("a", "publish_date", "pattern", 0, r"Posted (\w+) by"), ("a", "noise_node", "noise", 0, "//h1")], RULES)
    a, b = P.extract_records(pages, rules, fields=["content", "publish_date"]).orderBy("page_id").collect()
    assert a.publish_date.regex == r"Posted (\w+) by" and b.publish_date.regex == ""
    assert "Big headline" not in a.content.value and "Big headline" in b.content.value


def test_link_lines_of_several_files_have_the_root_of_their_line(spark, tmp_path):
    for name, host, n in (("1", "http://b.example", 3), ("2", "https://a.example", 30)):
        (tmp_path / name).write_text("\n".join(f"{host}/news/{100 + i}.html" for i in range(n)) + "\n\nnohost\n")
    got = {(r.site, r.regex, r.support) for r in files.mine_link_lines(spark, str(tmp_path)).collect()}
    assert ("http://b.example", r"http://b.example/news/10\d+\.html", 3) in got
    assert any(site == "https://a.example" and regex.startswith("https://a.example/news/") for site, regex, _ in got)


def test_configs_are_read_back_and_keep_what_was_not_learned(spark):
    selectors = spark.createDataFrame([("s", "title", "selector", "//h1"), ("s", "author", "pattern", "(by .)")], "site string, field string, kind string, expr string")
    first = tables.publish_config(selectors, spark.createDataFrame([("s", 0)], "site string, version int"))
    samples = spark.createDataFrame([("s", "u", "{}")], "site string, sample string, sample_values string")
    published = tables.site_config_rows(first, samples, "one", F.lit("2020-01-01 00:00:00"))
    rules = tables.config_rules(published)
    assert {tuple(r) for r in rules.collect()} == {("s", "title", "selector", 0, "//h1"), ("s", "author", "pattern", 0, "(by .)")}
    learned = spark.createDataFrame([("s", "title", "selector", "//h2")], "site string, field string, kind string, expr string")
    second = tables.publish_config(learned, tables.current_configs(published).select("site", "version"), rules).first()
    assert second.version == 2
    assert json.loads(second.config) == {"title": {"XPATH": ["//h2"], "PATTERN": []}, "author": {"XPATH": [], "PATTERN": ["(by .)"]}}


def test_rules_of_kinds_that_were_not_learned_stay(spark):
    current = spark.createDataFrame([("s", "publish_date", "pattern", 0, "(a)"), ("s", "publish_date", "selector", 0, "//i"), ("s", "noise_node", "noise", 0, "//h1")], RULES)
    learned = spark.createDataFrame([("s", "publish_date", "selector", "//p", 1), ("s", "publish_date", "selector", "//q", 5)], "site string, field string, kind string, expr string, support long")
    made = tables.publish_config(learned, spark.createDataFrame([("s", 3)], "site string, version int"), current).first()
    assert made.version == 4 and json.loads(made.config) == {
        "publish_date": {"XPATH": ["//q", "//p"], "PATTERN": ["(a)"]}, "noise_node": {"XPATH": ["//h1"], "PATTERN": []},
    }
    samples = spark.createDataFrame([("s", "u", "{}")], "site string, sample string, sample_values string")
    again = tables.config_rules(tables.site_config_rows(spark.createDataFrame([made]), samples, "j", F.lit("2020-01-01 00:00:00")))
    assert ("s", "noise_node", "noise", 0, "//h1") in {tuple(r) for r in again.collect()}


def test_pages_with_equal_ids_give_a_record_each(spark):
    rows = [(1, "u1", "<body><p>first, text.</p><p>more, of it.</p></body>"), (1, "u2", "<body><p>second, text.</p><p>more, too.</p></body>"), (None, "u3", None)]
    got = P.extract_records(spark.createDataFrame(rows, "page_id long, url string, html string"), fields=["content"]).collect()
    assert {(r.url, r.content and r.content.value) for r in got} == {("u1", "first, text.\nmore, of it."), ("u2", "second, text.\nmore, too."), ("u3", None)}


def test_capped_pages_lose_none_without_id(spark):
    rows = [(None, "a", "u1", "x"), (None, "a", "u2", "y"), (3, "a", "u3", "z"), (3, "a", "u3b", "z"), (4, "b", "u4", "z"), (4, "b", "u4", "z")]
    pages = with_page_ids(spark.createDataFrame(rows, "page_id long, site string, url string, html string"))
    assert train_module._capped(pages, 10).count() == 6
    two = train_module._capped(pages, 2).collect()
    assert sum(r.site == "a" for r in two) == 2 and sum(r.site == "b" for r in two) == 2


def test_title_split_breadcrumb_and_image_rules_by_site(spark):
    def html(mark):
        crumb = f'<div class="nav"><a href="/n">News</a> {mark} <a href="/w">World</a></div>'
        story = "<h1>Big headline</h1><p>Posted by x, long text, really.</p><p>And more, of it.</p>"
        return f'<html><head><title>Big headline :: Site name</title></head><body>{crumb}<div class="art">{story}<img src="/i.png"></div><img class="top" src="/t.png"></body></html>'

    rows = [(1, "a", "http://a/1", html("/")), (2, "b", "http://b/1", html("/")), (3, "b", "http://b/2", html(">"))]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, html string")
    rules = spark.createDataFrame([
        ("a", "title", "pattern", 0, "::"), ("a", "channel", "pattern", 0, "[A-Za-z]+ ?/ ?[A-Za-z]+"), ("a", "origin_image_list", "selector", 0, '//img[@class="top"]/@src'),
    ], RULES)
    a, b, c = P.extract_records(pages, rules, fields=["title", "channel", "origin_image_list"]).orderBy("page_id").collect()
    assert a.title.value == "Big headline" and [x.channel_name for x in a.channel.value] == ["News", "World"]
    assert a.origin_image_list.value == ["/t.png"] and b.origin_image_list.value == ["/i.png"]
    assert not b.channel and [x.channel_name for x in c.channel.value] == ["News", "World"]


def test_only_selectors_that_a_page_may_hold_are_tried(spark):
    exprs = ['string(//div[@class="a b"]/h1[2])', "//ul//a/@href", '//p[@id="x"]//text()', "//div/..", "//*", "//div/*[@class='q']", '//td[@class="c"][3]']
    keys = [r[0] for r in spark.createDataFrame([(e,) for e in exprs], "e string").select(selector_key(F.col("e"))).collect()]
    assert keys == ["h1", "a", "p#x", None, None, None, "td.c"]
    html = '<html><head><title>T</title></head><body><div class="art"><h1>Big headline</h1><p id="m">Long text, really.</p></div></body></html>'
    pages = spark.createDataFrame([(1, "a", "u", html)], "page_id long, site string, url string, html string")
    many = [("a", "title", "selector", n, f'//h1[@id="t{n}"]') for n in range(3000)] + [("a", "title", "selector", 3000, '//div[@class="art"]/h1')]
    row = P.extract_records(pages, spark.createDataFrame(many, RULES), fields=["title"]).first()
    assert (row.title.xpath, row.title.value) == ('//div[@class="art"]/h1', "Big headline")


def test_a_second_run_uses_and_replaces_the_first(spark):
    def page(at):
        text = f'<div class="art"><h1>Story {at} today</h1><p>2020-01-0{at + 1} 10:00</p><p>Some, long text {at}; with marks. And more, more.</p></div>'
        return at, "a.example", f"http://a.example/news/{100 + at}.html", f"<html><head><title>Story {at} today</title></head><body>{text}</body></html>"

    pages = spark.createDataFrame([page(at) for at in range(4)], "page_id long, site string, url string, html string")
    one = train_sites(pages, "one", F.lit("2020-01-02 00:00:00"))
    two = train_sites(pages, "two", F.lit("2020-01-03 00:00:00"), site_rules=one.site_rules, site_configs=one.site_configs)
    assert {(r.job_id, r.version) for r in two.site_rules.collect()} == {("one", 1), ("two", 2)}
    configs = {r.job_id: r for r in two.site_configs.collect()}
    assert configs["two"].version == 2 and json.loads(configs["two"].config)["content"] == json.loads(configs["one"].config)["content"]
    assert json.loads(configs["two"].sample_values)["title"]["value"] == "Story 0 today"


def test_streamed_records_use_site_rules_gate_and_job(spark, tmp_path):
    good = '<html><head><title>T</title></head><body><div class="art"><h1>Big headline</h1><p>Posted 2020-01-02 by x, long text, really.</p></div></body></html>'
    rows = [(1, "http://a/1", good), (2, "http://a/2", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([("a", "title", "selector", 0, "//h1")], RULES)
    stream = jobs.page_stream(spark, str(tmp_path / "in"))
    site = F.regexp_extract("url", "//([^/]+)", 1)
    fields = ["title", "content", "publish_date", "channel"]
    jobs.stream_records(stream, str(tmp_path / "out"), str(tmp_path / "state"), fields, site, rules, job_id="j").awaitTermination()
    first, second = spark.read.parquet(str(tmp_path / "out")).orderBy("page_id").collect()
    assert (first.title.xpath, first.title.value, first.site, first.job_id) == ("//h1", "Big headline", "a", "j") and second.content is None
