import json

import pytest
from pyspark.sql import functions as F

from pagemine.operators import records as P
from pagemine.operators.density import measured_tree
from pagemine.operators.docs import page_docs
from pagemine.operators.selectors import drop_noise
from pagemine.sources import files, tables

NEWS = """<html><head><title>国内要闻大事 - 新华网</title></head><body><header><video src="h.mp4"></video></header>
<div class="nav"><a href="/1">首页</a> > <a href="/2">新闻</a> > <a href="/3">国内</a></div>
<div id="main"><div class="art"><h1>国内要闻大事</h1><p>来源：新华网
 作者：张三 ，2018年1月2日 08:30</p><p>long, bold text. Long enough, really; yes!</p><p>more, text.<img src="a.png"><img src='b.png'></p>
<video src="v.mp4"></video></div><div class="comment-list"><p>c</p></div></div></body></html>"""


@pytest.fixture(scope="module")
def news(make_pages):
    return P.extract_records(make_pages([NEWS, ""])).orderBy("page_id").collect()


def test_all_fields(news):
    record = news[0]
    assert record.title.value == "国内要闻大事" and record.title.xpath == 'string(//div[@id="main"]/div[@class="art"]/h1)'
    assert record.content.xpath == 'string(//div[@id="main"]/div[@class="art"])' and record.content.value.endswith("more, text.")
    assert record.publish_date.value == "2018-01-02 08:30:00" and record.author.value == "作者：张三" and record.source.value == "新华网"
    assert record.editor == ("", "", "") and record.leadtitle.value == "" and record.subtitle.value.startswith("来源：新华网")
    assert record.origin_image_list.value == ["a.png", "b.png"] and record.video_url.value == "v.mp4"
    assert [(c.channel_href, c.channel_name, c.channel_nav) for c in record.channel.value] == [
        ("/1", "首页", "首页"), ("/2", "新闻", "首页>新闻"), ("/3", "国内", "首页>新闻>国内")]
    assert record.channel.xpath == '//div[@class="nav"]//a'
    assert record.htmlcontent.value.startswith('<div class="art"><h1>') and "video" not in record.htmlcontent.value


def test_empty_page_has_no_fields(news):
    assert news[1].title is None and news[1].content is None and news[1].channel is None


def test_site_rules_come_first(spark, make_pages):
    rules = spark.createDataFrame([
        ("a", "title", "selector", 0, "//h6"), ("a", "title", "selector", 1, "//head/title"), ("a", "author", "pattern", 0, "(作者：.)"),
        ("a", "content", "selector", 0, 'string(//div[@id="main"])'),
    ], "site string, field string, kind string, priority int, expr string")
    pages = make_pages([NEWS]).withColumn("site", F.lit("a"))
    record = P.extract_records(pages, rules, fields=["title", "author", "content", "video_url"]).first()
    assert record.title[:2] == ("//head/title", "国内要闻大事 - 新华网")
    assert record.author.value == "作者：张" and record.author.regex == "(作者：.)"
    assert record.content.xpath == 'string(//div[@id="main"])' and record.video_url.xpath == '//div[@id="main"]//video/@src'


def test_noise_is_cut(make_pages):
    pages = make_pages([NEWS])
    assert drop_noise(pages, []) is pages
    clean = drop_noise(pages, ['//div[@class="nav"]', "//h1"])
    tags = [r.tag for r in measured_tree(clean).where("kind = 'node'").collect()]
    assert "h1" not in tags and "a" not in tags and tags.count("p") == 3


def test_unknown_fields_are_refused(make_pages):
    with pytest.raises(ValueError, match="unknown fields"):
        P.extract_records(make_pages([NEWS]), fields=["headline"])


def test_gate(spark):
    schema = "id int, title struct<value:string>, content struct<value:string>, publish_date struct<value:string>, channel struct<value:array<string>>"
    rows = [(1, ("t",), ("c",), ("d",), (["x"],)), (2, ("t",), ("c",), ("d",), None), (3, ("t",), ("c",), ("",), ([],)), (4, None, ("c",), ("d",), (["x"],))]
    assert {r.id for r in P.quality_gate(spark.createDataFrame(rows, schema)).collect()} == {1, 2}


def test_upsert(spark):
    schema = "web_name string, job_id string, version int"
    first = spark.createDataFrame([("w", "1", 1)], schema)
    second = spark.createDataFrame([("w", "1", 2), ("w", "2", 1)], schema)
    rows = tables.upsert(first, second, tables.SITE_KEYS, "version").collect()
    assert sorted(tuple(r) for r in rows) == [("w", "1", 2), ("w", "2", 1)]


def test_config_and_missing_sample(spark):
    selectors = spark.createDataFrame([("s", "title", "selector", "//h1", 2), ("s", "title", "pattern", "[-_|]", 1)], "site string, field string, kind string, expr string, support int")
    versions = spark.createDataFrame([("s", 3), ("t", None)], "site string, version int")
    configs = tables.publish_config(selectors, versions)
    samples = spark.createDataFrame([("s", "u", "{}")], "site string, sample string, sample_values string")
    rows = {r.web_name: r for r in tables.site_config_rows(configs, samples, "j", F.lit("2020-01-01 00:00:00")).collect()}
    assert rows["s"].version == 4 and json.loads(rows["s"].config) == {"title": {"XPATH": ["//h1"], "PATTERN": ["[-_|]"]}}
    assert rows["t"].version == 1 and rows["t"].config == "{}" and rows["t"].sample is None


def test_records_round_trip(spark, news, tmp_path):
    schema = spark.createDataFrame(news).schema
    df = spark.createDataFrame(news, schema).withColumn("job_id", F.lit("a"))
    files.write_records(df, str(tmp_path / "r"))
    files.write_records(df.withColumn("job_id", F.lit("b")), str(tmp_path / "r"))
    back = files.read_records(spark, str(tmp_path / "r"), "b").orderBy("page_id").collect()
    assert len(back) == 2 and back[0].channel.value[1].channel_nav == "首页>新闻"
    files.write_links(df, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
