import re
from pathlib import Path

from pyspark.sql import functions as F

from pagemine.operators.mining import mine_url_rules
from pagemine.plans.train import train_sites
from pagemine.streaming import jobs

ROOT = Path(__file__).resolve().parent.parent


def test_streamed_rules_equal_batch_rules(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    pages = [(i, f"http://h{i % 2}/news/{1000 + i}.html", "") for i in range(12)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for part in range(3):
        frame.where(F.col("page_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.page_stream(spark, source, files_per_batch=1)
        urls = stream.select(F.regexp_extract("url", "//([^/]+)", 1).alias("site"), "url")
        jobs.stream_train(urls, store, str(tmp_path / "state")).awaitTermination()
    batch = mine_url_rules(frame.select(F.regexp_extract("url", "//([^/]+)", 1).alias("site"), "url"))
    # the store holds states, whose rows do not grow with URLs that look alike, and no URL
    assert not (tmp_path / "store" / "urls").exists()
    key = ["site", "regex", "support", "rank"]
    assert sorted(map(tuple, jobs.latest_rules(spark, store).select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_repeated_urls_count_once_and_rules_are_upserted(spark, tmp_path):
    source, store, table = (str(tmp_path / name) for name in ("in", "store", "table"))
    for at, urls in enumerate((["http://a/n/1", "http://a/n/2"], ["http://a/n/2", "http://a/n/3", "http://b/x"], ["http://a/n/1"])):
        rows = [(i, u, "") for i, u in enumerate(urls)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(source)
        stream = jobs.page_stream(spark, source, files_per_batch=1).select(F.regexp_extract("url", "//([^/]+)", 1).alias("site"), "url")
        jobs.stream_train(stream, store, str(tmp_path / "state"), site_rules=table, now=F.lit("2020-01-01 00:00:00")).awaitTermination()
    assert {(r.site, r.regex, r.support) for r in jobs.latest_rules(spark, store).collect()} == {("a", r".*/n/\d+", 3), ("b", r".*/x", 1)}
    rows = spark.read.parquet(table)
    last = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    assert {(r.web_name, r.article_regex, r.version) for r in last.collect()} == {("a", r".*/n/\d+", 2), ("b", r".*/x", 2)}


def test_urls_are_processed_once_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for _ in range(2):
        rows = [(i, f"u{i}", "") for i in range(5)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_dedup_urls(jobs.page_stream(spark, source).select("url"))
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        sink.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_train_sites_end_to_end(spark):
    def page(at, site):
        html = (f'<html><head><title>Story {at} today</title></head><body><div class="art"><h1>Story {at} today</h1><p>2020-01-0{at % 9 + 1} 10:00</p>'
                f"<p>Some, long text {at}; with marks. And more, more.</p></div></body></html>")
        return (at, site, f"http://{site}/news/{100 + at}.html", html)

    rows = [page(at, "a.example") for at in range(6)] + [page(at, "b.example") for at in range(6, 8)]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, html string")
    done = train_sites(pages, "job", F.lit("2020-01-02 00:00:00"), max_pages=4)
    assert done.records.groupBy("site").count().where("site = 'a.example'").first()["count"] == 4
    rules = {r.web_name: r for r in done.site_rules.collect()}
    assert rules["a.example"].article_regex == r".*/news/10\d+\.html" and rules["b.example"].version == 1
    configs = {r.web_name: r for r in done.site_configs.collect()}
    assert configs["a.example"].sample == "http://a.example/news/100.html" and '"h1' not in configs["a.example"].config
    assert r"//div[@class=\"art\"]" in configs["b.example"].config


def test_mining_reads_urls_once_and_aggregates_numbers(spark):
    urls = spark.createDataFrame([("s", "http://s/a/1")], "site string, url string")
    plan = mine_url_rules(urls)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Scan") == 1


def test_core_stays_on_the_executors():
    banned = re.compile(r"\.collect\(\)|toPandas|localCheckpoint|\bF\.udf|pandas_udf|applyInPandas|mapInPandas|\.rdd\b|F\.rand\(|current_timestamp")
    for path in (ROOT / "pagemine").rglob("*.py"):
        assert not banned.search(path.read_text()), path
