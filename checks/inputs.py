"""Inputs of the registered queries, derived from the given tables.

The stored pages hold no dates, Chinese labels, breadcrumbs or relative links, so
some inputs are composed from other tables; `sql_inputs.py` composes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemine.operators.links import registered_domain
from pagemine.sources.files import read_pages

SUFFIXES = ["com", "org", "net", "cn", "gov.cn", "com.cn", "co.uk", "uk", "example.net"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def suffix_table(spark: SparkSession, suffixes: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(s,) for s in suffixes or SUFFIXES], "suffix string")


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages with site = registered domain."""
    plain = suffix_table(spark, ["com", "org", "net"])
    found = registered_domain(pages(spark, sf), plain)
    return found.select("page_id", "url", "html", F.col("domain").alias("site"), "host")


def site_urls(spark: SparkSession, sf: str) -> DataFrame:
    return site_pages(spark, sf).select("site", "url", "page_id")


def order_clock() -> Column:
    """Order date plus a time of day; the stored dates are all at midnight."""
    seconds = F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400
    return F.timestamp_seconds(seconds)


def dated_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs whose path holds the order date in one of twelve layouts."""
    layouts = ["yyyy-M-d", "yyyy-M/d", "yyyy/M-d", "yyyy/M/d", "yyyyMM/d", "yyyy/MMdd", "yyyyMM-dd"]
    day = F.col("o_orderdate")
    tail = F.concat(F.lit("/"), F.col("o_orderkey"), F.lit(".html"))
    pick = F.col("o_orderkey") % 12
    path = F.when(pick == 0, F.date_format(day, layouts[0]))
    for at, layout in enumerate(layouts[1:], start=1):
        path = path.when(pick == at, F.date_format(day, layout))
    path = (
        path.when(pick == 7, F.concat(F.date_format(day, "yyyyMM"), F.lit("/t"), F.date_format(day, "yyyyMMdd"), F.lit("_1")))
        .when(pick == 8, F.date_format(day, "yyyyMMdd"))
        .when(pick == 9, F.date_format(day, "yyyyMM"))
        .when(pick == 10, F.concat(F.date_format(day, "yyyyMM"), F.lit("99")))
        .otherwise(F.lit("news"))
    )
    url = F.concat(F.lit("http://a.example.com/"), path, tail)
    return table(spark, sf, "orders").select("o_orderkey", url.alias("url"))


HREFS = ["/The/x.html", "news/a.html", "../up/b.html", "?q=1", "#f", "//other.example.com/z", "https://abs.example.org/p?x=1", "./here/../c.html"]


def base_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    """Every page URL with one of eight kinds of href."""
    kinds = F.array(*[F.lit(h) for h in HREFS])
    return pages(spark, sf).select(
        "page_id", "url", F.element_at(kinds, (F.col("page_id") % len(HREFS) + 1).cast("int")).alias("href")
    )


def page_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Three computed links per page: page_id -> (7 * page_id + k) mod page count."""
    rows = pages(spark, sf).select("page_id", "url")
    n = rows.count()
    steps = rows.select(F.col("url").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "page_id")
    targets = steps.select("src", ((F.col("page_id") * 7 + F.col("k")) % n).alias("page_id"))
    return targets.join(rows.select("page_id", F.col("url").alias("dst")), "page_id").select("src", "dst")


def rich_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages with a breadcrumb, a line of date, source and author, a video, images and heading ids."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    letters = F.translate("n_name", "_0123456789", "xabcdefghij")
    places = places.select(F.col("n_nationkey").alias("key"), "r_name", letters.alias("place"))
    day = F.date_add(F.lit("2019-01-01").cast("date"), F.col("page_id").cast("int"))
    head = F.concat(
        F.lit('<div class="crumb"><a href="/r">'), "r_name", F.lit('</a> > <a href="/n">'), "place",
        F.lit('</a></div><article><p class="meta">'), F.date_format(day, "yyyy年M月d日"), F.lit(" 08:30 来源："), "place",
        F.lit('！作者：张三 ，</p><video src="v'), "page_id", F.lit('.mp4"></video>'),
    )
    image = F.concat(F.lit('<img src="/i/'), "page_id", F.lit('.png"></p>'))
    heading = F.concat(F.lit('<h1 id="t'), "page_id", F.lit('">'))
    html = F.replace(F.replace(F.replace("html", F.lit("<article>"), head), F.lit("</p>"), image), F.lit("<h1>"), heading)
    rows = pages(spark, sf).withColumn("key", F.col("page_id") % 25).join(places, "key")
    return rows.select("page_id", "url", html.alias("html"))


def dated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Order times written in thirteen layouts, and one text without a date."""
    layouts = [
        "yyyy-MM-dd HH:mm:ss", "yyyy-M-d HH:mm", "yyyy/M/d HH:mm:ss", "yyyy年M月d日 HH:mm", "yyyy年MM月dd日", "yyyy/MM/dd", "yyyy.MM.dd",
        "M月d日 HH:mm", "yy-MM-dd HH:mm:ss", "yyyy-MM-ddHH:mm", "yyyy-MM-ddHH:mm:ss", "yyyy-M-d", "yyyy年M月d日HH:mm:ss",
    ]
    kind = F.col("o_orderkey") % 14
    text = F.when(kind == 13, "今天")
    for at, layout in enumerate(layouts):
        text = text.when(kind == at, F.date_format(order_clock(), layout))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
