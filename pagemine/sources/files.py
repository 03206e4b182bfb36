"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemine.operators.mining import mine_url_rules
from pagemine.sources.schemas import RECORD

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw pages (page_id, url, html).

    `fmt="html"` reads a folder of HTML files, one page per file, with the file name
    as URL and a hash of it as page_id.
    """
    if fmt == "parquet":
        return spark.read.schema(PAGES).parquet(path)
    if fmt == "html":
        files = spark.read.text(path, wholetext=True).withColumn("url", F.input_file_name())
        return files.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))
    raise ValueError(f"unknown page format {fmt!r}")


def read_link_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values of the column `link`."""
    return spark.read.csv(path, header=True).select("link").where("link is not null").distinct()


def mine_link_csv(spark: SparkSession, path: str) -> DataFrame:
    """URL rules of a link CSV: prefix '.*', the top 100."""
    links = read_link_csv(spark, path).select(F.lit(path).alias("site"), F.col("link").alias("url"))
    return mine_url_rules(links, prefix=".*", nums=100)


def read_link_lines(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("link")).where("link <> ''")


def mine_link_lines(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """URL rules of a link list, the top 5 per site.

    The rules begin with the site, scheme://host: that of each line, or `root` for all lines
    where it is given. Files have no order among each other, so no line is the first one;
    lines without a host have the site ''.
    """
    own = F.regexp_extract("link", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1) if root is None else F.lit(root)
    urls = read_link_lines(spark, path).select(own.alias("site"), F.col("link").alias("url"))
    rules = mine_url_rules(urls, prefix="", nums=5)
    return rules.withColumn("regex", F.concat("site", "regex"))


def write_records(records: DataFrame, path: str) -> None:
    """Append extracted records as JSON lines."""
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """Cached records; with a job_id only those of that run."""
    records = spark.read.schema(RECORD).json(path)
    return records if job_id is None else records.where(F.col("job_id") == job_id)


def write_links(records: DataFrame, path: str) -> None:
    """Overwrite the list of kept URLs."""
    records.select("url").write.mode("overwrite").text(path)
