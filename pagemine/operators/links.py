"""Links: extraction, filters, routes, sampling, caps and the link frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemine.functions import urls as U
from pagemine.functions.skew import cut_lineage, first_rows_per_key, join_per_key
from pagemine.functions.text import attribute, collapse_text, decode_entities

# Anchor texts that never lead to an article.
BLOCKED_ANCHORS = [
    "信箱", "站点地图", "末页", "关于我们", "版权声明", "浏览建议", "关于", "通知公告", "上一页",
    "广告", "友情链接", "声明", "隐私保护", "留言", "网站地图", "通知", "公告", "法律声明", "网站致谢",
    "天气", "在线留言", "天气预报", "网站声明", "联系我们", "法律责任", "广告合作", "更正",
    "下一页", "详情", "尾页", "上页", "下页",
]
# Extensions of documents and images, lower and upper case only.
FILE_WORDS = ["pdf", "doc", "jpg", "png", "xls", "docx", "gif", "csv"]
FILE_WORDS = FILE_WORDS + [word.upper() for word in FILE_WORDS]
# Limits of one site run.
MAX_URL_AGE_DAYS = 365
MAX_PAGES_PER_SITE = 100
LINK_SHARE = 0.5
MAX_HOPS = 3
DEFAULT_DENY = ".*s?html?.*"

#: The largest suffix table that is sent to every task; the public list has about a tenth of it.
MAX_SUFFIXES = 100_000

HIDDEN_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
LINK_EDGE = r"(?i)(<a[\s>]|<area[\s>]|</a\s*>)"
CUT = "\x01"


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per a/area element with an href, in page order.

    The page is cut in front of every link tag, so this is a projection and one
    explode: no shuffle. An area has no content, so its text is empty.
    """
    markup = F.regexp_replace("html", HIDDEN_MARKUP, "")
    pieces = F.split(F.regexp_replace(markup, LINK_EDGE, CUT + "$1"), CUT)
    tags = F.filter(pieces, lambda piece: piece.rlike(r"(?is)^<a(rea)?\s[^>]*\bhref\s*=[^>]*>"))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode_outer(tags).alias("pos", "piece"))
    return (
        rows.withColumn("href", attribute(F.regexp_extract("piece", r"^([^>]*>)", 1), "href"))
        .withColumn("body", F.when(~F.lower("piece").startswith("<area"), F.regexp_extract("piece", r"(?s)^[^>]*>(.*)$", 1)))
        .withColumn("inner", F.regexp_replace(F.coalesce("body", F.lit("")), r"<[^>]*>?", ""))
        .withColumn("href", decode_entities(F.col("href")))
        .select(
            "page_id",
            "pos",
            "href",
            U.resolve_url(F.col("page_url"), F.col("href")).alias("url"),
            collapse_text(decode_entities(F.col("inner"))).alias("link_text"),
        )
    )


def dedup_links(links: DataFrame) -> DataFrame:
    """Unique links per page with their first position."""
    return links.groupBy("page_id", "url").agg(
        F.min("pos").alias("pos"), F.min_by("link_text", "pos").alias("link_text")
    )


def filter_recent(links: DataFrame, as_of: Column, max_days: int = MAX_URL_AGE_DAYS) -> DataFrame:
    """Drop links whose URL date is more than `max_days` before `as_of`."""
    age = F.datediff(as_of, U.url_date(F.col("url")))
    return links.where(F.coalesce(age, F.lit(0)) <= max_days)


def filter_anchor_text(links: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """Drop links with a blocked or all-digit anchor text; empty texts stay."""
    text = F.coalesce("link_text", F.lit(""))
    return links.where(~text.isin(blocked or BLOCKED_ANCHORS) & ~text.rlike("^[0-9]+$"))


def filter_file_urls(links: DataFrame) -> DataFrame:
    """Drop URLs whose path holds a document or image extension as a word."""
    words = F.split(U.url_path(F.col("url")), "[/_.-]")
    return links.where(~F.arrays_overlap(words, F.array(*[F.lit(word) for word in FILE_WORDS])))


def route_links(links: DataFrame, article_rule: str = ".*") -> DataFrame:
    """Route each link: 'article' where the rule matches, 'follow' where the deny rule does not.

    Links of neither kind are dropped.
    """
    deny = DEFAULT_DENY if article_rule in ("", ".", "*", ".*") else article_rule
    route = F.when(F.col("url").rlike(article_rule or ".*"), "article").when(~F.col("url").rlike(deny), "follow")
    return links.withColumn("route", route).where("route is not null")


def filter_in_domain(links: DataFrame, domain: Column) -> DataFrame:
    return links.where(U.host_under(U.url_host(F.col("url")), domain))


def sample_links(links: DataFrame, share: float = LINK_SHARE, seed: str = "0") -> DataFrame:
    """Per page and route floor(n * share) links, in a seeded hash order."""
    group = W.partitionBy("page_id", "route")
    order = group.orderBy(F.md5(F.concat(F.col("url"), F.lit(seed)).cast("binary")), "pos")
    return (
        links.withColumn("_n", F.count("*").over(group))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= F.floor(F.col("_n") * share))
        .drop("_n", "_rank")
    )


def cap_pages_per_site(pages: DataFrame, n: int = MAX_PAGES_PER_SITE) -> DataFrame:
    """The first n pages of every site, by page_id."""
    return first_rows_per_key(pages, ["site"], [F.col("page_id")], n)


def link_frontier(starts: DataFrame, edges: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """Pages within `hops` links of the start pages, with the hop that first reached them.

    `starts(url)`, `edges(src, dst)`. Only newly reached pages are expanded.
    """
    seen = starts.select("url").distinct().withColumn("hop", F.lit(0))
    fresh = seen
    for hop in range(1, hops + 1):
        step = edges.join(fresh.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        fresh = cut_lineage(step.join(seen, "url", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(fresh)
    return seen


def registered_domain(df: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Split the host into subdomain, domain label and public suffix.

    One look-up per suffix length that `suffixes(suffix)` has, instead of exploding the
    host, so rows are never regrouped. The table's size is counted first: up to
    MAX_SUFFIXES rows it is broadcast, as its join key would gather all hosts of a suffix.
    """
    suffixes = suffixes.select("suffix").where("suffix is not null").distinct()
    n_suffixes, longest = suffixes.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("suffix", r"\."))), F.lit(1))).first()
    labels = F.split(F.col("_host"), r"\.")
    out = df.withColumn("_host", U.url_host(F.col(url)))
    lengths = range(1, longest + 1)
    for n in lengths:
        tail = F.when(F.size(labels) > n, F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
        known = suffixes.where(F.size(F.split("suffix", r"\.")) == n).select(F.col("suffix").alias(f"_tail{n}"), F.lit(n).alias(f"_hit{n}"))
        known = F.broadcast(known) if n_suffixes <= MAX_SUFFIXES else known
        out = out.withColumn(f"_tail{n}", tail).join(known, f"_tail{n}", "left").drop(f"_tail{n}")
    hits = [F.col(f"_hit{n}") for n in lengths]
    size = F.coalesce(F.greatest(*hits) if longest > 1 else hits[0], F.lit(0))
    total = F.size(labels)
    suffix = F.array_join(F.slice(labels, total - size + 1, size), ".")
    label = F.element_at(labels, total - size)
    return (
        out.withColumn("host", F.col("_host"))
        .withColumn("suffix", F.when(size > 0, suffix).otherwise(""))
        .withColumn("label", label)
        .withColumn("subdomain", F.array_join(F.slice(labels, 1, total - size - 1), "."))
        .withColumn("domain", F.when(size > 0, F.concat_ws(".", label, suffix)).otherwise(F.col("_host")))
        .drop("_host", *[f"_hit{n}" for n in lengths])
    )


def site_hosts(df: DataFrame) -> DataFrame:
    """The set of full hosts seen per domain, one row per host.

    Rows rather than an array: a domain may have any number of hosts.
    """
    return df.groupBy("domain", "host").agg(F.count("*").alias("n_urls"))


def with_site(df: DataFrame, per_site: DataFrame) -> DataFrame:
    """Attach a one-row-per-site table to rows of any number per site."""
    return join_per_key(df, per_site, ["site"], F.col("url"), "left")
