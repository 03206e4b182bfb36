"""Registered title, field, selector, media, record, table and stream queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import inputs as I
from pagemine.functions import urls as U
from pagemine.functions.dates import normalize_date as normalize
from pagemine.functions.bind import once
from pagemine.operators import docs as C
from pagemine.operators import fields as X
from pagemine.operators import media as V
from pagemine.operators import records as P
from pagemine.operators import selectors as S
from pagemine.operators import titles as T
from pagemine.operators.density import measured_tree
from pagemine.plans.train import train_sites as train
from pagemine.sources import files, tables
from pagemine.sources import rules as R
from pagemine.streaming import jobs


def _md5(column):
    return F.md5(column.cast("binary"))


def _docs(spark, sf):
    return C.with_content(C.page_docs(I.pages(spark, sf)))


def _titled(spark, sf):
    return T.with_title_node(T.with_title(_docs(spark, sf)))


def _rich(spark, sf):
    return C.with_content(C.page_docs(I.rich_pages(spark, sf)))


def node_text(spark, sf):
    docs = once(_docs(spark, sf), {"text": C.node_text(F.col("content_node"))})
    return docs.select("page_id", _md5(F.col("text")).alias("digest"), F.length("text").alias("chars"))


def body_text(spark, sf):
    return C.page_docs(I.pages(spark, sf)).select("page_id", _md5(C.body_text("")).alias("joined"), _md5(C.body_text("\n")).alias("lines"))


def outer_html(spark, sf):
    return _docs(spark, sf).select("page_id", _md5(C.outer_html(F.col("content_node"))).alias("digest"))


def page_title(spark, sf):
    docs = T.with_title(C.page_docs(I.pages(spark, sf)))
    return docs.select("page_id", F.col("page_title").alias("title"), F.col("title_head").alias("head"))


def word_counts(spark, sf):
    return T.word_counts(I.table(spark, sf, "documents"), ["doc_id"], "text")


def cosine_scores(spark, sf):
    docs = once(T.with_title(C.page_docs(I.pages(spark, sf))), {"ps": F.transform(
        F.filter("nodes", lambda n: (n["tag"] == "p") & n["eligible"]), lambda n: F.struct(n["seq"].alias("seq"), C.node_text(n).alias("text")))})
    own = docs.select("page_id", "page_title", F.inline_outer("ps")).where("seq is not null")
    titles = docs.select("page_id", "page_title")
    others = titles.select((F.col("page_id") - 1).alias("page_id"), F.lit(-1).alias("seq"), F.col("page_title").alias("text"))
    pairs = own.unionByName(titles.join(others, "page_id").select("page_id", "page_title", "seq", "text"))
    return T.cosine_scores(pairs, "page_title", "text").select("page_id", "seq", F.round("score", 6).alias("score"))


def title_node(spark, sf):
    docs = _titled(spark, sf)
    return docs.select("page_id", F.col("title_node.seq").alias("seq"), F.round("title_score", 6).alias("score"))


def heading_title(spark, sf):
    return T.with_heading_title(T.with_title(C.page_docs(I.pages(spark, sf)))).select("page_id", "heading_seq", "heading_title")


def title_value(spark, sf):
    found = P.extract_records(I.pages(spark, sf), fields=["title"])
    return found.select("page_id", F.col("title.value").alias("title_value"))


def sibling_titles(spark, sf):
    docs = T.with_sibling_titles(_titled(spark, sf))
    return docs.select("page_id", _md5(F.col("leadtitle_value")).alias("leadtitle"), _md5(F.col("subtitle_value")).alias("subtitle"))


def first_match_field(spark, sf):
    labels = ["作者：", "原创|", "撰文:", "文/图 ", "责任编辑：", "记者 ", "来源于：", "无 "]
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("c_custkey") % 8 + 1).cast("int"))
    text = F.concat(F.lit("前文 "), label, "c_name", F.lit("！"), "c_mktsegment")
    df = I.table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    for field in P.PATTERN_FIELDS:
        df = X.with_first_match(df, "text", R.DEFAULT_PATTERNS[field], field)
    return df.select("c_custkey", *[F.trim(f"{field}.found").alias(field) for field in P.PATTERN_FIELDS])


def first_match_by_site(spark, sf):
    side = F.col("c_nationkey") % 2
    df = I.table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("s"), side).alias("site"),
        F.concat(F.when(side == 0, "名：").otherwise("字："), "c_name", F.lit("!")).alias("text"),
    )
    own = df.select("site").distinct().select(
        "site", F.lit("author").alias("field"), F.lit("pattern").alias("kind"),
        F.posexplode(F.array(F.lit("没有(.)"), F.when(F.col("site") == "s0", "名：(.*)").otherwise("字：(.*)"))).alias("priority", "expr"),
    )
    return X.first_match_by_site(df, own, "text", "author").select("c_custkey", "value", "regex")


def publish_date(spark, sf):
    dated = I.dated_texts(spark, sf).select("o_orderkey", F.concat(F.lit("发布时间："), "text", F.lit(" 来自")).alias("text"))
    return X.with_publish_date(dated, "text", R.DATE_PATTERNS).select("o_orderkey", F.col("publish_value").alias("found_value"))


def normalize_date(spark, sf):
    return I.dated_texts(spark, sf).select("o_orderkey", "text", normalize(F.col("text")).alias("value"))


SELECTORS = [
    ("title", "//article/h1"), ("x", '//*[@class="ad"]'), ("x", "//nav//a/@href"), ("x", "string(//article/p[2])"), ("title", "//title/text()"),
]


def eval_selectors(spark, sf):
    found = S.eval_selectors(C.page_docs(I.pages(spark, sf)), SELECTORS)
    return found.select("page_id", "xpath", F.col("pos").cast("bigint").alias("pos"), _md5(F.col("value")).alias("digest"))


def selector_pool(spark, sf):
    pool = [("title", "//h1"), ("title", "//h6"), ("author", "//footer"), ("author", '//div[@class="author"]')]
    return S.selector_pool(C.page_docs(I.pages(spark, sf)), pool).select("page_id", "field", "xpath", _md5(F.col("value")).alias("digest"))


def guess_selector(spark, sf):
    docs = C.page_docs(I.rich_pages(spark, sf))
    made = F.transform(
        F.filter("nodes", lambda n: n["eligible"]), lambda n: F.struct(n["seq"].alias("seq"), S.guess_selector(n).alias("xpath"))
    )
    return once(docs, {"made": made}).select("page_id", F.inline_outer("made"))


def value_selector(spark, sf):
    docs = T.with_title(C.page_docs(I.pages(spark, sf)))
    value = F.element_at(F.split("page_title", " "), 1)
    docs = once(docs, {"holder": S.value_node(value)})
    made = docs.select("page_id", "holder.seq", S.wrapped(S.guess_selector(F.col("holder"))).alias("xpath"))
    return made.where("seq is not null")


def configured_first(spark, sf):
    exprs = F.array(F.lit("//h2"), F.lit('string(//div[@id="none"])'), F.lit("string(//article/h1)"), F.lit("//title/text()"))
    docs = once(C.page_docs(I.pages(spark, sf)), {"hit": S.configured_first(exprs)})
    return docs.select("page_id", "hit.xpath", _md5(F.col("hit.value")).alias("digest"))


def drop_noise(spark, sf):
    pages = I.pages(spark, sf)
    clean = S.drop_noise(pages, ['//*[@class="ad"]', "//nav"])
    nodes = measured_tree(clean).where("kind = 'node'")
    nodes = nodes.withColumn("at", F.row_number().over(W.partitionBy("page_id").orderBy("seq")).cast("bigint"))
    parents = nodes.select("page_id", F.col("seq").alias("parent_seq"), F.col("at").alias("parent_at"))
    return nodes.join(parents, ["page_id", "parent_seq"], "left").select("page_id", "at", "tag", "depth", F.coalesce("parent_at", F.lit(0)).cast("bigint").alias("parent_at"))


def content_images(spark, sf):
    return _rich(spark, sf).select("page_id", F.array_join(V.content_images(F.col("content_node")), " ").alias("images"))


def content_video(spark, sf):
    return _rich(spark, sf).select("page_id", V.content_video(F.col("content_node")).alias("video"))


def content_siblings(spark, sf):
    docs = once(_docs(spark, sf), {"kin": V.content_siblings(F.col("content_node"))})
    return docs.select("page_id", F.explode_outer("kin").alias("seq")).where("seq is not null")


def _channels(spark, sf):
    return V.with_breadcrumb(T.with_title_node(T.with_title(_rich(spark, sf))))


def breadcrumb(spark, sf):
    names = F.array_join(F.col("channel.value.channel_name"), " ")
    return _channels(spark, sf).select("page_id", names.alias("names"), F.array_join(F.col("channel.value.channel_href"), " ").alias("hrefs"))


def breadcrumb_path(spark, sf):
    return _channels(spark, sf).select("page_id", F.array_join(F.col("channel.value.channel_nav"), "|").alias("navs"))


def breadcrumb_search(spark, sf):
    return _channels(spark, sf).select("page_id", "channel.xpath")


def extract_records(spark, sf):
    found = P.extract_records(I.rich_pages(spark, sf))
    return found.select(
        "page_id", "url", F.col("title.value").alias("title"), _md5(F.col("content.value")).alias("content"),
        F.col("htmlcontent.xpath").alias("content_xpath"), F.col("publish_date.value").alias("publish_date"),
        F.col("source.value").alias("source"), F.col("author.value").alias("author"),
        F.element_at(F.col("channel.value.channel_nav"), -1).alias("channel"), F.col("editor.value").alias("editor"),
        F.col("video_url.value").alias("video_url"), _md5(F.col("htmlcontent.value")).alias("htmlcontent"),
        F.array_join("origin_image_list.value", " ").alias("images"), _md5(F.col("leadtitle.value")).alias("leadtitle"), _md5(F.col("subtitle.value")).alias("subtitle"),
    )


def extract_records_repeated_ids(spark, sf):
    """Many pages of one id each keep their own record."""
    pages = I.rich_pages(spark, sf).withColumn("page_id", F.col("page_id") % 50)
    found = P.extract_records(pages, fields=["title", "content"])
    return found.select("page_id", "url", F.col("title.value").alias("title"), _md5(F.col("content.value")).alias("content"))


def extract_records_by_site(spark, sf):
    """Three sites: one with a title split and a breadcrumb pattern, one with noise, one with image selectors of its own."""
    pages = I.rich_pages(spark, sf).withColumn("site", F.concat(F.lit("s"), F.col("page_id") % 3))
    rules = spark.createDataFrame(
        [
            ("s0", "title", "pattern", 0, "e"), ("s0", "channel", "pattern", 0, "never in a page"), ("s1", "noise_node", "noise", 0, '//p[@class="meta"]'),
            ("s2", "origin_image_list", "selector", 0, "//nothing//img/@src"), ("s2", "origin_image_list", "selector", 1, "//article//img/@src"),
        ],
        R.FIELD_RULES,
    )
    found = P.extract_records(pages, rules, fields=["title", "source", "channel", "origin_image_list"])
    images = F.when(F.col("site") == "s2", F.array_join("origin_image_list.value", " "))
    return found.select(
        "page_id", F.col("title.value").alias("title"), F.col("source.value").alias("source"),
        F.element_at(F.col("channel.value.channel_nav"), -1).alias("channel"), images.alias("images"),
    )


def selectors_only(spark, sf):
    kept = P.selectors_only(P.extract_records(I.rich_pages(spark, sf), fields=["content"]))
    parts = F.size(F.from_json(F.to_json("content"), "map<string,string>"))
    return kept.select("page_id", "content.xpath", "content.regex", parts.alias("parts"))


def values_only(spark, sf):
    kept = P.values_only(P.extract_records(I.rich_pages(spark, sf), fields=["title", "content"]))
    return kept.select("page_id", "title", _md5(F.col("content")).alias("content"))


def field_projection(spark, sf):
    kept = P.field_projection(I.rich_pages(spark, sf), ["content", "title"])
    return kept.select("page_id", F.col("title.value").alias("title"), _md5(F.col("content.value")).alias("content"))


def _struct(value, xpath="x", regex=""):
    return F.struct(F.lit(xpath).alias("xpath") if isinstance(xpath, str) else xpath.alias("xpath"), value.alias("value"),
                    F.lit(regex).alias("regex") if isinstance(regex, str) else regex.alias("regex"))


def quality_gate(spark, sf):
    at = F.col("page_id")
    link = F.struct(F.lit("/").alias("channel_href"), F.lit("a").alias("channel_name"), F.lit("a").alias("channel_nav"))
    made = I.pages(spark, sf).select(
        "page_id",
        F.when(at % 7 != 1, _struct(F.when(at % 7 == 3, "").otherwise("t"))).alias("title"),
        F.when(at % 7 != 2, _struct(F.lit("c"))).alias("content"),
        F.when(at % 2 == 1, _struct(F.array(link))).alias("channel"),
        _struct(F.when(at % 3 > 0, "2020-01-01 00:00:00").otherwise("")).alias("publish_date"),
    )
    return P.quality_gate(made).select("page_id")


def common_selectors(spark, sf):
    at = F.col("page_id")
    made = I.site_urls(spark, sf).select(
        "site",
        _struct(F.lit("t"), F.concat(F.lit("//h"), at % 3), F.when(at % 2 == 1, F.concat(F.lit("p"), at % 2)).otherwise("")).alias("title"),
        _struct(F.lit("c"), F.concat(F.lit("//div["), at % 5, F.lit("]"))).alias("content"),
    )
    return P.common_selectors(made)


def site_sample(spark, sf):
    made = I.site_urls(spark, sf).select("site", "page_id", "url", _struct(F.concat(F.lit("t"), "page_id")).alias("title"))
    return P.site_sample(made)


def upsert_site_table(spark, sf):
    rows = I.site_pages(spark, sf).select(
        F.col("host").alias("web_name"), F.concat(F.lit("j"), F.col("page_id") % 4).alias("job_id"), F.col("page_id").alias("version"), "url"
    )
    existing = rows.where("version % 2 = 0")
    updates = rows.where("version % 3 = 0").withColumn("url", F.concat("url", F.lit("/new")))
    return tables.upsert(existing, updates, tables.SITE_KEYS, "version")


def load_site_config(spark, sf):
    sites = I.site_pages(spark, sf).select(F.col("host").alias("site")).distinct()
    own = sites.where("site like 'www.%'").select(
        "site", F.lit("title").alias("field"), F.lit("selector").alias("kind"), F.lit(0).alias("priority"), F.lit("//h1").alias("expr")
    )
    return R.resolve_config(sites, own)


def bump_config_version(spark, sf):
    urls = I.site_urls(spark, sf)
    found = urls.select("site", F.lit("title").alias("field"), F.lit("selector").alias("kind"), F.concat(F.lit("//p"), F.col("page_id") % 6).alias("expr"))
    patterns = urls.select("site", F.lit("title").alias("field"), F.lit("pattern").alias("kind"), F.lit("[-_|]").alias("expr"))
    versions = urls.groupBy("site").agg(F.max(F.col("page_id") % 9).alias("version"))
    return tables.publish_config(found.unionByName(patterns).distinct(), versions)


def site_run_rows(spark, sf):
    sites = I.site_pages(spark, sf).groupBy("site").agg(F.count("*").alias("version"), F.min("host").alias("host")).select(
        "site", "version", F.array(F.concat(F.lit("http://"), "host")).alias("start_urls"), F.array("site").alias("allowed_domains"), F.lit(".*").alias("article_regex")
    )
    rows = tables.site_rule_rows(sites, "job", F.lit("2020-01-02 00:00:00"))
    return rows.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


def train_sites(spark, sf):
    pages = I.rich_pages(spark, sf).withColumn("site", F.regexp_extract(U.url_host(F.col("url")), r"([^.]+\.[^.]+)$", 1))
    done = train(pages, "job", F.lit("2020-01-02 00:00:00"))
    learned = F.array_join(F.from_json(F.get_json_object("config", "$.content.XPATH"), "array<string>"), " ")
    samples = done.site_configs.select(
        "web_name", "sample", learned.alias("content_xpaths"), F.get_json_object("sample_values", "$.title.value").alias("sample_title"),
        _md5(F.get_json_object("sample_values", "$.content.value")).alias("sample_content"),
    )
    return done.site_rules.drop("updated_at").join(samples, "web_name")


def work_folder(spark, name):
    """A new folder where all executors can read and write."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def read_link_csv(spark, sf):
    folder = work_folder(spark, "csv")
    twice = I.pages(spark, sf).select(F.col("url").alias("link"), F.lit("x").alias("other"))
    twice.union(twice).write.csv(folder, header=True)
    return files.read_link_csv(spark, folder)


def read_link_lines(spark, sf):
    folder = work_folder(spark, "lines")
    I.pages(spark, sf).select(F.explode(F.array(F.concat(F.lit(" "), "url"), F.lit(" "), F.lit("")))).write.text(folder)
    return files.read_link_lines(spark, folder)


def mine_link_lines(spark, sf):
    """Over several files: a site's rules begin with the site."""
    folder = work_folder(spark, "lines")
    I.pages(spark, sf).repartition(3, "page_id").select("url").write.text(folder)
    return files.mine_link_lines(spark, folder)


def mine_link_csv(spark, sf):
    folder = work_folder(spark, "csv")
    I.pages(spark, sf).select(F.col("url").alias("link"), F.lit("x").alias("other")).write.csv(folder, header=True)
    return files.mine_link_csv(spark, folder).drop("site")


def default_field_rules(spark, sf):
    """The built-in rules for every host of pages."""
    hosts = I.site_pages(spark, sf).select(F.col("host").alias("site"))
    return R.resolve_config(hosts, R.default_rules(spark, "another site"))


def read_records(spark, sf):
    folder = work_folder(spark, "records")
    rows = I.pages(spark, sf).select("page_id", "url", _struct(F.concat(F.lit("t"), "page_id")).alias("title"))
    for job in ("one", "two"):
        files.write_records(rows.withColumn("job_id", F.lit(job)), folder)
    return files.read_records(spark, folder).select("page_id", "job_id", F.col("title.value").alias("title"))


def write_records(spark, sf):
    folder = work_folder(spark, "records")
    rows = I.pages(spark, sf).select("page_id", "url", _struct(F.concat(F.lit("t"), "page_id")).alias("title"))
    files.write_records(rows.withColumn("job_id", F.lit("old")), folder)
    files.write_records(rows.withColumn("job_id", F.lit("new")), folder)
    return files.read_records(spark, folder, "new").select("page_id", "url", F.col("title.value").alias("title"))


def write_links(spark, sf):
    folder = work_folder(spark, "links")
    files.write_links(I.pages(spark, sf), folder)
    return spark.read.text(folder)


def stream_records(spark, sf):
    folder = work_folder(spark, "stream")
    stream = jobs.page_stream(spark, f"{sf}/pages.parquet*")
    jobs.stream_records(stream, f"{folder}/out", f"{folder}/state", ["title", "content"]).awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.select("page_id", "url", F.col("title.value").alias("title"), _md5(F.col("content.value")).alias("content"))


def stream_dedup_urls(spark, sf):
    folder = work_folder(spark, "dedup")
    urls = jobs.page_stream(spark, f"{sf}/pages.parquet*").select(F.regexp_extract("url", r"^([^?]*)", 1).alias("url"))
    done = jobs.stream_dedup_urls(urls).writeStream.format("parquet").option("path", f"{folder}/out")
    done.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url")


def stream_train(spark, sf):
    folder = work_folder(spark, "train")
    urls = jobs.page_stream(spark, f"{sf}/pages.parquet*").select(
        F.regexp_extract(U.url_host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("site"), "url"
    )
    jobs.stream_train(urls, folder, f"{folder}/state").awaitTermination()
    return jobs.latest_rules(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        node_text, body_text, outer_html, page_title, word_counts, cosine_scores, title_node, heading_title, title_value,
        sibling_titles, first_match_field, first_match_by_site, publish_date, normalize_date, eval_selectors, selector_pool,
        guess_selector, value_selector, configured_first, drop_noise, content_images, content_video, content_siblings,
        breadcrumb, breadcrumb_path, breadcrumb_search, extract_records, extract_records_repeated_ids, extract_records_by_site, selectors_only, values_only, field_projection,
        quality_gate, common_selectors, site_sample, upsert_site_table, load_site_config, bump_config_version, site_run_rows,
        train_sites, read_link_csv, read_link_lines, mine_link_lines, mine_link_csv, default_field_rules, read_records, write_records, write_links, stream_records, stream_dedup_urls, stream_train,
    )
}
