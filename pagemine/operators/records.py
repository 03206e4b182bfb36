"""Records: one row per page with the extracted fields, and what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.bind import once
from pagemine.functions.skew import attach
from pagemine.operators.docs import body_text, documented, node_at, node_text, outer_html, with_content
from pagemine.operators.dom import with_page_ids, with_trees
from pagemine.operators.fields import with_first_match, with_own_match, with_publish_date
from pagemine.operators.media import content_images, content_video, with_breadcrumb
from pagemine.operators.selectors import configured_first, configured_values, cut_noise, guess_selector, live_keys, selected, value_node, wrapped
from pagemine.operators.titles import first_line, with_heading_title, with_sibling_titles, with_title, with_title_node
from pagemine.sources.rules import DEFAULT_PATTERNS, site_rule_arrays
from pagemine.sources.schemas import FIELD_TYPES, FIELDS

# The fields that decide whether a record is kept, and how many must be there.
GATE_FIELDS = ["channel", "title", "content", "publish_date"]
GATE_MINIMUM = 3
PATTERN_FIELDS = ["author", "editor", "source"]


def _field(xpath: Column, value: Column, regex: Column | str = "") -> Column:
    return F.struct(
        F.coalesce(xpath, F.lit("")).alias("xpath"),
        value.alias("value"),
        (F.lit(regex) if isinstance(regex, str) else F.coalesce(regex, F.lit(""))).alias("regex"),
    )


def extract_records(
    pages: DataFrame, rules: DataFrame | None = None, fields: list[str] | None = None, noise: list[str] | None = None
) -> DataFrame:
    """One row per page with a struct(xpath, value, regex) per requested field.

    `pages` holds page_id, url, html and any further columns, which are kept. With
    `rules` and a column `site`, the selectors and patterns of the page's site are used
    before anything is guessed, and its noise is cut out first. Fields that were not asked for are not computed.
    Everything happens in the page's own row: pages with equal ids give a record each, and without
    rules nothing is shuffled.
    """
    fields = fields or FIELDS
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    pages = with_page_ids(pages)
    # what is kept travels under names of its own, as extraction adds columns
    kept = [name for name in pages.columns if name not in ("page_id", "html", *fields)]
    docs = pages.select("page_id", "html", F.struct(*[F.col(name) for name in kept]).alias("_kept"), *(["site"] if rules is not None else []))
    if rules is not None:
        docs = with_site_rules(docs, rules)
    trees = with_trees(docs)

    def exprs(field: str, kind: str) -> Column:
        def wanted(r: Column) -> Column:
            own = (r["field"] == field) & (r["kind"] == kind)
            return own if kind == "pattern" else own & (r["key"].isNull() | F.array_contains("_live", r["key"]))

        own = F.filter(F.col("rules"), wanted)
        return F.coalesce(F.transform(own, lambda r: r["expr"]), F.array().cast("array<string>"))

    if noise or rules is not None:
        cut = F.concat(F.array(*[F.lit(x) for x in noise or ()]).cast("array<string>"), *([exprs("noise_node", "noise")] if rules is not None else []))
        measured = documented(trees, keep=("tokens", "tree"))
        if rules is not None:
            measured = once(measured, {"_live": live_keys(F.col("rules.key"))})
        trees = cut_noise(measured, cut)
    docs = documented(trees)
    if rules is not None:
        docs = once(docs, {"_live": live_keys(F.col("rules.key"))})
        configured = [f for f in fields if f in (*PATTERN_FIELDS, "publish_date")] + ["title", "content"]
        docs = once(docs, {f"set_{f}": configured_first(exprs(f, "selector")) for f in configured})
        docs = once(docs, {"channel_at": F.get(F.transform(
            exprs("channel", "selector"), lambda x: F.get(F.transform(selected(x), lambda n: n["seq"]), F.lit(0))), F.lit(0))})
        docs = once(docs, {"channel_root": node_at(F.col("channel_at"))})
    has_rules = rules is not None

    docs = with_content(docs)
    if has_rules:
        given = F.get(selected(F.col("set_content.xpath")), F.lit(0))
        docs = once(docs, {"given_content": F.when(F.col("set_content").isNotNull(), given)})
        docs = once(docs, {"content_node": F.coalesce("given_content", "content_node")})
    split = F.get(exprs("title", "pattern"), F.lit(0)) if has_rules else None
    docs = with_title(docs, F.col("set_title.value") if has_rules else None, split)
    docs = with_heading_title(with_title_node(docs))
    out, columns = docs, {}
    if set(fields) & set(PATTERN_FIELDS):
        out = once(out, {"lines": body_text("\n")})
    matched = [name for name in PATTERN_FIELDS if name in fields]
    for name in matched:
        out = _with_pattern_match(out, name, "lines", exprs(name, "pattern") if has_rules else None)
    if "publish_date" in fields:
        own_dates = exprs("publish_date", "pattern") if has_rules else None
        out = with_publish_date(once(out, {"body": body_text("")}), "body", DEFAULT_PATTERNS["publish_date"], own_dates)
        matched.append("publish")

    # One pass builds the selectors of all the nodes that the fields were found in.
    found_in = {"content": F.col("content_node"), "title": F.col("title_node")}
    if "title" in fields:
        found_in["heading"] = node_at(F.col("heading_seq"))
    for name in matched:
        found_in[name] = value_node(F.col(f"{name}_match.found"))
    out = once(out, {"paths": F.transform(F.array(*found_in.values()), guess_selector)})
    paths = {name: F.get("paths", F.lit(at)) for at, name in enumerate(found_in)}
    content_path = paths["content"]
    if has_rules:
        plain = F.regexp_replace(F.col("set_content.xpath"), r"^string\((.*)\)$", "$1")
        content_path = F.when(F.col("given_content").isNotNull(), plain).otherwise(content_path)
    out = once(out, {"content_xpath": content_path})

    if "channel" in fields:
        pattern = F.get(exprs("channel", "pattern"), F.lit(0)) if has_rules else None
        out = with_breadcrumb(out, F.col("channel_root") if has_rules else None, pattern)
        columns["channel"] = F.col("channel")
    if "leadtitle" in fields or "subtitle" in fields:
        out = with_sibling_titles(out)
        for name, axis in (("leadtitle", "preceding-sibling"), ("subtitle", "following-sibling")):
            xpath = F.concat(F.lit("string("), paths["title"], F.lit(f"/{axis}::*)"))
            columns[name] = _field(xpath, F.coalesce(F.col(f"{name}_value"), F.lit("")))

    def configured_or(name: str, guess: Column, value: Column | None = None) -> Column:
        if not has_rules:
            return guess
        given = F.col(f"set_{name}")
        return F.when(given.isNotNull(), _field(given["xpath"], given["value"] if value is None else value)).otherwise(guess)

    for name in PATTERN_FIELDS:
        if name in fields:
            value = F.coalesce(F.trim(f"{name}_match.found"), F.lit(""))
            columns[name] = configured_or(name, _field(wrapped(paths[name]), value, F.col(f"{name}_match.regex")))
    if "publish_date" in fields:
        value = F.coalesce("publish_value", F.lit(""))
        columns["publish_date"] = configured_or("publish_date", _field(wrapped(paths["publish"]), value, F.col("publish_match.regex")))
    if "title" in fields:
        out = once(out, {"title_text": F.when(F.col("title_node").isNotNull(), node_text(F.col("title_node")))})
        heading_path = F.when(F.col("heading_seq").isNotNull(), wrapped(paths["heading"])).otherwise("//title/text()")
        guess = F.when(
            F.coalesce(F.col("title_text"), F.lit("")) != "", _field(wrapped(paths["title"]), first_line(F.col("title_text")))
        ).when(F.coalesce(F.col("heading_title"), F.lit("")) != "", _field(heading_path, first_line(F.col("heading_title"))))
        columns["title"] = configured_or("title", guess, first_line(F.col("set_title.value")) if has_rules else None)
    found = F.col("content_node").isNotNull()
    if "content" in fields:
        columns["content"] = F.when(found, _field(wrapped(F.col("content_xpath")), node_text(F.col("content_node"))))
    if "htmlcontent" in fields:
        columns["htmlcontent"] = F.when(found, _field(F.col("content_xpath"), outer_html(F.col("content_node"))))
    if "origin_image_list" in fields:
        images = F.when(found, _field(F.concat(F.col("content_xpath"), F.lit("//img/@src")), content_images(F.col("content_node"))))
        if has_rules:
            out = once(out, {"set_images": configured_values(exprs("origin_image_list", "selector"))})
            given_images = _field(F.col("set_images.xpath"), F.col("set_images.values"))
            images = F.when(F.col("set_images").isNotNull(), given_images).otherwise(images)
        columns["origin_image_list"] = images
    if "video_url" in fields:
        columns["video_url"] = F.when(
            found,
            _field(F.concat(F.col("content_xpath"), F.lit("//video/@src")), F.coalesce(content_video(F.col("content_node")), F.lit(""))),
        )
    found = {name: columns[name].cast(FIELD_TYPES[name]) for name in fields}
    return out.select("page_id", *[F.col("_kept")[name].alias(name) for name in kept], *[value.alias(name) for name, value in found.items()])


def with_site_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `rules`, the rule array of the page's site."""
    return attach(pages, site_rule_arrays(rules), ["site"], F.xxhash64("page_id", "html"), "left")


def _with_pattern_match(docs: DataFrame, name: str, text: str, own: Column | None) -> DataFrame:
    """Add struct {name}_match; the site's own patterns, if any, come before the defaults."""
    out = with_first_match(docs, text, DEFAULT_PATTERNS[name], f"{name}_match")
    if own is None:
        return out
    return with_own_match(out, text, own, f"{name}_match")


def has_value(field: str) -> Column:
    value = F.col(f"{field}.value")
    if field in ("channel", "origin_image_list"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value != "", F.lit(False))


def quality_gate(records: DataFrame) -> DataFrame:
    """Records with content and title results and at least three of the four gate fields."""
    present = sum((has_value(name).cast("int") for name in GATE_FIELDS), F.lit(0))
    return records.where(F.col("content").isNotNull() & F.col("title").isNotNull() & (present >= GATE_MINIMUM))


def record_fields(records: DataFrame) -> list[str]:
    return [name for name in FIELDS if name in records.columns]


def selectors_only(records: DataFrame) -> DataFrame:
    """Drop the values, keep selector and regex of every field."""
    return records.withColumns({name: F.col(name).dropFields("value") for name in record_fields(records)})


def values_only(records: DataFrame) -> DataFrame:
    """Keep only the value of every field."""
    return records.withColumns({name: F.col(f"{name}.value") for name in record_fields(records)})


def field_projection(pages: DataFrame, fields: list[str]) -> DataFrame:
    """Extract only the requested fields."""
    return extract_records(pages, fields=fields)


def common_selectors(records: DataFrame) -> DataFrame:
    """Distinct selectors and patterns per site and field, one row each with its support.

    Rows instead of arrays: only (site, field, expr) triples are shuffled, after map-side
    counting, and a site may have any number of them.
    """
    entries = F.array(*[
        F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.col(f"{name}.{part}").alias("expr"))
        for name in record_fields(records)
        for kind, part in (("selector", "xpath"), ("pattern", "regex"))
    ])
    rows = records.select("site", F.inline_outer(entries)).where("expr <> ''")
    return rows.groupBy("site", "field", "kind", "expr").agg(F.count("*").alias("support"))


def site_sample(records: DataFrame) -> DataFrame:
    """First record per site, by page_id: its URL and full values as JSON. Only ids are compared, no records sorted."""
    names = ["url", *record_fields(records)]
    first = records.groupBy("site").agg(F.min("page_id").alias("page_id"))
    found = records.join(first, ["site", "page_id"], "left_semi")
    return found.select("site", F.col("url").alias("sample"), F.to_json(F.struct(*names)).alias("sample_values"))
