"""Train many sites in one run: pages in, site rules and site configs out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions import urls as U
from pagemine.functions.skew import attach, cut_lineage, first_rows_per_key
from pagemine.operators.dom import with_page_ids
from pagemine.operators.mining import best_site_rule, mine_url_rules
from pagemine.operators.records import common_selectors, extract_records, quality_gate, site_sample
from pagemine.sources.rules import DEFAULT_ROWS, resolve_config
from pagemine.sources.schemas import FIELD_RULES
from pagemine.sources.tables import (
    SITE_KEYS,
    config_rules,
    current_configs,
    merge_rules,
    publish_config,
    site_config_rows,
    site_rule_rows,
    upsert,
)


class Trained(NamedTuple):
    records: DataFrame
    rules: DataFrame
    site_rules: DataFrame
    site_configs: DataFrame
    field_rules: DataFrame


def train_sites(
    pages: DataFrame,
    job_id: str,
    now: Column,
    versions: DataFrame | None = None,
    rules: DataFrame | None = None,
    max_pages: int | None = None,
    gate: bool = True,
    site_rules: DataFrame | None = None,
    site_configs: DataFrame | None = None,
) -> Trained:
    """Pages (page_id, site, url, html) → records, URL rules, the two site tables and the rule rows.

    With the two tables of earlier runs, their newest configs serve as rules and versions
    where none are given, rules of a kind that is not learned anew stay, and this run's rows are
    upserted into what is returned; `field_rules` are the same rules as rows. Sites without rules
    of their own take the built-in ones. All pages are taken unless `max_pages` limits those of a
    site, pages without an id as well; rows repeated in full count once there. The records are
    written once and read by the mining, the filter, the selectors and the sample.
    """
    pages = with_page_ids(pages)
    sites = pages.select("site").distinct()
    if site_configs is not None:
        rules = config_rules(site_configs) if rules is None else rules
        versions = current_configs(site_configs).select("site", "version") if versions is None else versions
    current = rules
    if max_pages is not None:
        pages = _capped(pages, max_pages)
    # the built-in patterns are always tried last; of the built-in rules only noise has to be handed over
    noise = [row for row in DEFAULT_ROWS if row[1] == "noise"]
    if rules is not None:
        rules = resolve_config(sites, rules.select(*FIELD_RULES.fieldNames()), noise)
    records = extract_records(pages, rules, noise=[row[3] for row in noise] if rules is None else None)
    if gate:
        records = quality_gate(records)
    records = cut_lineage(records.withColumn("job_id", F.lit(job_id)))
    mined = cut_lineage(mine_url_rules(records.select("site", "url")))
    best = best_site_rule(sites, mined)
    matching = attach(records, best, ["site"], F.col("url")).where(
        (F.col("article_regex") != "") & F.regexp_like("url", F.col("article_regex"))
    )
    known = sites.withColumn("version", F.lit(0)) if versions is None else sites.join(versions, "site", "left")
    learned = cut_lineage(common_selectors(matching))
    field_rules = merge_rules(learned, current)
    configs = publish_config(learned, known, current)
    starts = pages.groupBy("site").agg(F.min_by(U.site_root(F.col("url")), "page_id").alias("root"))
    described = (
        configs.select("site", "version")
        .join(best, "site", "left")
        .join(starts, "site", "left")
        .select(
            "site",
            "version",
            "article_regex",
            F.array("root").alias("start_urls"),
            F.array("site").alias("allowed_domains"),
        )
    )
    new_rules = site_rule_rows(described, job_id, now)
    new_configs = site_config_rows(configs, site_sample(matching), job_id, now)
    return Trained(
        records,
        mined,
        new_rules if site_rules is None else upsert(site_rules, new_rules, SITE_KEYS, "version"),
        new_configs if site_configs is None else upsert(site_configs, new_configs, SITE_KEYS, "version"),
        field_rules,
    )


def _capped(pages: DataFrame, n: int) -> DataFrame:
    """The first n pages of every site, by page_id and content.

    Only ids and digests are ranked; pages are held against the last one of their site, so none
    is lost and no HTML is shuffled.
    """
    place = F.struct(F.col("page_id"), F.md5(F.concat_ws("\n", "url", "html")).alias("digest"))
    places = pages.select("site", place.alias("place")).distinct()
    last = first_rows_per_key(places, ["site"], [F.col("place")], n).groupBy("site").agg(F.max("place").alias("_last"))
    held = attach(pages, cut_lineage(last), ["site"], F.col("page_id"))
    return held.where(place <= F.col("_last")).drop("_last")
