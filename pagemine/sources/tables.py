"""The site tables: rows to publish and the upsert into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SITE_KEYS = ["web_name", "job_id"]


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Insert or replace whole rows on a unique key; the later `order_col` wins, updates on ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    latest = W.partitionBy(*keys).orderBy(F.desc(order_col), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


_CONFIG = "map<string, struct<XPATH: array<string>, PATTERN: array<string>>>"


def current_configs(configs: DataFrame) -> DataFrame:
    """(site, version, config): the newest published config of every site."""
    newest = configs.groupBy("web_name").agg(F.max("version").alias("version"), F.max_by("config", F.struct("version", "job_id")).alias("config"))
    return newest.withColumnRenamed("web_name", "site")


def config_rules(configs: DataFrame) -> DataFrame:
    """Published configs as field_rules rows (site, field, kind, priority, expr): a config's order is its priority.

    The selectors of `noise_node` are noise rules.
    """
    parsed = current_configs(configs).select("site", F.explode(F.from_json("config", _CONFIG)).alias("field", "own"))
    kinds = F.array(
        F.struct(F.when(F.col("field") == "noise_node", "noise").otherwise("selector").alias("kind"), F.col("own.XPATH").alias("exprs")),
        F.struct(F.lit("pattern").alias("kind"), F.col("own.PATTERN").alias("exprs")),
    )
    rows = parsed.select("site", "field", F.inline(kinds))
    return rows.select("site", "field", "kind", F.posexplode("exprs").alias("priority", "expr"))


RULE = ["site", "field", "kind", "priority", "expr"]


def merge_rules(learned: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Rule rows (site, field, kind, priority, expr) after a run.

    What a run learned for a (site, field, kind) replaces the current rules there; rules of every
    other kind stay, noise and patterns too. Learned rules are tried by `support`, where given, the
    best supported first, then by expression.
    """
    support = F.col("support") if "support" in learned.columns else F.lit(0)
    order = W.partitionBy("site", "field", "kind").orderBy(support.desc(), "expr")
    ranked = learned.withColumn("priority", F.row_number().over(order) - 1).select(*RULE)
    if current is None:
        return ranked
    kept = current.select(*RULE).join(learned.select("site", "field", "kind").distinct(), ["site", "field", "kind"], "left_anti")
    return ranked.unionByName(kept)


def publish_config(selectors: DataFrame, versions: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(site, version + 1, config): the rules of a site after a run (`merge_rules`) as JSON.

    Rule rows are the store; a config is a rendering of them, one cell by contract.
    """
    rules = merge_rules(selectors, current)

    def listed(*kinds: str) -> Column:
        found = F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("priority", "expr")))
        return F.transform(F.sort_array(found), lambda rule: rule["expr"])

    per_field = rules.groupBy("site", "field").agg(listed("selector", "noise").alias("XPATH"), listed("pattern").alias("PATTERN"))
    per_site = per_field.groupBy("site").agg(
        F.sort_array(F.collect_list(F.struct("field", F.struct("XPATH", "PATTERN").alias("rules")))).alias("entries")
    )
    current = versions.select("site", F.col("version").cast("int").alias("old"))
    return current.join(per_site, "site", "left").select(
        "site",
        (F.coalesce("old", F.lit(0)) + 1).alias("version"),
        F.coalesce(F.to_json(F.map_from_entries("entries")), F.lit("{}")).alias("config"),
    )


def site_rule_rows(sites: DataFrame, job_id: str, now: Column) -> DataFrame:
    """Rows of `site_rules` from (site, start_urls, allowed_domains, version, article_regex)."""
    return sites.select(
        F.col("site").alias("web_name"),
        F.to_json("start_urls").alias("start_urls"),
        F.lit(1).alias("status"),
        "version",
        F.to_json("allowed_domains").alias("allowed_domains"),
        "article_regex",
        F.lit(job_id).alias("job_id"),
        now.cast("timestamp").alias("updated_at"),
    )


def site_config_rows(configs: DataFrame, samples: DataFrame, job_id: str, now: Column) -> DataFrame:
    """Rows of `site_configs` from published configs and samples; a site may have no sample."""
    return configs.join(samples, "site", "left").select(
        F.col("site").alias("web_name"),
        F.lit(job_id).alias("job_id"),
        "version",
        "config",
        "sample",
        "sample_values",
        now.cast("timestamp").alias("created_at"),
    )
