"""Fields found by ordered patterns in the body text: author, editor, source, date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.dates import normalize_date
from pagemine.functions.bind import once
from pagemine.functions.skew import join_per_key
from pagemine.sources.rules import DATE_PATTERNS

# Every built-in date layout has a digit, a separator and a digit; texts without are skipped.
DATE_HINT = "[0-9][-|/.年月][0-9]"


def first_group(text: Column, pattern: Column) -> Column:
    """Group 1 of the first place where a pattern held in a column occurs."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def with_first_match(df: DataFrame, text: str, patterns: list[str], name: str) -> DataFrame:
    """Add struct `name`(found, regex): group 1 of the first pattern that occurs, null if none.

    Patterns are tried in order and the rest is skipped after the first hit.
    """
    which = F
    for at, pattern in enumerate(patterns):
        which = which.when(F.col(text).rlike(pattern), at)
    every = F.array(*[F.lit(p) for p in patterns])
    held = once(df, {"_which": which})
    held = once(held, {"_regex": F.get(every, F.col("_which"))})
    found = first_group(F.col(text), F.col("_regex"))
    match = F.when(F.col("_regex").isNotNull(), F.struct(found.alias("found"), F.col("_regex").alias("regex")))
    return once(held, {name: match}).drop("_which", "_regex")


def first_match_by_site(df: DataFrame, rules: DataFrame, text: str, field: str) -> DataFrame:
    """(…, value, regex) with the patterns of the row's own site, by priority.

    A site's patterns travel as one small array; they are tried until one occurs.
    """
    own = rules.where((F.col("field") == field) & (F.col("kind") == "pattern"))
    arrays = own.groupBy("site").agg(F.sort_array(F.collect_set(F.struct("priority", "expr"))).alias("_rules"))
    joined = join_per_key(df, arrays, ["site"], F.col(text), "left")
    hit = F.aggregate(
        F.coalesce(F.col("_rules.expr"), F.array().cast("array<string>")),
        F.lit("").cast("string"),
        lambda found, pattern: F.when(found != "", found).when(F.regexp_like(F.col(text), pattern), pattern).otherwise(""),
    )
    held = once(joined, {"regex": hit})
    value = first_group(F.col(text), F.col("regex"))
    return held.withColumn("value", F.when(F.col("regex") != "", F.trim(value))).drop("_rules")


def with_own_match(df: DataFrame, text: str, own: Column, name: str) -> DataFrame:
    """Replace struct `name`(found, regex) where one of the row's own patterns occurs; they are tried in order."""
    hit = F.aggregate(
        own,
        F.lit("").cast("string"),
        lambda found, pattern: F.when(found != "", found).when(F.regexp_like(F.col(text), pattern), pattern).otherwise(""),
    )
    held = once(df, {"_own": hit})
    match = F.struct(first_group(F.col(text), F.col("_own")).alias("found"), F.col("_own").alias("regex"))
    return once(held, {name: F.when(F.col("_own") != "", match).otherwise(F.col(name))}).drop("_own")


def with_publish_date(df: DataFrame, text: str, patterns: list[str], own: Column | None = None) -> DataFrame:
    """Add struct publish_match(found, regex) and publish_value.

    The first layout that occurs decides; its value may be empty when the text names no
    full date. The row's `own` patterns, if any, come first. Texts without the sign of a date are only skipped for built-in layouts.
    """
    worth = F.col(text).rlike(DATE_HINT) if set(patterns) <= set(DATE_PATTERNS) else F.col(text).isNotNull()
    hinted = once(df, {"_dated": F.when(worth, F.col(text))})
    out = with_first_match(hinted, "_dated", patterns, "publish_match")
    if own is not None:
        out = with_own_match(out, text, own, "publish_match")
    value = F.when(F.col("publish_match").isNotNull(), F.coalesce(normalize_date(F.col("publish_match.found")), F.lit("")))
    return out.withColumn("publish_value", value).drop("_dated")
