"""Mixing sources to target weights, in DataFrame functions only.

Words are added up per source; each source's target is its weight's share of all words,
but at most a fixed multiple of what it has, the excess going to the others by weight.
The repetition rate is target / words; a document is emitted floor(rate) times, plus one
copy with probability equal to the fraction, decided by a seeded hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemine.llm.common import staged

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Position of each source by code point, null last, from 0.

    Sources are range-partitioned and ranked inside their partition; an offset per
    partition (a few rows) makes the ranks global, so no task gets all sources.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    parts = staged(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = sizes.select("_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(offsets, "_part").withColumn("_rank", inside + F.col("_before")).drop("_part", "_before")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source of sizes(source, size): source, source_size, target.

    Targets share 100 % of all sizes by weight (weights repeat over the sources in code
    point order, null last). A target above max_repeats * source_size stops there; what is
    over is shared again by weight among the others until none is above. Each round caps at
    least one more source; only two sums come back to the driver per round.
    """
    totals = staged(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "totals")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(_ranked(totals).select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    cap = F.lit(max_repeats) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    over, n_over = F.lit(False), 0
    while True:
        sums = ranked.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        left, open_weight = total - (sums.held or 0), sums.open or 0
        share = F.col("weight") * F.lit(left) / F.lit(open_weight) if open_weight else F.lit(0.0)
        # shares only grow from round to round, so what was above stays above
        now = over | (F.col("weight") * F.lit(left) > cap * F.lit(open_weight))
        count = ranked.where(now).count()
        if count == n_over:
            break
        over, n_over = now, count
    return staged(ranked.select("source", "source_size", F.when(over, cap.cast("double")).otherwise(share).alias("target")), "targets")


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a document's id: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Every row of docs(doc_id, text, source, …) with size, source_size, target and copies added.

    size counts the words [^\\x20\\x09-\\x0D]+ (null text: 0); copies is how often the mix takes
    the document, 0 to max_repeats. A source without any word has target 0 and is taken 0 times.
    Sources differ by code points and null is a source of its own. Rows with equal ids get equal
    draws, so reruns agree; null ids share one. Input columns with the names added are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    rows = docs.select(*[c for c in docs.columns if c not in added], words_in(F.col("text")).alias("size"))
    targets = source_targets(docs.select("source", words_in(F.col("text")).alias("size")), weights, max_repeats)
    known = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = rows.join(known, rows["source"].eqNullSafe(known["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(chance(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int"))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as `mixed` takes it, with the columns of docs."""
    rows = mixed(docs, **options).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*docs.columns)
