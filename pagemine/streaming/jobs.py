"""Incremental runs: pages arrive as files, results are written per batch.

Row windows over pages are not allowed directly on a stream, so each micro-batch is
handed to the batch operators. A batch writes into its own folder and overwrites it when
it is repeated after a failure, so a result is never counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemine.operators.mining import STATE, merge_states, mining_state, state_rules
from pagemine.operators.records import extract_records, quality_gate
from pagemine.sources.files import PAGES
from pagemine.sources.rules import DEFAULT_ROWS, resolve_config
from pagemine.sources.tables import SITE_KEYS, site_rule_rows, upsert


#: Parts of the URL store of a training stream.
STORE_PARTS = 256


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages from the parquet files that arrive in a folder; `path` may also be a pattern or one file."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_records(
    pages: DataFrame,
    out: str,
    checkpoint: str,
    fields: list[str] | None = None,
    site: Column | None = None,
    rules: DataFrame | None = None,
    gate: bool = False,
    job_id: str | None = None,
) -> StreamingQuery:
    """Extract the records of every arriving page and append them to `out`.

    `site` derives a page's site where the pages have no such column; with `rules` a site's own
    rules come first, and sites without any take the built-in noise rule. `gate` keeps good records only, `job_id` marks the run they belong to.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch if site is None else batch.withColumn("site", site)
        own = rules
        if rules is not None:
            noise = [row for row in DEFAULT_ROWS if row[1] == "noise"]
            own = resolve_config(batch.select("site"), rules, noise)
        records = extract_records(batch, own, fields=fields)
        records = quality_gate(records) if gate else records
        records = records if job_id is None else records.withColumn("job_id", F.lit(job_id))
        records.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(pages, work, checkpoint)


DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams started from now on keep what they remember on the executors' disks, unless the session names a provider."""
    if spark.conf.get(STATE_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(STATE_PROVIDER, ""):
        spark.conf.set(STATE_PROVIDER, DISK_STATE)


def stream_dedup_urls(urls: DataFrame, event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each URL once across batches, exactly.

    Without an event time every URL is remembered, by 128 bits of its digest and on disk: a
    batch looks up its own URLs and reads no other; with one, a URL is forgotten after `delay`.
    """
    keep_state_on_disk(urls.sparkSession)
    if event_time is not None:
        return urls.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    keyed = urls.withColumn("_digest", F.unhex(F.md5(F.coalesce("url", F.lit("")))))
    return keyed.withColumn("_null", F.col("url").isNull()).dropDuplicates(["_digest", "_null"]).drop("_digest", "_null")


def stream_train(
    urls: DataFrame, store: str, checkpoint: str, nums: int = 5, site_rules: str | None = None, job_id: str = "stream", now: Column | None = None
) -> StreamingQuery:
    """Keep the rules of the sites that a batch touches.

    `urls(site, url)`; repeated URLs count once. A batch turns its new URLs into mining state, merges
    it into the state of the parts its sites fall into and writes these parts anew, so it reads no old
    URL: its cost follows its own URLs and the sites' states, whose size does not grow with URLs. The
    newest state of each part and the rules per batch are in `store`; `latest_rules` reads the newest
    rules of every site. With a folder `site_rules`, the rows of `site_rules` for the touched sites are
    upserted there at the end of each batch, as a version per batch.
    """
    spark = urls.sparkSession
    keep_state_on_disk(spark)
    part = F.pmod(F.xxhash64("site"), F.lit(STORE_PARTS)).cast("int")
    digest = F.unhex(F.md5(F.concat_ws("\n", F.col("site"), F.col("url"))))
    fresh = urls.select("site", "url").where("site is not null and url is not null").withColumn("_digest", digest).dropDuplicates(["_digest"]).drop("_digest")
    stamp = F.current_date().cast("timestamp") if now is None else now

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = f"{store}/new/batch={batch_id}"
        mining_state(batch).withColumn("part", part).write.mode("overwrite").parquet(held)
        new = spark.read.schema(f"{STATE}, part int").parquet(held)
        parts = sorted(new.agg(F.collect_set("part")).first()[0])  # at most STORE_PARTS numbers
        if not parts:
            return
        # the newest earlier state of each touched part: folders batch=…/part=…, found by name
        found = spark.read.schema(f"{STATE}, batch long, part int").parquet(f"{store}/state") if batch_id and _exists(spark, f"{store}/state") else None
        merged = new
        if found is not None:
            known = found.where((F.col("batch") < batch_id) & F.col("part").isin(parts))
            newest = known.groupBy("part").agg(F.max("batch").alias("batch"))
            merged = new.unionByName(known.join(F.broadcast(newest), ["part", "batch"], "left_semi").drop("batch"))
        state = merge_states(merged.drop("part")).withColumn("part", part)
        state.write.mode("overwrite").partitionBy("part").parquet(f"{store}/state/batch={batch_id}")
        now_held = spark.read.schema(f"{STATE}, part int").parquet(f"{store}/state/batch={batch_id}").drop("part")
        touched = now_held.join(new.select("site").distinct(), "site", "left_semi")
        state_rules(touched, nums=nums).write.mode("overwrite").parquet(f"{store}/rules/batch={batch_id}")
        if site_rules is not None:
            _publish(spark, spark.read.parquet(f"{store}/rules/batch={batch_id}"), site_rules, job_id, batch_id, stamp)

    return _start(fresh, work, checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _publish(spark: SparkSession, rules: DataFrame, folder: str, job_id: str, batch_id: int, now: Column) -> None:
    """Upsert the best rule of every touched site; the table of batch n is the folder batch=n."""
    best = rules.where("rank = 1").select(
        "site", F.lit(batch_id + 1).alias("version"), F.col("regex").alias("article_regex"),
        F.array(F.concat(F.lit("http://"), "site")).alias("start_urls"), F.array("site").alias("allowed_domains"),
    )
    rows = site_rule_rows(best, job_id, now)
    if _exists(spark, folder):
        earlier = spark.read.parquet(folder).where(F.col("batch") < batch_id)
        newest = earlier.agg(F.max("batch")).first()[0]
        if newest is not None:
            rows = upsert(earlier.where(F.col("batch") == newest).drop("batch"), rows, SITE_KEYS, "version")
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def latest_rules(spark: SparkSession, store: str) -> DataFrame:
    """The rules of the newest batch that touched each site."""
    rules = spark.read.parquet(f"{store}/rules")
    newest = W.partitionBy("site")
    return rules.withColumn("_newest", F.max("batch").over(newest)).where("batch = _newest").drop("_newest", "batch")
