"""Helpers that keep one hot key from landing in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16


def join_per_key(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join a row-per-key table onto a large table whose keys may be hot.

    `small` has at most one row per key, but may have too many keys to broadcast,
    so each of its rows is repeated per salt and the rows of a hot key are spread
    over that many tasks. Where `small` turns out small, adaptive execution still
    switches the join to a broadcast. `spread` must be a deterministic expression
    of `big`, so that a retried task salts its rows the same way.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


#: Row-per-key tables up to this many bytes are sent to all tasks.
BROADCAST_BYTES = 32 << 20


def attach(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """join_per_key for a table of large rows: `small` is measured first, and sent to all tasks where it is small.

    The rows of `big` are then not shuffled at all. A larger `small` is joined with salts.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))).alias("size")
    bytes_held = small.agg(size).first()[0] or 0
    if bytes_held <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    return join_per_key(big, small, keys, spread, how)


def first_rows_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key.

    Spark cuts each task's rows of a key to n before the shuffle, so a hot key sends n rows per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder the session names."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
