"""Shared pieces: staged tables, connected components, digests, bounded bit and count tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words where a contract says [\x20\x09-\x0D]: what bytes.split() splits at.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    A session on one machine that names none gets a temporary one; a cluster must name it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Lineage ends there, so a lost executor costs no recomputation, and Spark knows
    the table's size: joins with it are broadcast only below the session's threshold.
    Like checkpoints, these tables belong to whoever empties the shared folder.
    """
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# Union-find inside a task, so that only a spanning forest of its edges is shuffled.

FOREST_EDGES = 200_000


def forest(parent: dict[int, int]) -> Iterator[tuple[int, int]]:
    for node in list(parent):
        root = find(parent, node)
        if root != node:
            yield node, root


def find(parent: dict[int, int], node: int) -> int:
    root = node
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(node, node) != root:
        parent[node], node = root, parent[node]
    return root


def unite(parent: dict[int, int], a: int, b: int) -> None:
    a, b = find(parent, a), find(parent, b)
    if a != b:
        low, high = min(a, b), max(a, b)
        parent[high] = low
        parent.setdefault(low, low)


def _contract(batches):
    """Edges of a task to star edges (node, root); a forest grown over 2 * FOREST_EDGES edges is sent on."""
    parent: dict[int, int] = {}
    seen = 0

    def flush():
        pairs = list(forest(parent))
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            unite(parent, a, b)
        seen += batch.num_rows
        if seen >= 2 * FOREST_EDGES:
            yield flush()
            parent, seen = {}, 0
    if parent:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node with an edge to another.

    component is the smallest node reachable. Each task first reduces up to FOREST_EDGES
    edges to a forest. Where that took several tasks, large-star and small-star steps
    alternate, each a min per node (combined before its shuffle) joined back to the edges;
    a hot node's edges are split by adaptive execution. Every step is staged. Loops and
    repeated edges change nothing; no edges give no rows.
    """
    now = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "edges")
    tasks = -(-now.count() // FOREST_EDGES)
    now = staged(now.coalesce(max(1, tasks)).mapInArrow(_contract, "a long, b long"), "forest")
    mark = None
    while tasks > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = staged(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(found):
            break
        mark = tuple(found)
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# Count and bit tables of fixed size: they cover every row, and only they are sent to all tasks.

PIECES = 64
FLUSH_HASHES = 1 << 21


def bucket_counts(df: DataFrame, hashes_of, bits: int) -> np.ndarray:
    """How often each bucket (the top `bits` bits of a 64-bit hash) occurs, over all rows of df.

    `hashes_of(batch)` yields uint64 arrays. A task adds up one table and sends it in 64
    pieces, which are summed piece by piece; the driver receives 8 * 2**bits bytes, whatever the input.
    """
    size, width = 1 << bits, (1 << bits) // PIECES

    def count(batches):
        table, waiting, held = np.zeros(size, np.int64), [], 0

        def add():
            np.add(table, np.bincount((np.concatenate(waiting) >> np.uint64(64 - bits)).astype(np.int64), minlength=size), out=table)

        for batch in batches:
            for hashes in hashes_of(batch):
                waiting.append(hashes)
                held += len(hashes)
                if held >= FLUSH_HASHES:
                    add()
                    waiting, held = [], 0
        if waiting:
            add()
        if table.any():
            # four bytes a count where they are enough, which is nearly always
            kind = np.uint32 if table.max() < 1 << 32 else np.uint64
            parts = [table[at * width : (at + 1) * width].astype(kind).tobytes() for at in range(PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "counts"])

    def total(key, batches):
        table = np.zeros(width, np.int64)
        for batch in batches:
            for part in batch.column("counts").to_pylist():
                table += np.frombuffer(part, np.uint32 if len(part) == 4 * width else np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["piece", "counts"])

    parts = df.mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(_streamed(total), "piece int, counts binary")
    table = np.zeros(size, np.int64)
    for row in parts.toArrow().to_pylist():
        table[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    return table


def _streamed(function):
    """applyInArrow hands over a whole group as a table; a piece has one row per task."""

    def whole(key, table):
        return pa.Table.from_batches(function(key, table.to_batches()))

    return whole


FILTER_BITS = 24


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit per bucket of the long column `key`, as 2**18 words of 64 bits: a filter without false negatives.

    It only spares work: whoever uses it joins with the keys afterwards. Its size is
    fixed (2 MB), so it may be sent to every task.
    """
    words = 1 << (FILTER_BITS - 6)
    rows = (
        keys.select(F.pmod("key", F.lit(words)).cast("int").alias("word"), F.pmod(F.shiftright("key", 40), F.lit(64)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        .toArrow()
    )
    table = np.zeros(words, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return table


def in_filter(table: np.ndarray, key: int) -> bool:
    return bool((int(table[key % len(table)]) >> ((key >> 40) % 64)) & 1)
