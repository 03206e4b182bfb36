"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text becomes the set of its word n-grams, as 64-bit hashes. Two sets with Jaccard
similarity of at least t share one of their first n - ceil(t n) + 1 n-grams in any order
common to all; ordered rare first, these prefixes rarely meet by chance. Prefix n-grams
are joined, pairs that length or position rule out are dropped, then those that counts per
hash range rule out (suffix filter), and the rest is verified once per pair on whole sets.

Rarity is counted over all texts in a table of fixed size, so counts of n-grams in the
same bucket add up. That changes which n-grams come first, never the result.

Groups of copies. Texts with equal word sequences are one class. Between classes the
answer asked for is who reaches whom, so a group that shares a prefix n-gram is not
expanded into all its pairs: first every member meets the hubs of its group, and the
links found join components; then all pairs across components are verified. A pair inside
a component is not looked at: it could only confirm what is known. Hubs are the members
that hold the shared n-gram earliest in their prefix, that is those with the fewest rare
n-grams of their own, which in a family of copies are the ones most others are near to.
No cap is involved: hubs only decide what is looked at first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import bucket_counts, components, in_filter, key_filter, staged

BUCKET_BITS = 20
#: Hash ranges of the suffix filter, and 64-bit words of its parity bits.
RANGES, PARITY_WORDS = 16, 16
#: Hubs of a group: one for each residue of the class key.
HUBS = 8
WORDS_KEPT = 400_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Hash of a word, computed once; emptied when it has grown to WORDS_KEPT."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def class_key(words: list[bytes]) -> int:
    """64 bits, signed, of the word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of n-grams; fewer words than `size` make one n-gram of them all."""
    count = len(words)
    if not count:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, count)
    size = min(size, count)
    rolled = each[: count - size + 1] + np.uint64(size)
    for at in range(1, size):
        rolled = _mix(rolled) * _M1 + each[at : count - size + 1 + at]
    return np.unique(_mix(rolled))


def parity(grams: np.ndarray) -> np.ndarray:
    """A bit per residue of the hash: whether an odd number of n-grams has it.

    Every n-gram that only one of two sets has flips one bit, so two sets differ by at
    least as many n-grams as their parities by bits.
    """
    bits = np.bincount((grams & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _texts(batch) -> list[str | None]:
    return batch.column("text").to_pylist()


def _summaries(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: id, class key, set size, counts per hash range, parity bits, prefix n-grams rare first."""
    spark = docs.sparkSession

    def hashes_of(batch):
        known = WordHashes()
        for text in _texts(batch):
            yield shingles(words_of(text), size, known)

    counts = spark.sparkContext.broadcast(bucket_counts(docs.select("text"), hashes_of, BUCKET_BITS))

    def summarise(batches):
        known, often = WordHashes(), counts.value
        for batch in batches:
            keys, sizes, ranges, parities, prefixes = [], [], [], [], []
            for text in _texts(batch):
                words = words_of(text)
                grams = shingles(words, size, known)
                keys.append(class_key(words))
                sizes.append(len(grams))
                ranges.append(np.bincount((grams >> np.uint64(60)).astype(np.int64), minlength=RANGES).astype(np.int32))
                parities.append(parity(grams))
                order = np.argsort(often[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")
                prefixes.append(grams[order[: prefix_length(len(grams), percent)]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(ranges, pa.list_(pa.int32())),
                    pa.array(parities, pa.list_(pa.int64())),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "ranges", "parity", "prefix"],
            )

    schema = "doc_id long, key long, n int, ranges array<int>, parity array<long>, prefix array<long>"
    return staged(docs.mapInArrow(summarise, schema), "shingles")


def _sets(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """The whole sets of the classes in `keys`, one row per class."""
    table = docs.sparkSession.sparkContext.broadcast(key_filter(keys))

    def wanted(batches):
        known, bits = WordHashes(), table.value
        last: set[int] = set()
        for batch in batches:
            found, sets = [], []
            for text in _texts(batch):
                words = words_of(text)
                key = class_key(words)
                if in_filter(bits, key) and key not in last:
                    if len(last) >= 10_000:
                        last.clear()
                    last.add(key)
                    found.append(key)
                    sets.append(shingles(words, size, known).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "grams"])

    sets = docs.select("text").mapInArrow(wanted, "key long, grams array<long>")
    # equal keys have equal sets: a copy is dropped without sorting the arrays
    return sets.join(keys.distinct(), "key", "left_semi").dropDuplicates(["key"])


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of class keys, those with a similarity of at least percent / 100."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    side = classes.select("key", "n", "ranges", "parity")
    total = lambda column: F.aggregate(column, F.lit(0), lambda s, x: s + x)
    moved = total(F.zip_with("ra", "rb", lambda x, y: F.abs(x - y)))
    flipped = total(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    narrow = (
        pairs.join(side.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("ranges").alias("ra"), F.col("parity").alias("pa")), "a")
        .join(side.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("ranges").alias("rb"), F.col("parity").alias("pb")), "b")
        # suffix filter: what two sets are seen to differ by bounds what they share
        .where(F.greatest(moved, flipped) <= F.col("na") + F.col("nb") - 2 * need)
        .select("a", "b")
    )
    narrow = staged(narrow, "pairs")
    keys = narrow.select(F.explode(F.array("a", "b")).alias("key"))
    sets = staged(_sets(docs, keys, size), "sets")
    left, right = sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("key").alias("b"), F.col("grams").alias("gb"))
    both = narrow.join(left, "a").join(right, "b").select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("common"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _fits(percent: int):
    """Length and positional filters for rows x, y that share an n-gram."""
    short, long = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (F.lit(100) * short >= F.lit(percent) * long) & (F.lit(100 + percent) * rest >= F.lit(percent) * (F.col("x.n") + F.col("y.n")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of
    `size`-word n-grams; component_id is the smallest doc_id reachable by links, itself
    included. Null and empty texts, and texts without words, have no n-grams and link with
    nothing. Equal texts always link. A null doc_id takes part; the smallest id ignores it,
    and is null where a component has none. Repeated rows are all returned. Other columns
    are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _summaries(docs, size, percent)
    classes = rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"), F.first("parity").alias("parity"), F.min("doc_id").alias("doc_id"))
    classes = staged(classes, "classes")
    grams = rows.select("key", "n", F.posexplode("prefix").alias("pos", "token"))
    ends = grams.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token")
    shared = staged(grams.join(ends, "token").distinct(), "shared")

    slot = F.pmod("key", F.lit(HUBS))
    hubs = shared.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("pos", "key", "n")).alias("hub")).select("token", "hub.*")
    met = hubs.alias("x").join(shared.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.key") != F.col("y.key")) & _fits(percent))
    tried = staged(_ordered(met), "tried")
    links = staged(_verified(docs, tried, classes, size, percent), "links")
    labels = staged(components(links), "labels").withColumnRenamed("node", "key")
    labelled = shared.join(labels, "key", "left").select("token", "key", "n", "pos", F.coalesce("component", "key").alias("component"))
    labelled = staged(labelled, "labelled")
    ends = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    open_rows = staged(labelled.join(ends, "token"), "open")  # groups that span components
    met = open_rows.alias("x").join(open_rows.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _fits(percent))
    untried = _ordered(met).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(docs, untried, classes, size, percent))
    labels = staged(components(links), "labels")

    named = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"), "doc_id")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("key", "component_id")
    return rows.join(named, "key", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
