"""Source divergence audit: terms counted per language and source, and how far the sources' terms differ.

Terms are counted inside tasks without making strings of them. The bytes of many texts are cut by
table lookups; terms of up to 8 bytes become one 64-bit word, up to 16 bytes two, big-endian and
padded with zeros, so that equal words are equal terms and their order is that of the bytes. Words
are radix-sorted by 16-bit digits, with the group as the least digits, and counted as runs; documents
per run are the changes of document inside it, as sorting is stable. Longer terms go to buckets by
the power of two above their length and are sorted as bytes there.

What is shuffled is one row per task, group and term. Sources are compared in tiles of at most 2 x
TILE sources and about TERMS terms. A pair of sources without a term differs there by a constant, so
a tile gives what the terms it holds add to that, and no row per pair and term is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemine.functions.skew import first_rows_per_key
from pagemine.llm.common import staged

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Documents cut at once; term occurrences and bytes of long terms that a task holds before it counts them.
SLICE, HELD, HELD_BYTES = 256, 1 << 21, 1 << 24
TILE, TERMS = 128, 8192

_IN_TERM = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned `keys`, the first most significant: least digits of 16 bits first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, key.itemsize * 8, 16):
            digit = ((key >> key.dtype.type(shift)) & key.dtype.type(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: where each run of equal keys starts, its length, and how many documents it has."""
    new = np.ones(len(docs), bool)
    new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    starts = np.flatnonzero(new)
    new[1:] |= docs[1:] != docs[:-1]
    return starts, np.diff(np.append(starts, len(docs))), np.add.reduceat(new.astype(np.int64), starts)


class TermCounter:
    """Occurrences and documents per (group, term) of the texts added, by length-bucketed packing."""

    def __init__(self):
        self.documents = 0
        self.clear()

    def clear(self):
        self.held = self.held_bytes = 0
        self.short: dict[int, list[tuple[np.ndarray, ...]]] = {1: [], 2: []}
        self.long: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray):
        """Texts in UTF-8, one after the other in `data`, cut at `offsets`, with their group numbers."""
        data = np.append(_LOWER[data], np.zeros(16, np.uint8))
        inside = _IN_TERM[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True  # a term does not go on in the next text
        starts = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
        ends = np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1
        lengths = ends - starts
        text = np.searchsorted(offsets, starts, side="right") - 1
        group, doc = groups[text].astype(np.uint32), (text + self.documents).astype(np.int64)
        self.documents += len(offsets) - 1
        self.held += len(starts)
        # the eight bytes from every place on as one number
        word = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        for words in (1, 2):
            which = np.flatnonzero((lengths > 8 * words - 8) & (lengths <= 8 * words))
            at = starts[which] + 8 * words - 8
            spare = (8 * (8 * words - lengths[which])).astype(np.uint64)
            last = (word[at].astype(np.uint64) >> spare) << spare
            packed = (last,) if words == 1 else (word[starts[which]].astype(np.uint64), last)
            self.short[words].append((*packed, group[which], doc[which]))
        which = np.flatnonzero(lengths > 16)
        widths = np.int64(1) << np.ceil(np.log2(lengths[which])).astype(np.int64)
        for width in np.unique(widths):
            mine = which[widths == width]
            terms = np.array([data[a:b].tobytes() for a, b in zip(starts[mine], ends[mine], strict=True)], f"S{width}")
            self.long.setdefault(int(width), []).append((terms, group[mine], doc[mine]))
            self.held_bytes += len(mine) * int(width)

    def counts(self):
        """(terms as bytes, groups, occurrences, documents) per bucket; forgets what was counted."""
        for words, parts in self.short.items():
            if parts and any(len(part[0]) for part in parts):
                *packed, group, doc = map(np.concatenate, zip(*parts, strict=True))
                order = radix_order([*packed, group])
                keys = [key[order] for key in (*packed, group)]
                starts, n, docs = runs(keys, doc[order])
                spelt = np.stack([key[starts] for key in keys[:-1]], axis=1).astype(">u8")
                yield spelt.view(f"S{8 * words}").ravel().tolist(), keys[-1][starts], n, docs
        for parts in self.long.values():
            terms, group, doc = map(np.concatenate, zip(*parts, strict=True))
            order = np.argsort(group, kind="stable")
            order = order[np.argsort(terms[order], kind="stable")]
            keys = [terms[order], group[order]]
            starts, n, docs = runs(keys, doc[order])
            yield keys[0][starts].tolist(), keys[1][starts], n, docs
        self.clear()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs(text, lang, source), several rows per key, and a row without term per group."""
    kind = "lang string, source string, term string, n long, docs long"

    def run(batches):
        counter, numbers = TermCounter(), {}

        def flush():
            langs, sources = pa.array([g[0] for g in numbers], pa.string()), pa.array([g[1] for g in numbers], pa.string())
            for terms, group, n, found in counter.counts():
                group = pa.array(group)
                columns = [langs.take(group), sources.take(group), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keys = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
                groups = np.array([numbers.setdefault(key, len(numbers)) for key in keys], np.int64)
                texts = part.column("text").cast(pa.large_binary())
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                counter.add(data, offsets - offsets[0], groups)
                if counter.held >= HELD or counter.held_bytes >= HELD_BYTES:
                    yield from flush()
        yield from flush()
        none = pa.array([0] * len(numbers), pa.int64())
        names = [pa.array([g[at] for g in numbers], pa.string()) for at in (0, 1)]
        yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(numbers), pa.string()), none, none], names=["lang", "source", "term", "n", "docs"])

    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(run, kind)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in at least min_docs documents of their language.

    n counts in the group, lang_n in the language; `first` marks one row per language and term. A row
    without term stands for every group. Counts are added up and held against the language in one shuffle.
    """
    summed = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    rows = summed.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("docs").over(term).alias("docs"),
        F.sum("n").over(term).alias("lang_n"),
        (F.col("source") == F.min("source").over(term)).alias("first"),
    )
    return rows.where((F.col("docs") >= min_docs) | F.col("term").isNull()).drop("docs")


def _share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * n_terms)), in decimals; null where there are no terms."""
    over = f"cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))"
    return F.expr(f"1 + {over} div nullif(cast({total} + 2 * n_terms as decimal(20,0)), cast(0 as decimal(20,0)))")


def _apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so 64 bits hold the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _compare_tiles(tile: int):
    """What the terms of a tile add to the pairs (a, b) of its sources, beyond what pairs without the term have."""

    def compare(key, table):
        lang, low, high, _ = (k.as_py() for k in key)
        place, share = table.column("place").to_numpy(), table.column("p").to_numpy()
        terms = table.column("term").combine_chunks().dictionary_encode()
        term = terms.indices.fill_null(-1).to_numpy().astype(np.int64)
        alone = np.flatnonzero(term < 0)
        alone = alone[np.argsort(place[alone], kind="stable")]
        sources, base = place[alone], share[alone]
        shares = np.tile(base, (len(terms.dictionary), 1))
        shares[term[term >= 0], np.searchsorted(sources, place[term >= 0])] = share[term >= 0]

        def apart(p, q):
            return (p - q) * (p - q) // (p + q)

        firsts, seconds, added = [], [], []
        for at in np.flatnonzero(sources // tile == low):
            others = np.flatnonzero((sources // tile == high) & (sources > sources[at]))
            found = apart(shares[:, at : at + 1], shares[:, others]).sum(axis=0) - len(shares) * apart(base[at], base[others])
            firsts.append(np.full(len(others), sources[at]))
            seconds.append(sources[others])
            added.append(found)
        columns = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in (firsts, seconds, added)]
        names = pa.array([lang] * len(columns[0]), pa.string())
        return pa.table([names, *map(pa.array, columns)], names=["lang", "a", "b", "added"])

    return compare


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    tiles = F.expr(f"explode(sequence(0, cast((n_sources - 1) div {TILE} as int)))").alias("tile")
    slices = f"cast(greatest(1, (n_terms + {TERMS - 1}) div {TERMS}) as int)"
    terms = rows.where("term is not null").select("lang", "place", "term", "p", "n_sources", F.expr(f"pmod(xxhash64(term), {slices})").cast("int").alias("slice"))
    alone = groups.where("n_terms > 0").select(
        "lang", "place", F.lit(None).cast("string").alias("term"), "p", "n_sources", F.expr(f"explode(sequence(0, {slices} - 1))").alias("slice")
    )
    own = F.expr(f"cast(place div {TILE} as int)")
    dealt = terms.unionByName(alone).withColumn("tile", tiles).withColumns({"low": F.least(own, "tile"), "high": F.greatest(own, "tile")})
    parts = dealt.select("lang", "low", "high", "slice", "place", "term", "p").groupBy("lang", "low", "high", "slice")
    added = parts.applyInArrow(_compare_tiles(TILE), "lang string, a long, b long, added long").groupBy("lang", "a", "b").agg(F.sum("added").alias("added"))
    # the pairs are the result; each is met by its number, so that no task holds a language
    one = groups.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sources") - 1))).where("other <> place")
    two = groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item"), F.col("p").alias("q"))
    both = one.join(two, ["lang", "other"]).withColumns({"a": F.least("place", "other"), "b": F.greatest("place", "other")})
    value = F.coalesce(F.col("n_terms") * _apart("p", "q") + F.coalesce("added", F.lit(0)), F.lit(0)).cast("long")
    return both.join(added, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of docs(text, lang, source).

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps the
    terms in at least `min_docs` of its rows. Part `pair`: per group (lang, source) each other source
    of the language, value the sum over kept terms of floor((p-q)^2/(p+q)), p and q the smoothed
    shares of the two. Part `term`: the `top` kept terms that the group has and has more often than
    its language, by the same measure. Ranks go by value descending, then item in UTF-8 order.
    Null lang, source and text read as empty; a group without terms has its pairs, of value 0 where
    the language keeps none; a source alone in its language has no pair. Repeated rows each count;
    texts and terms of any length are read whole; other columns are ignored; an empty table gives an
    empty result.
    """
    kept = staged(kept_counts(docs, min_docs), "kept")
    langs = kept.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))), F.lit(0)).alias("lang_total"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("n_terms"), F.count_if(F.col("term").isNull()).alias("n_sources"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("place")
    groups = totals.join(langs, "lang").select("*", place, _share("0", "total").alias("p"))
    groups = staged(groups, "groups")
    known = groups.select("lang", "source", "place", "total", "lang_total", "n_terms", "n_sources")
    rows = kept.where("term is not null").join(known, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")})
    pairs = _pairs(rows, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pairs.withColumn("rank", rank)
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    best = first_rows_per_key(terms, ["lang", "source"], [F.col("value").desc(), F.col("item")], top).withColumn("rank", rank)
    return pairs.unionByName(best)
