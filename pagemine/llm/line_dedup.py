"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over threshold, reassemble.

Two passes. The first counts, per 128-bit hash of a normalised line, the documents that
hold it (a line counts once per document, decided inside its row; the counts are combined
before their shuffle, so a line that every document holds is one row per task). The second
explodes the lines again, drops those whose hash is among the frequent ones, and puts each
document together by position. Only the text is shuffled, once, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import BLANKS, lower_ascii, staged

MIN_DOCS = 10


def line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda line: lower_ascii(F.btrim(line, F.lit(BLANKS))))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(texts: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """Hashes (h1, h2) of the normalised lines found in at least min_docs rows of texts(text), with n_docs."""
    keys = F.filter(line_keys(_lines(F.col("text"))), lambda key: F.length(key) >= min_chars)
    hashes = texts.select(F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"))
    return hashes.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """docs(text, …) with every column but text as it was, and text, n_lines, n_dropped: what is left, and counts.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased.
    Keys of at least min_chars code points found in at least min_docs documents lose all their
    lines in every document; the rest stays, joined by \\n. Null and empty texts are one empty
    line, which is kept (its key is shorter than min_chars), so they give an empty text. Each
    row is a document: repeated rows count separately, and null ids are like any other. Columns
    of the input named n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    frequent = staged(frequent_lines(docs.select("text"), min_docs, min_chars), "lines")
    marked = frequent.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.lit(True).alias("_often"))
    # the row's number is taken before the lines are exploded
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in rest]).alias("_rest"),
        F.col("text").alias("_text"),
    )
    lines = rows.select("_row", "_rest", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
    key = lower_ascii(F.btrim("_line", F.lit(BLANKS)))
    flagged = lines.withColumns({"_h1": _hash(key)["h1"], "_h2": _hash(key)["h2"]}).join(marked, ["_h1", "_h2"], "left")
    cell = F.struct(
        "_pos",
        F.when(F.col("_often").isNull(), F.col("_line")).alias("line"),
        # the other columns travel with a document's first line only
        F.when(F.col("_pos") == 0, F.col("_rest")).alias("rest"),
    )
    whole = flagged.groupBy("_row").agg(F.collect_list(cell).alias("_cells"))
    cells = F.array_sort("_cells", lambda x, y: x["_pos"] - y["_pos"])
    whole = whole.select(cells.alias("_cells"))
    kept = F.filter(F.transform("_cells", lambda c: c["line"]), lambda line: line.isNotNull())
    whole = whole.select(F.col("_cells")[0]["rest"].alias("_rest"), F.size("_cells").alias("_n"), kept.alias("_kept"))
    return whole.select(
        *[F.col("_rest")[c].alias(c) for c in rest],
        F.array_join("_kept", "\n").alias("text"),
        F.col("_n").cast("long").alias("n_lines"),
        (F.col("_n") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
