"""Titles: word bags, cosine similarity, the title node and its siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.bind import once
from pagemine.functions.text import square_sum, strip_blanks, words
from pagemine.operators.docs import node_at, nodes_with, string_value, texts_of

# Where a site name is cut off a title; the similarity that counts as equal.
TITLE_SPLIT = "[-_|]"
TITLE_THRESHOLD = 0.8
HEADINGS = ["h1", "h2", "h3", "h4", "h5"]


def split_title(title: Column, pattern: Column | None = None) -> Column:
    """The part of a title before the first match of a pattern, the usual separators where it is null."""
    return F.element_at(F.split(title, F.lit(TITLE_SPLIT) if pattern is None else F.coalesce(pattern, F.lit(TITLE_SPLIT)), 2), 1)


def with_title(docs: DataFrame, configured: Column | None = None, pattern: Column | None = None) -> DataFrame:
    """Add page_title, the text of a configured selector or of <title>, and its first part by the site's pattern."""
    holders = F.transform(nodes_with(["title"]), lambda n: n["seq"])
    own = F.filter("texts", lambda t: F.array_contains(F.col("title_seqs"), t["parent_seq"]))
    found = strip_blanks(F.array_join(F.transform(own, lambda t: t["text"]), ""))
    if configured is not None:
        found = F.coalesce(F.nullif(configured, F.lit("")), found)
    titled = once(once(docs, {"title_seqs": holders}), {"page_title": found})
    return once(titled, {"title_head": split_title(F.col("page_title"), pattern)}).drop("title_seqs")


def word_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Word bag of the text of every row: (keys, word, n).

    The words are sorted inside the row and counted as run lengths: nothing is shuffled.
    """
    bag = once(df, {"_bag": F.sort_array(words(F.col(text)))})
    places = F.when(F.size("_bag") > 0, F.sequence(F.lit(0), F.size("_bag") - 1))
    first = F.filter(places, lambda at: (at == 0) | (F.get("_bag", at) != F.get("_bag", at - 1)))
    bag = once(bag, {"_first": first})
    runs = F.transform(
        "_first",
        lambda at, nth: F.struct(F.get("_bag", at).alias("word"), (F.coalesce(F.get("_first", nth + 1), F.size("_bag")) - at).cast("bigint").alias("n")),
    )
    return bag.select(*keys, F.inline(runs))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of the count vectors of two word arrays: -1 without any words, 0 when one side has none."""
    shared = F.filter(right, lambda word: F.array_contains(left, word))
    dot = F.aggregate(
        shared,
        F.lit(0).cast("bigint"),
        lambda total, word: total + F.size(F.filter(left, lambda other: other == word)).cast("bigint"),
    )
    norms = F.sqrt(square_sum(F.sort_array(left)) * square_sum(F.sort_array(right)).cast("double"))
    return (
        F.when((F.size(left) == 0) & (F.size(right) == 0), -1.0)
        .when((F.size(left) == 0) | (F.size(right) == 0), 0.0)
        .otherwise(dot / norms)
    )


def cosine_scores(df: DataFrame, title: str, candidate: str) -> DataFrame:
    """Add `score`, the cosine between two text columns of the same row."""
    return (
        df.withColumn("_left", words(F.col(title)))
        .withColumn("_right", words(F.col(candidate)))
        .withColumn("score", cosine(F.col("_left"), F.col("_right")))
        .drop("_left", "_right")
    )


def _similar(title_words: Column, rank: int) -> Column:
    """Nodes that may reach the threshold, with their similarity to one title.

    With A the product of the two count vectors, |t| the length of the title's and W the
    words of the node that are not in the title, the node's squared length is at least
    A²/|t|² + W. A cosine of 0.8 therefore needs 9·A² >= 16·|t|²·W, and A and W are sums
    over text pieces: most nodes are ruled out exactly without building their word bag.
    """

    def sums(node: Column) -> Column:
        return F.aggregate(
            F.slice(F.col(f"_pieces{rank}"), node["text_at"] + 1, node["text_count"]),
            F.struct(F.lit(0).cast("bigint").alias("dot"), F.lit(0).cast("bigint").alias("rest")),
            lambda total, piece: F.struct(
                (total["dot"] + piece["dot"]).alias("dot"), (total["rest"] + piece["rest"]).alias("rest")
            ),
        )

    def possible(node: Column) -> Column:
        total = F.transform(F.array(sums(node)), lambda s: (s["dot"] > 0) & (9 * s["dot"] * s["dot"] >= 16 * F.col(f"_square{rank}") * s["rest"]))
        return node["eligible"] & F.element_at(total, 1)

    def scored(node: Column) -> Column:
        bag = F.flatten(F.slice(F.col("_words"), node["text_at"] + 1, node["text_count"]))
        return F.struct(
            (-cosine(title_words, bag)).alias("key"),
            F.lit(rank).alias("rank"),
            F.coalesce(-node["score"], F.lit(float("inf"))).alias("order"),
            node["seq"].alias("at"),
        )

    return F.transform(F.filter("nodes", possible), scored)


def with_title_node(docs: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """Add `title_node`, the node most similar to the full or the split title, and its score.

    Null below the threshold; the full title wins ties, then the better node score.
    """
    if threshold < TITLE_THRESHOLD:
        raise ValueError(f"candidates are only complete for thresholds of at least {TITLE_THRESHOLD}")

    def pieces(title_words: Column) -> Column:
        return F.transform(
            F.col("_words"),
            lambda bag: F.struct(
                F.aggregate(
                    F.filter(bag, lambda word: F.array_contains(title_words, word)),
                    F.lit(0).cast("bigint"),
                    lambda total, word: total + F.size(F.filter(title_words, lambda other: other == word)).cast("bigint"),
                ).alias("dot"),
                F.size(F.filter(bag, lambda word: ~F.array_contains(title_words, word))).cast("bigint").alias("rest"),
            ),
        )

    titles = {1: F.col("page_title"), 2: F.col("title_head")}
    out = once(
        docs,
        {
            "_words": F.transform("texts", lambda t: words(t["text"])),
            **{f"_title{rank}": words(title) for rank, title in titles.items()},
        },
    )
    out = once(
        out,
        {
            **{f"_pieces{rank}": pieces(F.col(f"_title{rank}")) for rank in titles},
            **{f"_square{rank}": square_sum(F.sort_array(f"_title{rank}")) for rank in titles},
        },
    )
    candidates = F.concat(*[_similar(F.col(f"_title{rank}"), rank) for rank in titles])
    out = once(out, {"_best": F.array_min(candidates)})
    reached = -F.col("_best")["key"] >= threshold
    out = once(out, {"_at": F.when(reached, F.col("_best")["at"]), "title_score": F.when(reached, -F.col("_best")["key"])})
    return once(out, {"title_node": node_at(F.col("_at"))}).drop(
        "_words", "_best", "_at", *[f"{name}{rank}" for name in ("_title", "_pieces", "_square") for rank in titles]
    )


def with_heading_title(docs: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """Add heading_title: the h1–h5 text most similar to the split title, else the split title.

    `heading_seq` is the heading it came from, null for the split title.
    """
    lines = F.flatten(
        F.transform(
            nodes_with(HEADINGS),
            lambda h: F.transform(
                texts_of(h), lambda t: F.struct(t["seq"].alias("at"), h["seq"].alias("heading"), strip_blanks(t["text"]).alias("text"))
            ),
        )
    )
    scored = F.transform(
        F.filter(lines, lambda line: line["text"] != ""),
        lambda line: F.struct(
            (-cosine(F.col("_title"), words(line["text"]))).alias("key"), line["at"].alias("at"), line["heading"].alias("heading"), line["text"].alias("text")
        ),
    )
    reached = (F.col("title_head") != "") & (-F.col("_best")["key"] >= threshold)
    return (
        once(once(docs, {"_title": words(F.col("title_head"))}), {"_best": F.array_min(scored)})
        .withColumn("heading_seq", F.when(reached, F.col("_best")["heading"]))
        .withColumn("heading_title", F.when(reached, F.col("_best")["text"]).otherwise(F.col("title_head")))
        .drop("_title", "_best")
    )


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n", 2), 1)


def siblings_of(node: Column) -> Column:
    return F.filter("nodes", lambda n: (n["parent_seq"] == node["parent_seq"]) & (n["seq"] != node["seq"]))


def with_sibling_titles(docs: DataFrame) -> DataFrame:
    """Add leadtitle and subtitle: the first sibling before and after the title node."""
    title = F.col("title_node")
    before = F.get(F.filter(siblings_of(title), lambda n: n["seq"] < title["seq"]), F.lit(0))
    after = F.get(F.filter(siblings_of(title), lambda n: n["seq"] > title["seq"]), F.lit(0))
    return (
        once(docs, {"_before": before, "_after": after})
        .withColumn("leadtitle_value", F.when(F.col("_before").isNotNull(), string_value(F.col("_before"))))
        .withColumn("subtitle_value", F.when(F.col("_after").isNotNull(), string_value(F.col("_after"))))
        .drop("_before", "_after")
    )
