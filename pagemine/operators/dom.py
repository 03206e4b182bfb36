"""HTML tokens, the node table and its clean-up.

A page is cut into tokens in its own row, and a stack over short facts about them builds the
tree there too (`tree`). Nothing is shuffled and no page is split or joined again, so pages
with equal ids stay apart; one page is the unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.bind import let, once
from pagemine.functions.text import attribute, collapse_text, count_punctuation, decode_entities
from pagemine.operators import tree
from pagemine.operators.tree import CLOSE, LEAF, OPEN, TEXT

# Elements that never have content.
VOID_TAGS = ["br", "img", "meta", "link", "input", "hr", "area", "source", "base", "col", "embed", "param", "track", "wbr"]
# Elements and class words whose subtrees hold no article text.
USELESS_TAGS = ["style", "script", "link", "video", "iframe", "source", "picture", "header"]
USELESS_CLASS_WORDS = [
    "share", "contribution", "copyright", "disclaimer", "recommend", "related", "footer", "comment", "social", "submeta",
]
TOKEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*\z|</?[a-z][^>]*>|<![^>]*>|<\?[^>]*>|[^<]+|<"


def preclean_html(html: Column) -> Column:
    """Remove line breaks and comments."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)</?br\b[^>]*>", ""), r"(?s)<!--.*?-->", "")


def token_array(html: Column) -> Column:
    """Tags, text runs, whole scripts and whole styles of a page, in order."""
    return F.regexp_extract_all(preclean_html(html), F.lit(TOKEN), F.lit(0))


def with_page_ids(pages: DataFrame) -> DataFrame:
    """Pages without an id take one from what they hold, so that none is lost."""
    return pages.withColumn("page_id", F.coalesce("page_id", F.xxhash64(*[F.col(c) for c in ("url", "html") if c in pages.columns])))


def token_facts(tokens: Column) -> Column:
    """Per token its kind, tag, whether it starts a useless subtree, and the counts of its text."""

    def named(token: Column) -> Column:
        is_tag = F.startswith(token, F.lit("<")) & (token != "<")
        name = F.when(is_tag, F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9:-]*)[^>]*>", 1))).otherwise("")
        return let(F.struct(is_tag.alias("is_tag"), name.alias("tag")), lambda t: kinds(token, t["is_tag"], t["tag"]))

    def kinds(token: Column, is_tag: Column, tag: Column) -> Column:
        closing = F.startswith(token, F.lit("</"))
        whole = F.lower(F.substring(token, -9, 9)).eqNullSafe("</script>") | F.lower(F.substring(token, -8, 8)).eqNullSafe("</style>")
        void = tag.isin(VOID_TAGS)
        kind = (
            F.when(tag == "", F.when(~is_tag, TEXT))
            .when(void & closing, F.lit(None))
            .when(void | (tag.isin("script", "style") & whole & ~closing), LEAF)
            .when(closing, CLOSE)
            .otherwise(OPEN)
        )
        return let(kind, lambda kind: facts(token, tag, kind))

    def facts(token: Column, tag: Column, kind: Column) -> Column:
        flat = F.when(kind == TEXT, collapse_text(decode_entities(token))).otherwise("")
        starts = kind.isin(OPEN, LEAF)
        class_name = F.when(starts & F.contains(token, F.lit("=")), attribute(token, "class"))
        useless = tag.isin(USELESS_TAGS) | F.coalesce(class_name.rlike("|".join(USELESS_CLASS_WORDS)), F.lit(False))
        return let(flat, lambda text: F.struct(
            kind.alias("kind"),
            tag.alias("tag"),
            (starts & useless).alias("useless"),
            F.length(text).alias("chars"),
            count_punctuation(text).alias("marks"),
        ))

    return F.transform(tokens, named)


#: Inputs estimated at fewer partitions than this share of the cores are dealt to all cores.
FEW_PARTITIONS = 0.5


def spread(pages: DataFrame) -> DataFrame:
    """Pages as they are read; where they are too few to give the cores a partition each, dealt out evenly.

    Pages grow by an order of magnitude when they are cut, so a small file would keep one core busy
    and leave the others idle. What Spark knows of the size decides, nothing is counted; inputs of a
    partition's size per core are never moved.
    """
    spark = pages.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # the tables read, as estimates of joins multiply
    leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(at).stats().sizeInBytes())) for at in range(leaves.size()))
    partition = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return pages.repartition(cores) if size < FEW_PARTITIONS * cores * partition else pages


def with_tokens(pages: DataFrame) -> DataFrame:
    """Pages with their tokens, cut once, and a fact about each; only the facts go to the stack."""
    cut = once(spread(pages), {"tokens": token_array(F.col("html"))})
    return once(cut, {"facts": token_facts(F.col("tokens"))})


def _raw_trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return tree.raw_trees(batches)


def _clean_trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return tree.clean_trees(batches)


def tree_of(facts: Column) -> Column:
    """The cleaned tree over token facts: struct (nodes, texts, points, has_body, deviation)."""
    return F.arrow_udf(_clean_trees, tree.CLEAN_TREE)(facts)


def with_trees(pages: DataFrame) -> DataFrame:
    """Pages with `tokens` and `tree`, the struct (nodes, texts, points, has_body, deviation) of the cleaned tree."""
    return with_tokens(pages).withColumn("tree", tree_of(F.col("facts"))).drop("facts")


def _raw_nodes(pages: DataFrame) -> DataFrame:
    rows = with_tokens(with_page_ids(pages).select("page_id", "html"))
    return rows.select("page_id", F.inline(F.arrow_udf(_raw_trees, tree.RAW_TREE)(F.col("facts"))))


def html_nodes(pages: DataFrame) -> DataFrame:
    """The raw node table: one row per element, subtree = [seq, end_seq)."""
    return _raw_nodes(pages).select("page_id", "seq", "end_seq", "tag", "depth", "parent_seq")


def drop_useless_nodes(pages: DataFrame) -> DataFrame:
    """Elements outside the subtrees of useless tags and useless classes."""
    return _raw_nodes(pages).where("not useless").select("page_id", "seq", "end_seq", "tag")


def drop_empty_nodes(pages: DataFrame) -> DataFrame:
    """Elements without the headings, sections and spans that hold nothing."""
    return _raw_nodes(pages).where("not empty").select("page_id", "seq", "end_seq", "tag")


def retag_nodes(pages: DataFrame) -> DataFrame:
    """Childless div and span become p; span and strong inside p are dissolved."""
    return _raw_nodes(pages).where("not dissolved").select("page_id", "seq", "tag", "new_tag")
