"""Pages as documents: one row per page with its nodes and texts as sorted arrays.

The steps after the node scores look at a few nodes of one page at a time, so they are
projections over these arrays: no join, no shuffle, and a page costs the same wherever
it lies. A document is never larger than a small multiple of its page.

nodes:  seq, end_seq, depth, parent_seq, tag, in_body, ti … marks, text_at, text_count,
        nth (among the siblings of its tag), token, class, id, score
texts:  seq, parent_seq, text, first (whether it is the first own text of its parent)
points: seq, parent_seq, tag, token
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.bind import let, once
from pagemine.functions.text import attribute, collapse_text, decode_entities
from pagemine.operators.density import MEASURED, node_score, punctuation_density, text_density
from pagemine.operators.dom import with_page_ids, with_trees

NODE = [*MEASURED, "nth"]


def page_docs(pages: DataFrame) -> DataFrame:
    """Pages with nodes, texts and points in place of html: other columns are kept, row for row."""
    return documented(with_trees(with_page_ids(pages)))


def documented(trees: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with `tokens` and `tree` as documents; columns to `keep` may be these two."""

    def token(item: Column) -> Column:
        return F.element_at("tokens", (item["seq"] / 2 + 1).cast("int"))

    def attr(token: Column, name: str) -> Column:
        return F.when(F.contains(token, F.lit("=")), attribute(token, name))

    def full_node(node: Column) -> Column:
        sbdi = punctuation_density(node["ti"], node["lti"], node["marks"])
        score = node_score(
            F.col("tree.deviation"), text_density(node["ti"], node["lti"], node["tgi"], node["ltgi"]), node["p_count"], sbdi
        )
        eligible = node["in_body"] | ~F.col("tree.has_body")
        return let({"token": token(node), "score": score}, lambda own: F.struct(
            *[node[name].alias(name) for name in NODE],
            own["token"].alias("token"),
            attr(own["token"], "class").alias("class"),
            attr(own["token"], "id").alias("id"),
            F.when(eligible & ~F.isnan(own["score"]), own["score"]).alias("score"),
            eligible.alias("eligible"),
        ))

    full = {
        "nodes": F.transform(F.coalesce("tree.nodes", F.array()), full_node),
        "texts": F.transform(
            F.coalesce("tree.texts", F.array()),
            lambda t: F.struct(t["seq"].alias("seq"), t["parent_seq"].alias("parent_seq"), decode_entities(token(t)).alias("text"), t["first"].alias("first")),
        ),
        "points": F.transform(
            F.coalesce("tree.points", F.array()),
            lambda p: F.struct(
                p["seq"].alias("seq"), p["parent_seq"].alias("parent_seq"), p["tag"].alias("tag"), token(p).alias("token")
            ),
        ),
    }
    kept = [name for name in trees.columns if name in keep or name not in ("html", "tokens", "tree", *full)]
    held = trees.drop(*[name for name in full if name in trees.columns])
    return once(held, full).select(*kept, *full)


def inside(item: Column, node: Column) -> Column:
    return (item["seq"] > node["seq"]) & (item["seq"] < node["end_seq"])


def texts_of(node: Column) -> Column:
    """The text pieces inside a node: a slice, since pieces are in page order."""
    return F.slice(F.col("texts"), node["text_at"] + 1, node["text_count"])


def node_text(node: Column) -> Column:
    """Trimmed non-empty pieces of a node joined by newlines."""
    flat = F.transform(texts_of(node), lambda t: collapse_text(t["text"]))
    return F.array_join(F.filter(flat, lambda t: t != ""), "\n")


def string_value(node: Column) -> Column:
    """All text of a node as it stands."""
    return F.array_join(F.transform(texts_of(node), lambda t: t["text"]), "")


def node_at(seq: Column) -> Column:
    """The node that opens at a position, null when there is none."""
    return let(seq, lambda at: F.get(F.filter("nodes", lambda n: n["seq"] == at), F.lit(0)))


def nodes_with(tags: list[str]) -> Column:
    return F.filter("nodes", lambda n: n["tag"].isin(tags))


def body_texts() -> Column:
    """Text pieces of the body, of the whole page where it has none."""
    body = F.get(nodes_with(["body"]), F.lit(0))
    return F.when(body.isNotNull(), texts_of(body)).otherwise(F.col("texts"))


def body_text(separator: str) -> Column:
    return F.array_join(F.transform(body_texts(), lambda t: t["text"]), separator)


def with_content(docs: DataFrame) -> DataFrame:
    """Add `content_node`, the eligible node with the best score; first in the page on ties."""
    ranked = F.transform(
        F.filter("nodes", lambda n: n["eligible"]),
        lambda n: F.struct(F.coalesce(-n["score"], F.lit(float("inf"))).alias("key"), n["seq"].alias("at")),
    )
    found = once(docs, {"_best": F.array_min(ranked)["at"]})
    return once(found, {"content_node": node_at(F.col("_best"))}).drop("_best")


def outer_html(node: Column) -> Column:
    """HTML source of a node of the cleaned tree, every element closed by its own end tag."""

    def renamed(n: Column) -> Column:
        return F.regexp_replace(n["token"], r"^<[A-Za-z][A-Za-z0-9:-]*", F.concat(F.lit("<"), n["tag"]))

    within = F.filter("nodes", lambda n: (n["seq"] >= node["seq"]) & (n["seq"] < node["end_seq"]))
    opens = F.transform(within, lambda n: F.struct(n["seq"].alias("at"), F.lit(1).alias("rank"), F.lit(0).alias("tie"), renamed(n).alias("piece")))
    closes = F.transform(
        F.filter(within, lambda n: n["end_seq"] > n["seq"] + 1),
        lambda n: F.struct(
            n["end_seq"].alias("at"), F.lit(0).alias("rank"), (-n["seq"]).alias("tie"), F.concat(F.lit("</"), n["tag"], F.lit(">")).alias("piece")
        ),
    )
    texts = F.transform(
        texts_of(node),
        lambda t: F.struct(
            t["seq"].alias("at"),
            F.lit(1).alias("rank"),
            F.lit(0).alias("tie"),
            F.replace(F.replace(F.replace(t["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("piece"),
        ),
    )
    pieces = F.sort_array(F.concat(opens, closes, texts))
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
