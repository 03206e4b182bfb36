"""Text density of nodes and the pick of the content node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.bind import let, once
from pagemine.operators.dom import with_page_ids, with_trees

MEASURED = [
    "seq", "end_seq", "depth", "parent_seq", "tag", "in_body", "ti", "lti", "tgi", "ltgi", "p_count", "marks", "text_at", "text_count",
]
_KINDS = {"seq": "int", "end_seq": "int", "parent_seq": "int", "tag": "string", "in_body": "boolean"}


def _piece(kind: str, item: Column) -> Column:
    """A text or point as a row of the measured tree: it has a place, but no extent and no measures."""
    has = {"seq": item["seq"], "depth": item["depth"], "parent_seq": item["parent_seq"], "in_body": item["in_body"], "text_at": item["text_at"]}
    has["tag"] = item["tag"] if kind == "point" else F.lit("")
    cells = [has.get(c, F.lit(None)).cast(_KINDS.get(c, "bigint")).alias(c) for c in MEASURED]
    return F.struct(F.lit(kind).alias("kind"), *cells)


def measured_tree(pages: DataFrame) -> DataFrame:
    """The cleaned tree as rows: nodes with their measures, texts and points."""
    trees = with_trees(with_page_ids(pages).select("page_id", "html"))
    rows = F.concat(
        F.transform("tree.nodes", lambda n: F.struct(F.lit("node").alias("kind"), *[n[c].alias(c) for c in MEASURED])),
        F.transform("tree.texts", lambda t: _piece("text", t)),
        F.transform("tree.points", lambda p: _piece("point", p)),
    )
    return trees.select("page_id", F.inline(rows))


def text_density(ti: Column, lti: Column, tgi: Column, ltgi: Column) -> Column:
    return F.when(tgi == ltgi, 0.0).otherwise((ti - lti) / (tgi - ltgi))


def punctuation_density(ti: Column, lti: Column, marks: Column) -> Column:
    """Characters per punctuation mark; zero becomes one, since its logarithm is taken."""
    density = (ti - lti) / (marks + 1)
    return F.when(density == 0, 1.0).otherwise(density)


def node_score(deviation: Column, density: Column, p_count: Column, sbdi: Column) -> Column:
    """ln(deviation) · density · log10(p_count + 2) · ln(sbdi), null where undefined."""
    return F.ln(deviation) * density * F.log10(p_count + 2) * F.ln(sbdi)


def node_measures(pages: DataFrame) -> DataFrame:
    """Measures of every node under body; of all nodes where a page has no body."""
    return node_scores(pages).drop("deviation", "score")


def node_scores(pages: DataFrame) -> DataFrame:
    """The measures with the page's deviation of densities and the score of every node."""
    return _scored(pages, None).drop("rank")


def score_top_k(pages: DataFrame, k: int | None = None) -> DataFrame:
    """Nodes ranked by score per page, first in the document on ties; all without k."""
    return _scored(pages, k)


def _scored(pages: DataFrame, k: int | None) -> DataFrame:
    """Ranked inside the page's row, as its nodes are one array there."""
    trees = with_trees(with_page_ids(pages).select("page_id", "html"))
    eligible = F.filter("tree.nodes", lambda n: n["in_body"] | ~F.col("tree.has_body"))

    def measured(n: Column) -> Column:
        density = text_density(n["ti"], n["lti"], n["tgi"], n["ltgi"])
        return F.struct(n.alias("node"), density.alias("density"), punctuation_density(n["ti"], n["lti"], n["marks"]).alias("sbdi"))

    def scored(m: Column) -> Column:
        return let(
            node_score(F.col("tree.deviation"), m["density"], m["node"]["p_count"], m["sbdi"]),
            lambda s: F.struct(
                F.coalesce(F.when(~F.isnan(s), -s), F.lit(float("inf"))).alias("key"),
                *[m["node"][c].alias(c) for c in MEASURED if c not in ("in_body", "text_at", "text_count")],
                m["density"].alias("density"),
                m["sbdi"].alias("sbdi"),
                F.col("tree.deviation").alias("deviation"),
                F.when(~F.isnan(s), s).alias("score"),
            ),
        )

    held = once(trees, {"_measured": F.transform(eligible, measured)})
    ranked = F.sort_array(F.transform("_measured", scored))
    held = once(held, {"_ranked": ranked if k is None else F.slice(ranked, 1, k)})
    rows = held.select("page_id", F.posexplode("_ranked").alias("at", "n"))
    return rows.select("page_id", "n.*", (F.col("at") + 1).alias("rank")).drop("key")


def content_node(pages: DataFrame) -> DataFrame:
    """The best node of every page."""
    return score_top_k(pages, 1).drop("rank")
