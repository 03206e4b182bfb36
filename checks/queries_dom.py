"""Registered HTML and density queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from pagemine.operators import density as N
from pagemine.operators import dom as D


def _long(df, *names):
    """Cast the named counts to BIGINT, as the SQL twins return them."""
    return df.withColumns({name: F.col(name).cast("bigint") for name in names})


def preclean_html(spark, sf):
    return I.pages(spark, sf).select("page_id", F.md5(D.preclean_html(F.col("html")).cast("binary")).alias("digest"))


def html_nodes(spark, sf):
    return D.html_nodes(I.pages(spark, sf))


def drop_useless_nodes(spark, sf):
    return D.drop_useless_nodes(I.pages(spark, sf))


def drop_empty_nodes(spark, sf):
    return D.drop_empty_nodes(I.pages(spark, sf))


def retag_nodes(spark, sf):
    return D.retag_nodes(I.pages(spark, sf))


def node_measures(spark, sf):
    return N.node_measures(I.pages(spark, sf)).drop("density", "sbdi")


def text_density(spark, sf):
    return N.node_measures(I.pages(spark, sf)).select("page_id", "seq", F.round("density", 6).alias("density"))


def punctuation_density(spark, sf):
    return N.node_measures(I.pages(spark, sf)).select("page_id", "seq", F.round("sbdi", 6).alias("sbdi"))


def node_score(spark, sf):
    return N.node_scores(I.pages(spark, sf)).select("page_id", "seq", F.round("score", 4).alias("score"))


def content_node(spark, sf):
    best = N.content_node(I.pages(spark, sf))
    return best.select("page_id", "seq", "end_seq", "tag", F.round("score", 4).alias("score"))


def score_top_k(spark, sf):
    return N.score_top_k(I.pages(spark, sf), 5).select("page_id", "rank", "seq", "tag")


QUERIES = {
    f.__name__: f
    for f in (
        preclean_html, html_nodes, drop_useless_nodes, drop_empty_nodes, retag_nodes, node_measures, text_density,
        punctuation_density, node_score, content_node, score_top_k,
    )
}
