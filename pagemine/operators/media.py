"""Images, videos, neighbours of the content node and breadcrumbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.bind import let, once
from pagemine.functions.text import attribute, decode_entities
from pagemine.operators.docs import inside, node_at, string_value
from pagemine.operators.selectors import guess_selector
from pagemine.sources.rules import BREADCRUMB_PATTERN


def content_images(content: Column) -> Column:
    """src values of the images inside the content node, in page order."""
    images = F.filter("nodes", lambda n: (n["tag"] == "img") & inside(n, content))
    sources = F.transform(images, lambda n: decode_entities(attribute(n["token"], "src")))
    return F.filter(sources, lambda src: src.isNotNull())


def content_video(content: Column) -> Column:
    """src of the first video inside the content node, dropped subtrees included."""
    videos = F.filter("points", lambda p: (p["tag"] == "video") & inside(p, content))
    sources = F.transform(videos, lambda p: decode_entities(attribute(p["token"], "src")))
    return F.get(F.filter(sources, lambda src: src.isNotNull()), F.lit(0))


def content_siblings(content: Column) -> Column:
    """Nodes next to the content node, itself included, that have no script child."""
    scripts = F.transform(F.filter("points", lambda p: p["tag"] == "script"), lambda p: p["parent_seq"])
    kin = let(
        scripts,
        lambda with_script: F.filter(
            "nodes", lambda n: (n["parent_seq"] == content["parent_seq"]) & ~F.array_contains(with_script, n["seq"])
        ),
    )
    return F.transform(kin, lambda n: n["seq"])


def _own_name(a: Column) -> Column:
    """First own text of a link, without white space; empty when an element comes first."""
    first = F.get(F.filter("texts", lambda t: t["parent_seq"] == a["seq"]), F.lit(0))
    child = F.get(F.filter("nodes", lambda n: n["parent_seq"] == a["seq"]), F.lit(0))
    leads = child.isNull() | (first["seq"] < child["seq"])
    return F.when(leads, F.regexp_replace(first["text"], r"[\s\x{a0}\x{3000}]+", "")).otherwise("")


def _reads_as_path(text: Column, pattern: Column | None = None) -> Column:
    """True when a text holds 'A > B', or the site's own pattern; the usual one is only tried on texts with an arrow."""
    if pattern is not None:
        return F.when(pattern.isNotNull(), F.regexp_like(text, pattern)).otherwise(_reads_as_path(text))
    return F.when(F.contains(text, F.lit(">")) | F.contains(text, F.lit("→")), text.rlike(BREADCRUMB_PATTERN)).otherwise(F.lit(False))


def _holds_pattern(node: Column, pattern: Column | None) -> Column:
    return node.isNotNull() & ~node["tag"].isin("html", "head") & let(string_value(node), lambda text: _reads_as_path(text, pattern))


def breadcrumb_links(container: Column, pattern: Column | None = None) -> Column:
    """Links with a name inside a container whose parent or grandparent reads 'A > B'.

    array<struct(seq, parent_seq, grand_seq, href, name)>
    """
    links = F.filter("nodes", lambda n: (n["tag"] == "a") & (n["seq"] >= container["seq"]) & (n["seq"] < container["end_seq"]))

    def described(a: Column) -> Column:
        parent = node_at(a["parent_seq"])
        return F.struct(
            a["seq"].alias("seq"),
            a["parent_seq"].alias("parent_seq"),
            F.coalesce(parent["parent_seq"], F.lit(-1)).alias("grand_seq"),
            decode_entities(attribute(a["token"], "href")).alias("href"),
            _own_name(a).alias("name"),
        )

    def near_pattern(a: Column) -> Column:
        return _holds_pattern(node_at(a["parent_seq"]), pattern) | _holds_pattern(node_at(a["grand_seq"]), pattern)

    named = F.filter(F.transform(links, described), lambda a: (F.coalesce(a["href"], F.lit("")) != "") & (F.coalesce(a["name"], F.lit("")) != ""))
    return F.filter(named, near_pattern)


def related_links(links: Column) -> Column:
    """Links that share an ancestor with another one, with that ancestor as `common`.

    A link counts when another link has the same parent, a child of its parent as parent,
    or its grandparent as parent.
    """

    def common(a: Column, at: Column) -> Column:
        others = F.filter(links, lambda o: o["seq"] != a["seq"])
        same = F.exists(others, lambda o: o["parent_seq"] == a["parent_seq"])
        below = F.array_min(F.transform(F.filter(others, lambda o: o["grand_seq"] == a["parent_seq"]), lambda o: o["parent_seq"]))
        above = F.exists(others, lambda o: o["parent_seq"] == a["grand_seq"])
        return F.struct(
            a["href"].alias("href"),
            a["name"].alias("name"),
            F.when(same, a["parent_seq"]).when(below.isNotNull(), below).when(above & (a["grand_seq"] >= 0), a["grand_seq"]).alias("common"),
        )

    return F.filter(F.transform(links, common), lambda a: a["common"].isNotNull())


def breadcrumb_path(links: Column) -> Column:
    """Links with their cumulative path: A, A>B, A>B>C."""
    names = F.transform(links, lambda a: a["name"])
    return F.transform(
        links,
        lambda a, at: F.struct(
            a["href"].alias("channel_href"),
            a["name"].alias("channel_name"),
            F.array_join(F.slice(names, 1, at + 1), ">").alias("channel_nav"),
        ),
    )


def _containers(near: Column, source: int, pattern: Column | None = None) -> Column:
    """Children of the ancestors of a node whose text reads 'A > B', with their distance.

    Distance 1 are the children of the node's parent; what was already looked at from
    nearer by, the ancestors themselves, is left out.
    """
    ancestors = F.filter(
        "nodes", lambda n: (n["seq"] < near["seq"]) & (n["end_seq"] > near["seq"]) & ~n["tag"].isin("html", "head")
    )

    def around(parents: Column) -> Column:
        def distance(n: Column) -> Column:
            return F.size(parents) + 1 - F.array_position(parents, n["parent_seq"]).cast("int")

        beside = F.filter(
            "nodes",
            lambda n: F.array_contains(parents, n["parent_seq"])
            & ~F.array_contains(parents, n["seq"])
            & ~n["tag"].isin("html", "head")
            & let(F.btrim(string_value(n), F.lit("\n\t")), lambda text: _reads_as_path(text, pattern)),
        )
        return F.transform(beside, lambda n: F.struct(F.lit(source).alias("source"), distance(n).alias("distance"), n["seq"].alias("at")))

    return let(F.transform(ancestors, lambda n: n["seq"]), around)


def with_breadcrumb(docs: DataFrame, configured: Column | None = None, pattern: Column | None = None) -> DataFrame:
    """Add `channel`(xpath, value, regex) from the nearest container with links.

    Looked for in the configured node, then near the title node, then near the content node, one ancestor
    further out each time. A site's `pattern` replaces the usual one; without it pages that hold
    no '>' or '→' are skipped at once.
    """
    promising = F.exists("texts", lambda t: t["text"].rlike("[>→]"))
    if pattern is not None:
        docs = once(docs, {"_path": pattern})
        pattern = F.col("_path")
        promising = pattern.isNotNull() | promising
    none = F.array().cast("array<struct<source:int,distance:int,at:int>>")
    given = none if configured is None else F.when(
        configured.isNotNull(), F.array(F.struct(F.lit(0).alias("source"), F.lit(0).alias("distance"), configured["seq"].alias("at")))
    ).otherwise(none)
    spots = F.when(promising, F.concat(
        given,
        F.when(F.col("title_node").isNotNull(), _containers(F.col("title_node"), 1, pattern)).otherwise(none),
        F.when(F.col("content_node").isNotNull(), _containers(F.col("content_node"), 2, pattern)).otherwise(none),
    )).otherwise(none)
    held = once(docs, {"_spots": F.sort_array(spots)})
    tried = F.transform(
        "_spots",
        lambda spot: F.transform(F.array(node_at(spot["at"])), lambda node: breadcrumb_links(node, pattern)),
    )
    held = once(held, {"_links": F.get(F.filter(F.flatten(tried), lambda links: F.size(links) > 0), F.lit(0))})
    held = once(held, {"_related": related_links(F.col("_links"))})
    held = once(held, {"_common": node_at(F.element_at(F.transform("_related", lambda a: a["common"]), -1))})
    channel = F.when(
        F.size("_related") > 0,
        F.struct(
            F.concat(guess_selector(F.col("_common")), F.lit("//a")).alias("xpath"),
            breadcrumb_path(F.col("_related")).alias("value"),
            F.lit("").alias("regex"),
        ),
    )
    return once(held, {"channel": channel}).drop("_spots", "_links", "_related", "_common", "_path")
