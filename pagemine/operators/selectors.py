"""Selectors: building one for a node, evaluating them on documents, removing noise.

The grammar is closed: steps `/name`, `//name` and `/..`, where a name is a tag or `*`,
each with at most `[@class="…"]`, `[@id="…"]` and `[n]`; a last step may be `/@name`,
`/text()` or `//text()`, and the whole may stand in `string(…)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.functions.bind import let, once
from pagemine.functions.skew import attach
from pagemine.operators.docs import documented, node_at, string_value
from pagemine.operators.dom import token_facts, tree_of, with_trees

# Inline elements that are climbed out of before a selector is built.
CLIMBED_TAGS = ["strong", "font", "i"]

_NAME = r"(?:[A-Za-z][\w:-]*|\*)"
_TESTS = r"(?:\[@(?:class|id)=\"[^\"]*\"\]|\[\d+\])*"
STEP = rf"//?(?:\.\.|{_NAME}{_TESTS})"
TAIL = r"(?:/@[A-Za-z][\w:-]*|//?text\(\))?"
SELECTOR = rf"^(?:{STEP})+{TAIL}$"
WRAPPED = r"^string\((.*)\)$"


def guess_selector(node: Column) -> Column:
    """Selector of a node: steps upward until three are written and a class or id was seen.

    The climb starts outside strong, font and i and ends below body or html.
    """

    def step(n: Column) -> Column:
        index = n["nth"] - 1
        return (
            F.when(n["class"].isNotNull(), F.concat(n["tag"], F.lit('[@class="'), n["class"], F.lit('"]')))
            .when(n["id"].isNotNull(), F.concat(n["tag"], F.lit('[@id="'), n["id"], F.lit('"]')))
            .when(index == 0, n["tag"])
            .otherwise(F.concat(n["tag"], F.lit("["), (index + 1).cast("string"), F.lit("]")))
        )

    def cut(steps: Column) -> Column:
        # Steps from the node upward; the first with a class or id, but at least three.
        seen = F.array_position(F.transform(steps, lambda s: F.contains(s, F.lit("@"))), F.lit(True))
        count = F.when(seen > 0, F.greatest(seen, F.lit(3))).otherwise(F.size(steps).cast("bigint")).cast("int")
        path = F.concat(F.lit("//"), F.array_join(F.reverse(F.slice(steps, 1, count)), "/"))
        return F.when(F.size(steps) > 0, path)

    def climb(n: Column) -> Column:
        chain = F.filter("nodes", lambda m: (m["seq"] <= n["seq"]) & (m["end_seq"] > n["seq"]))
        return let(chain, from_chain)

    def from_chain(chain: Column) -> Column:
        solid = F.transform(F.filter(chain, lambda m: ~m["tag"].isin(CLIMBED_TAGS)), lambda m: m["seq"])
        own = F.element_at(F.transform(chain, lambda m: m["seq"]), -1)
        return let(F.when(F.size(solid) > 0, F.element_at(solid, -1)).otherwise(own), lambda bottom: from_bottom(chain, bottom))

    def from_bottom(chain: Column, bottom: Column) -> Column:
        kept = F.filter(chain, lambda m: (m["seq"] <= bottom) & (~m["tag"].isin("html", "body") | (m["seq"] == bottom)))
        return let(F.reverse(F.transform(kept, step)), cut)

    return let(node, lambda n: F.when(n.isNotNull(), climb(n)))


def value_node(value: Column) -> Column:
    """The first element whose own first text contains a value."""

    def holder(wanted: Column) -> Column:
        firsts = F.filter("texts", lambda t: t["first"] & F.contains(t["text"], wanted))
        return F.array_min(F.transform(firsts, lambda t: t["parent_seq"]))

    return node_at(let(value, lambda wanted: F.when(wanted.isNotNull(), holder(wanted))))


def wrapped(selector: Column) -> Column:
    return F.when(selector.isNull(), "").otherwise(F.concat(F.lit("string("), selector, F.lit(")")))


def _inner(expr: Column) -> Column:
    return F.when(expr.rlike(WRAPPED), F.regexp_extract(expr, WRAPPED, 1)).otherwise(expr)


def selector_key(expr: Column) -> Column:
    """What a node must have to be selected: its tag, or its tag with class or id, by the last step.

    Null where the last step takes any element, and for selectors outside the grammar.
    """
    inner = _inner(expr)
    last = F.regexp_extract(F.regexp_replace(inner, TAIL + "$", ""), f"({STEP})$", 1)
    name = F.regexp_extract(last, rf"^//?({_NAME}|\.\.)", 1)
    return (
        F.when(~inner.rlike(SELECTOR) | name.isin("*", "..", ""), F.lit(None).cast("string"))
        .when(F.contains(last, F.lit("[@class=")), F.concat(name, F.lit("."), F.regexp_extract(last, r'\[@class="([^"]*)"\]', 1)))
        .when(F.contains(last, F.lit("[@id=")), F.concat(name, F.lit("#"), F.regexp_extract(last, r'\[@id="([^"]*)"\]', 1)))
        .otherwise(name)
    )


def node_keys() -> Column:
    """The keys of a document's nodes, each once."""
    named = F.transform("nodes", lambda n: n["tag"])
    classed = F.transform(F.filter("nodes", lambda n: n["class"].isNotNull()), lambda n: F.concat(n["tag"], F.lit("."), n["class"]))
    marked = F.transform(F.filter("nodes", lambda n: n["id"].isNotNull()), lambda n: F.concat(n["tag"], F.lit("#"), n["id"]))
    return F.array_distinct(F.concat(named, classed, marked))


def live_keys(keys: Column) -> Column:
    """Those of the selectors' keys that a document has: a lookup by hash, so that only selectors that may hit are evaluated."""
    return F.array_intersect(keys, node_keys())


def _select(expr: Column) -> Column:
    """Nodes selected by the element steps of a selector, in page order."""
    steps = F.regexp_extract_all(F.regexp_replace(_inner(expr), TAIL + "$", ""), F.lit(f"({STEP})"), F.lit(1))
    root = F.array(F.struct(F.lit(-1).alias("seq"), F.lit(2**31 - 1).alias("end_seq"), F.lit(-2).alias("parent_seq")))

    def advance(context: Column, step: Column) -> Column:
        parts = {
            "deep": F.startswith(step, F.lit("//")),
            "name": F.regexp_extract(step, rf"^//?({_NAME}|\.\.)", 1),
            "by_class": F.contains(step, F.lit("[@class=")),
            "klass": F.regexp_extract(step, r'\[@class="([^"]*)"\]', 1),
            "by_id": F.contains(step, F.lit("[@id=")),
            "ident": F.regexp_extract(step, r'\[@id="([^"]*)"\]', 1),
            "nth": F.regexp_extract(step, r"\[(\d+)\]", 1),
            "parents": F.transform(context, lambda c: c["parent_seq"]),
            "owners": F.transform(context, lambda c: c["seq"]),
            "context": context,
        }
        return let(parts, follow)

    def follow(s: Column) -> Column:
        def named(n: Column) -> Column:
            return (
                ((s["name"] == "*") | (n["tag"] == s["name"]))
                & (~s["by_class"] | n["class"].eqNullSafe(s["klass"]))
                & (~s["by_id"] | n["id"].eqNullSafe(s["ident"]))
            )

        def placed(n: Column) -> Column:
            # the tree numbers siblings of one tag; only other tests need a count of their own
            plain = (s["name"] != "*") & ~s["by_class"] & ~s["by_id"]
            before = F.filter("nodes", lambda m: (m["parent_seq"] == n["parent_seq"]) & (m["seq"] < n["seq"]) & named(m))
            place = F.when(plain, n["nth"]).otherwise(F.size(before) + 1)
            return F.when(s["nth"] == "", True).otherwise(place == s["nth"].cast("int"))

        def reached(n: Column) -> Column:
            below = F.exists(s["context"], lambda c: (c["seq"] < n["seq"]) & (n["end_seq"] <= c["end_seq"]))
            return F.when(s["name"] == "..", F.array_contains(s["parents"], n["seq"])).otherwise(
                named(n) & F.when(s["deep"], below).otherwise(F.array_contains(s["owners"], n["parent_seq"])) & placed(n)
            )

        return F.transform(
            F.filter("nodes", reached),
            lambda n: F.struct(n["seq"].alias("seq"), n["end_seq"].alias("end_seq"), n["parent_seq"].alias("parent_seq")),
        )

    seqs = F.transform(F.aggregate(steps, root, advance), lambda c: c["seq"])
    return let(seqs, lambda found: F.filter("nodes", lambda n: F.array_contains(found, n["seq"])))


def selected(expr: Column) -> Column:
    """Nodes a selector selects, in page order."""
    return _select(expr)


def select_values(expr: Column) -> Column:
    """Values of a selector on a document: array<struct(seq, value)>, in page order."""
    inner = _inner(expr)

    def as_pair(t: Column) -> Column:
        return F.struct(t["seq"].alias("seq"), t["text"].alias("value"))

    def values(nodes: Column) -> Column:
        whole = F.transform(nodes, lambda n: F.struct(n["seq"].alias("seq"), string_value(n).alias("value")))
        attrs = F.filter(
            F.transform(nodes, lambda n: F.struct(n["seq"].alias("seq"), _attribute_of(n["token"], inner).alias("value"))),
            lambda found: found["value"].isNotNull(),
        )
        own = F.filter("texts", lambda t: F.exists(nodes, lambda n: n["seq"] == t["parent_seq"]))
        deep = F.filter("texts", lambda t: F.exists(nodes, lambda n: (n["seq"] < t["seq"]) & (t["seq"] < n["end_seq"])))
        return (
            F.when(expr.rlike(WRAPPED), F.slice(whole, 1, 1))
            .when(inner.rlike(r"//text\(\)$"), F.transform(deep, as_pair))
            .when(inner.rlike(r"/text\(\)$"), F.transform(own, as_pair))
            .when(inner.rlike(r"/@[\w:-]+$"), attrs)
            .otherwise(whole)
        )

    return F.when(
        ~inner.rlike(SELECTOR), F.raise_error(F.concat(F.lit("selector outside the grammar: "), expr))
    ).otherwise(let(_select(expr), values))


def _attribute_of(token: Column, selector: Column) -> Column:
    """Attribute named at the end of a selector."""
    name = F.regexp_extract(selector, r"/@([\w:-]+)$", 1)
    pattern = F.concat(F.lit(r"(?is)\s"), name, F.lit(r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""))
    found = F.regexp_extract_all(token, pattern, F.lit(1))
    return F.regexp_replace(F.get(found, F.lit(0)), r"""^["']|["']$""", "")


def eval_selectors(docs: DataFrame, rules: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """(page_id, field, xpath, pos, seq, value) of every selector on every document.

    `rules` is a short list of (field, selector) for all pages, or a rule table by site,
    whose selectors travel to the pages of the site as one small array.
    """
    if isinstance(rules, list):
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(x).alias("expr")) for f, x in rules])
        held = once(docs, {"_rules": pairs})
    else:
        selectors = rules.where("kind = 'selector'")
        keyed = F.struct("field", "expr", selector_key(F.col("expr")).alias("key"))
        per_site = selectors.groupBy("site").agg(F.sort_array(F.collect_set(keyed)).alias("_rules"))
        held = once(attach(docs, per_site, ["site"], F.col("page_id")), {"_live": live_keys(F.col("_rules.key"))})
        held = once(held, {"_rules": F.filter("_rules", lambda r: r["key"].isNull() | F.array_contains("_live", r["key"]))})
    found = F.transform(
        "_rules",
        lambda rule: F.struct(rule["field"].alias("field"), rule["expr"].alias("xpath"), select_values(rule["expr"]).alias("found")),
    )
    rows = once(held, {"_found": found}).select("page_id", F.explode_outer("_found").alias("rule"))
    return rows.select("page_id", "rule.field", "rule.xpath", F.posexplode_outer("rule.found").alias("pos", "item")).select(
        "page_id", "field", "xpath", "pos", "item.seq", "item.value"
    ).where("pos is not null")


def selector_pool(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Pooled selectors with non-blank text per page and field: (page_id, field, xpath, value)."""
    values = once(
        docs,
        {
            "_found": F.array(
                *[
                    F.struct(
                        F.lit(field).alias("field"),
                        F.lit(xpath).alias("xpath"),
                        F.btrim(F.array_join(F.transform(select_values(F.lit(xpath)), lambda v: v["value"]), ""), F.lit(" \t\r\n")).alias("value"),
                    )
                    for field, xpath in rules
                ]
            )
        },
    )
    rows = values.select("page_id", F.inline_outer("_found"))
    return rows.where("value <> ''")


def configured_first(exprs: Column) -> Column:
    """struct(xpath, value) of the first selector with a non-empty first value, null if none."""
    nothing = F.lit(None).cast("struct<xpath:string,value:string>")

    def tried(expr: Column) -> Column:
        value = F.get(F.transform(select_values(expr), lambda v: v["value"]), F.lit(0))
        hit = F.filter(F.array(F.struct(expr.cast("string").alias("xpath"), value.cast("string").alias("value"))), lambda t: F.coalesce(t["value"], F.lit("")) != "")
        return F.get(hit, F.lit(0))

    # once a selector has hit, the rest is not evaluated
    return F.aggregate(exprs, nothing, lambda found, expr: F.when(found.isNotNull(), found).otherwise(tried(expr)))


def configured_values(exprs: Column) -> Column:
    """struct(xpath, values) of the first selector that finds anything, with all it finds; null if none."""
    nothing = F.lit(None).cast("struct<xpath:string,values:array<string>>")

    def tried(expr: Column) -> Column:
        values = F.transform(select_values(expr), lambda v: v["value"].cast("string"))
        hit = F.filter(F.array(F.struct(expr.cast("string").alias("xpath"), values.alias("values"))), lambda t: F.size(t["values"]) > 0)
        return F.get(hit, F.lit(0))

    return F.aggregate(exprs, nothing, lambda found, expr: F.when(found.isNotNull(), found).otherwise(tried(expr)))


def noise_spans(selectors: Column) -> Column:
    """Where the subtrees lie that the selectors select: array<struct(seq, end_seq)>."""

    def spans_of(selector: Column) -> Column:
        return F.transform(_select(selector), lambda n: F.struct(n["seq"].alias("seq"), n["end_seq"].alias("end_seq")))

    return F.flatten(F.transform(selectors, spans_of))


def without_spans(tokens: Column, spans: Column) -> Column:
    """Tokens outside the spans. A span's own end tag goes with it, by the name that the element was written with."""
    opened, closed = r"^<([A-Za-z][A-Za-z0-9:-]*)", r"^</([A-Za-z][A-Za-z0-9:-]*)"

    def named(span: Column) -> Column:
        written = F.lower(F.regexp_extract(F.get(tokens, (span["seq"] / 2).cast("int")), opened, 1))
        return F.struct(span["seq"].alias("seq"), span["end_seq"].alias("end_seq"), written.alias("tag"))

    def outside(held: Column) -> Column:
        def hit(token: Column, at: Column, span: Column) -> Column:
            own_end = (2 * at == span["end_seq"]) & (F.lower(F.regexp_extract(token, closed, 1)) == span["tag"]) & (span["tag"] != "")
            return ((2 * at >= span["seq"]) & (2 * at < span["end_seq"])) | own_end

        return F.filter(tokens, lambda token, at: ~F.exists(held, lambda span: hit(token, at, span)))

    return let(F.transform(spans, named), outside)


def cut_noise(docs: DataFrame, selectors: Column) -> DataFrame:
    """Documents with `tokens` and `tree` as if the subtrees that the noise selectors select had never been there.

    Only documents with noise are measured anew; the facts of the others are null, which costs nothing.
    """
    noisy = once(docs, {"_noise": F.coalesce(noise_spans(selectors), F.array())})
    cut = F.when(F.size("_noise") > 0, without_spans(F.col("tokens"), F.col("_noise")))
    held = once(noisy, {"_cut": cut})
    held = once(held, {"_facts": F.when(F.col("_cut").isNotNull(), token_facts(F.col("_cut")))})
    again = held.withColumn("_tree", tree_of(F.col("_facts")))
    anew = F.col("_cut").isNotNull()
    return again.withColumns(
        {"tokens": F.when(anew, F.col("_cut")).otherwise(F.col("tokens")), "tree": F.when(anew, F.col("_tree")).otherwise(F.col("tree"))}
    ).drop("_noise", "_cut", "_facts", "_tree")


def drop_noise(pages: DataFrame, selectors: list[str] | Column) -> DataFrame:
    """Pages whose html lacks the subtrees that the noise selectors select; no selectors, no change.

    `selectors` is a list for all pages, or an array column of `pages`. Rows and other columns stay as they are.
    """
    if isinstance(selectors, list):
        if not selectors:
            return pages
        selectors = F.array(*[F.lit(x) for x in selectors])
    held = documented(with_trees(pages.withColumn("_html", F.col("html"))), keep=("tokens",))
    noisy = once(held, {"_noise": F.coalesce(noise_spans(selectors), F.array())})
    kept = F.array_join(without_spans(F.col("tokens"), F.col("_noise")), "")
    return noisy.withColumn("html", F.when(F.size("_noise") > 0, kept).otherwise(F.col("_html"))).select(*pages.columns)
