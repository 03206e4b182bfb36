"""HTML extraction by a site style tree.

The pages of a host are merged by their styles: a style node is a path of elements with their
classes. Its presentation importance is the entropy of the child sequences its pages show; its
content importance is one minus the mean entropy, over the pages, of the texts and links below
it. Parts that look and read alike on every page have little of both. The composite weighs the
two, and branches of little importance on enough pages of the host are cut from each page.

What an element declares itself to be weighs in: navigation, forms, adverts and the like have no
importance; what an article or main element holds has MAIN_PRIOR before entropies are asked. A
text that stands on many pages because its whole article does is no boilerplate: inside a main
element, repetition counts only beyond that of the main elements themselves.

Pages are parsed row by row. What is counted are hashes. Cut branches stay rows: a page takes
along those of its own branches that are cut, never a list of its host.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import in_filter, key_filter, staged

#: A branch is judged where at least MIN_PAGES pages of its host have it.
MIN_PAGES = 5
#: Weight of content against presentation, and the importance below which a branch is cut.
CONTENT_WEIGHT, LEAST = 0.9, 0.25
#: Importance a branch inside a main element has at least: it is cut only where next to nothing of it varies.
MAIN_PRIOR = 0.15

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object audio video canvas".split())
UNSEEN = RAW | frozenset("head nav footer aside form button dialog menu option datalist label fieldset".split())
#: Elements that do not begin a block; what a browser does not show does not part a line either.
INLINE = frozenset("script style noscript template a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
ROLES_OUT = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words that declare a part not to be content as a whole class or id name, or as its last word where no article or main element is inside.
NAMES_OUT = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices comment comments disqus reply replies respond newsletter subscribe "
    "signup login share sharing social related recommended popup modal overlay pagination pager widget toolbar skip".split()
)
#: Names that begin so speak of other parts (has-sidebar); elements whose names do not count.
ABOUT_OTHERS = frozenset("has with no without".split())
WHOLE = frozenset("html body main".split())
#: Words of place after the last word; a name that joins parts (main-and-sidebar) declares nothing.
PLACES = frozenset("left right top bottom first second last primary secondary".split())
JOINS = "and"
#: What the importance of a branch is multiplied with where such a word only stands elsewhere in its name.
NAMED = 0.6
#: Elements that an opening tag closes when they are open, nearest first.
P_ENDS = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl select div article section main body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if "=" in source or "hidden" in source else {}


def _declared(tag: str, attributes: dict[str, str], inside_main: bool) -> bool:
    """Whether an element says it is not content."""
    if tag in UNSEEN or (tag == "header" and not inside_main):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES_OUT:
        return True
    return False


def _named(tag: str, attributes: dict[str, str]) -> int:
    """What class and id names say: 3 noise, 2 noise unless an article or main element is inside, 1 perhaps noise, 0 nothing."""
    if not attributes or tag in WHOLE or tag in MAIN or attributes.get("role", "").lower() == "main":
        return 0
    most = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [word.lower() for word in _NAME_WORD.findall(name)]
        if not words or words[0] in ABOUT_OTHERS or NAMES_OUT.isdisjoint(words):
            continue
        while len(words) > 1 and words[-1] in PLACES:
            words.pop()
        most = max(most, 1 if JOINS in words or words[-1] not in NAMES_OUT else 2 if len(words) > 1 else 3)
    return most


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Node:
    tag: str
    path: int
    branches: tuple[int, ...]
    out: bool = False
    main: int = 0
    link: bool = False
    doubts: tuple[int, ...] = ()
    hint: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Run:
    """A piece of text: its block, the style paths above it, the number of its outermost main element or 0, whether it is a link's."""

    block: int
    text: str
    branches: tuple[int, ...]
    main: int
    link: bool
    doubts: tuple[int, ...]


@dataclass
class Page:
    runs: list[Run] = field(default_factory=list)
    #: style path -> the child sequences that elements of that path show, hashed
    presentations: dict[int, int] = field(default_factory=dict)
    #: (style path, hash of a text or link) -> count
    features: dict[tuple[int, int], int] = field(default_factory=dict)
    #: (style path, hash of the whole text of a main element around it) -> count
    wholes: dict[tuple[int, int], int] = field(default_factory=dict)
    #: style paths whose names hold a word of noise that does not declare them
    hinted: set[int] = field(default_factory=set)


def parse(source: str | None, statistics: bool = False) -> Page:
    """Walk a page once. Text declared not to be content is not kept; with `statistics`, styles are counted."""
    page = Page()
    if not source:
        return page
    stack = [Node("", 0, ())]
    block, at, size, mains = 0, 0, len(source), 0
    ended: list[Node] = []
    links: list[tuple[Node, str]] = []
    # elements that names declare noise are told apart only at the page's end: some hold the main element
    doubted: list[int] = []
    freed: set[int] = set()

    def leave(upto: int) -> None:
        nonlocal block
        while len(stack) > upto:
            node = stack.pop()
            if node.tag not in INLINE:
                block += 1
            if statistics and not node.out:
                ended.append(node)

    def text(piece: str) -> None:
        top = stack[-1]
        if not top.out and piece:
            page.runs.append(Run(block, piece, top.branches, top.main, top.link, top.doubts))

    while at < size:
        token = _TOKEN.search(source, at)
        if token is None:
            rest = source[at:]
            cut = rest.rfind("<")  # a tag that the page's end cuts off is no text
            if cut >= 0 and re.match(r"</?[A-Za-z!]", rest[cut:]):
                rest = rest[:cut]
            text(rest)
            break
        if token.start() > at:
            text(source[at : token.start()])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    leave(depth)
                    break
                if tag in INLINE and stack[depth].tag not in INLINE:
                    break  # a formatting end tag does not close the block around it
            else:
                if tag in ("p", "br"):
                    block += 1
            continue
        if tag in P_ENDS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    leave(depth)
                    break
                if stack[depth].tag not in INLINE:
                    break
        elif tag in SAME_ENDS:
            lowest = None
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SAME_ENDS[tag]:
                    lowest = depth
                    if tag != "tr":
                        break
                elif stack[depth].tag in SCOPES:
                    break
            if lowest is not None:
                leave(lowest)
        if tag not in INLINE:
            block += 1
        above = stack[-1]
        attributes = _attributes(token[3])
        style = f"{tag}.{' '.join(sorted(attributes.get('class', '').split()))}"
        if statistics and not above.out:
            above.children.append(style)
        if tag in VOID or token[3].endswith("/"):
            continue
        path = xxhash.xxh3_64_intdigest(style, above.path & 0xFFFFFFFF) ^ (above.path >> 1)
        main = above.main
        role = "main" if attributes.get("role", "").lower() == "main" else tag
        if not main and role in MAIN:
            mains += 1
            main = mains
        out = above.out or _declared(tag, attributes, above.main > 0)
        named = 0 if out else _named(tag, attributes)
        doubts = above.doubts
        if not out and role in MAIN:
            # a whole name stands against articles inside, as comments are articles too
            freed.update(d for d in doubts if role == "main" or doubted[d] == 2)
        if named > 1:
            doubts = (*doubts, len(doubted))
            doubted.append(named)
        node = Node(tag, path, above.branches if out or tag in ("html", "body") else (*above.branches, path - (1 << 63)), out, main, above.link or tag == "a", doubts, named == 1)
        stack.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else size
            leave(len(stack) - 1)
            continue
        if statistics and tag == "a" and not out:
            links.append((node, attributes.get("href", "")))
    leave(1)
    if doubted:
        page.runs = [run for run in page.runs if freed.issuperset(run.doubts)]
        ended = [node for node in ended if freed.issuperset(node.doubts)]
    if statistics:
        for node, href in links:
            if freed.issuperset(node.doubts):
                _count(page.features, node.branches, _hash(f"href {href}"))
        pieces: dict[int, list[str]] = {}
        for run in page.runs:
            words = " ".join(html.unescape(run.text).split())
            if words:
                _count(page.features, run.branches, _hash(words))
                pieces.setdefault(run.main, []).append(words)
        wholes = {main: _hash(" ".join(words)) for main, words in pieces.items()}
        held: dict[int, set[int]] = {}
        for node in ended:
            if node.main:
                held.setdefault(node.main, set()).update(node.branches)
            if node.hint and node.branches:
                page.hinted.add(node.branches[-1])
            if node.branches:
                page.presentations[node.branches[-1]] = _hash("|".join(node.children)) ^ page.presentations.get(node.branches[-1], 0)
        for main, branches in held.items():
            _count(page.wholes, branches, wholes.get(main, 0))
    return page


def _count(counts: dict[tuple[int, int], int], branches, value: int) -> None:
    for branch in set(branches):
        counts[branch, value] = counts.get((branch, value), 0) + 1


def main_text(page: Page, cut: frozenset[int]) -> str:
    """The page's text without cut branches: what is left in main elements, or all that is left where more stands outside them, links aside."""
    runs = [r for r in page.runs if cut.isdisjoint(r.branches)]
    inside = [r for r in runs if r.main]
    held, other = _length(inside), _length(r for r in runs if not r.main and not r.link)
    if held and held >= other:
        runs = inside
    blocks: dict[int, list[str]] = {}
    for run in runs:
        blocks.setdefault(run.block, []).append(run.text)
    return " ".join(word for parts in blocks.values() for word in html.unescape("".join(parts)).split())


def _length(runs) -> int:
    return sum(len(word) for run in runs for word in run.text.split())


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def cut_branches(pages: DataFrame, min_pages: int = MIN_PAGES, content_weight: float = CONTENT_WEIGHT, least: float = LEAST) -> DataFrame:
    """(host, branch): the style branches of pages(host, html) that their host's style tree finds unimportant."""

    def styles(batches):
        for batch in batches:
            hosts, branches, kinds, values, counts = [], [], [], [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = parse(source, statistics=True)
                rows = [(b, 0, v, 1) for b, v in page.presentations.items()] + [(b, 1, v, n) for (b, v), n in page.features.items()]
                rows += [(b, 2, v, n) for (b, v), n in page.wholes.items()] + [(b, 3, 0, 1) for b in page.hinted]
                for branch, kind, value, n in rows:
                    hosts.append(host)
                    branches.append(branch)
                    kinds.append(kind)
                    values.append(value)
                    counts.append(n)
            columns = [pa.array(hosts, pa.string()), pa.array(branches, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "branch", "kind", "value", "n"])

    found = pages.select("host", "html").mapInArrow(styles, "host string, branch long, kind int, value long, n long")
    # a row is one page's count of one value; sum(n) and sum(n log n) give its entropy over pages
    values = found.groupBy("host", "branch", "kind", "value").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.count("*").alias("pages")
    )
    spread = F.log("total") - F.col("n_log_n") / F.col("total")
    tree = values.groupBy("host", "branch").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("total"))).alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("total") * F.log("total"))).alias("styles"),
        F.avg(F.when(F.col("kind") == 1, spread)).alias("spread"),
        F.sum(F.when(F.col("kind") == 2, F.col("total"))).alias("mains"),
        F.sum(F.when(F.col("kind") == 2, F.col("total") * F.log("total"))).alias("copies"),
        F.max(F.col("kind") == 3).alias("hinted"),
    )
    m = F.col("m")
    # inside main elements, what counts is how many different ones there are, and repetition beyond theirs
    inside = F.col("mains").isNotNull()
    repeats = F.when(inside, F.col("copies") / F.col("mains")).otherwise(0.0)
    most = F.when(inside, F.log("mains") - repeats).otherwise(F.log(m))
    presentation = F.least(F.lit(1.0), (F.log(m) - F.col("styles") / m) / most)
    content = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("spread", F.lit(0.0)) - repeats) / most)
    raw = F.when(most > 0, F.lit(1 - content_weight) * presentation + F.lit(content_weight) * content).otherwise(1.0)
    raw = F.when(F.col("hinted"), F.lit(NAMED)).otherwise(1.0) * raw
    importance = F.when(inside, F.lit(MAIN_PRIOR) + F.lit(1 - MAIN_PRIOR) * raw).otherwise(raw)
    # a hair below, as logarithms round
    different = F.exp(most) > F.lit(min_pages - 1e-6)
    return tree.where(different & (m >= min_pages) & (importance < least)).select("host", "branch")


def unimportant_branches(pages: DataFrame, **options) -> DataFrame:
    """(host, cut): the cut branches gathered by host, for hosts looked at one by one."""
    return cut_branches(pages, **options).groupBy("host").agg(F.collect_set("branch").alias("cut"))


def _cuts_of_pages(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(host, k1, k2, cut): per distinct page of rows(host, k1, k2, html) with cut branches, those it has.

    The filter only spares rows: what passes it is joined with the cuts.
    """
    cuts = cuts.withColumn("key", F.xxhash64("host", "branch"))
    table = rows.sparkSession.sparkContext.broadcast(key_filter(cuts))

    def branches(batches):
        for batch in batches:
            at, found = [], []
            for row, source in enumerate(batch.column("html").to_pylist()):
                for branch in {b for run in parse(source).runs for b in run.branches}:
                    at.append(row)
                    found.append(branch)
            taken = pa.array(at, pa.int64())
            columns = [batch.column(name).take(taken) for name in ("host", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())], names=["host", "k1", "k2", "branch"])

    def passing(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            yield batch.filter(pa.array([in_filter(table.value, key) for key in keys], pa.bool_()))

    schema = "host string, k1 long, k2 long, branch long"
    own = rows.select("host", "k1", "k2", "html").mapInArrow(branches, schema).withColumn("key", F.xxhash64("host", "branch"))
    own = own.mapInArrow(passing, f"{schema}, key long").drop("key").distinct()
    return own.join(cuts.select("host", "branch"), ["host", "branch"], "left_semi").groupBy("host", "k1", "k2").agg(F.collect_set("branch").alias("cut"))


def extract_main_text(pages: DataFrame, **options) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars (code points).

    text is the main text of the whole page: blocks in page order, white space inside a block
    made one space, trimmed, joined by one space, character references decoded. Null and empty
    html, and pages without such text, give an empty text. Where a page has article or main
    elements, text outside them counts only where it is more than they hold, links aside. Null and odd urls share the host ''.
    Null ids and repeated rows are kept; other columns are ignored; an empty table gives an
    empty result. A branch found on fewer than min_pages pages is never cut by statistics.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    # a page's cuts follow from host and html: copies share them
    rows = rows.withColumn("k1", F.xxhash64("html")).withColumn("k2", F.xxhash64(F.lit("k2"), "html"))
    cut = staged(_cuts_of_pages(rows, staged(cut_branches(rows, **options), "styles")), "cuts")

    def texts(batches):
        for batch in batches:
            found = []
            for source, branches in zip(batch.column("html").to_pylist(), batch.column("cut").to_pylist(), strict=True):
                found.append(main_text(parse(source), frozenset(branches or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(cut, ["host", "k1", "k2"], "left").select("page_id", "url", "html", "cut")
    out = joined.mapInArrow(texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
