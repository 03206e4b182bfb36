"""The tree of a page, built by a stack inside the page's row.

The input is one short fact per token (kind, tag, whether it is useless, counts of its text), never
the HTML itself; the output is the node, text and point arrays of the page. So a page keeps its
row: nothing is shuffled, pages with equal ids stay apart, and a page costs time in its tokens.
A batch of pages is worked off in runs, and each run is handed back before the next is unpacked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa

OPEN, LEAF, TEXT, CLOSE = 1, 2, 3, 4

#: Tokens that a worker holds as Python objects at a time, or one page where it has more.
RUN_TOKENS = 1 << 15

# Elements that end an open paragraph or an open inline element.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
# Which start tags end an element that has no end tag of its own.
IMPLIED_ENDS = {
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"], "head": ["body"],
    "td": ["td", "th", "tr", "tbody", "tfoot"], "th": ["td", "th", "tr", "tbody", "tfoot"],
    "tr": ["tr", "tbody", "tfoot"], "thead": ["tbody", "tfoot"], "tbody": ["tbody", "tfoot"],
}
# Elements dropped when they have neither children nor text.
DROPPED_WHEN_EMPTY = ["section", "h1", "h2", "h3", "h4", "h5", "h6", "span"]
# Elements that are dropped but still looked up by other operators.
REMEMBERED_TAGS = ["video", "script"]

RAW = [
    ("seq", pa.int32()), ("end_seq", pa.int32()), ("tag", pa.string()), ("depth", pa.int64()), ("parent_seq", pa.int32()),
    ("new_tag", pa.string()), ("useless", pa.bool_()), ("empty", pa.bool_()), ("dissolved", pa.bool_()),
]
NODE = [
    ("seq", pa.int32()), ("end_seq", pa.int32()), ("depth", pa.int64()), ("parent_seq", pa.int32()), ("tag", pa.string()), ("in_body", pa.bool_()),
    ("ti", pa.int64()), ("lti", pa.int64()), ("tgi", pa.int64()), ("ltgi", pa.int64()), ("p_count", pa.int64()), ("marks", pa.int64()),
    ("text_at", pa.int64()), ("text_count", pa.int64()), ("nth", pa.int32()),
]
PIECE = [("seq", pa.int32()), ("parent_seq", pa.int32()), ("depth", pa.int64()), ("in_body", pa.bool_()), ("text_at", pa.int64()), ("first", pa.bool_())]
POINT = [("seq", pa.int32()), ("parent_seq", pa.int32()), ("depth", pa.int64()), ("in_body", pa.bool_()), ("text_at", pa.int64()), ("tag", pa.string())]

_BLOCKS = set(BLOCK_TAGS)
_OUTER = _BLOCKS | {"html", "head", "title"}
_ENDS = {tag: tuple(by) for tag, by in IMPLIED_ENDS.items()}
_ENDED_BY: dict[str, list[tuple[str, ...]]] = {}
for _by in sorted(set(_ENDS.values())):
    for _tag in _by:
        _ENDED_BY.setdefault(_tag, []).append(_by)


def element_ends(kinds: list[int | None], tags: list[str]) -> list[int | None]:
    """Where the element that each token starts ends, in positions of two per token; None for other tokens.

    An end tag closes the open element of its name and nesting level, and stray ones close nothing.
    An element without end tag ends with the element around it, or earlier where HTML implies its end
    (a paragraph at the next block, a list item at the next).
    """
    ends: list[int | None] = [None] * len(kinds)
    around: list[int | None] = [None] * len(kinds)
    level: dict[str, int] = {}
    last: dict[tuple[str, int], int] = {}
    paired = set()
    for i, kind in enumerate(kinds):
        tag = tags[i]
        if tag:
            at = level.get(tag, 0) + (kind == OPEN)
            level[tag] = at - (kind == CLOSE)
            before = last.get((tag, at))
            if kind == CLOSE and before is not None and kinds[before] == OPEN:
                ends[before] = 2 * i
                paired.add(i)
            last[tag, at] = i
    depth = 0
    for i, kind in enumerate(kinds):
        if kind is not None and (kind != CLOSE or i in paired):
            around[i] = depth
            depth += (kind == OPEN and ends[i] is not None) - (kind == CLOSE)
    # what comes next at a depth, seen from the end of the page
    close: dict[int, int] = {}
    starts: dict[object, int] = {}
    for i in range(len(kinds) - 1, -1, -1):
        kind, tag, at = kinds[i], tags[i], around[i]
        if at is None or kind == TEXT:
            continue
        if kind == CLOSE:
            close[at] = 2 * i
            continue
        if kind == LEAF:
            ends[i] = 2 * i + 1
        elif ends[i] is None:
            limit = close.get(at, 2 * len(kinds))
            if tag in _ENDS:
                limit = min(limit, starts.get((at, _ENDS[tag]), limit))
            elif tag == "p" or tag not in _OUTER:
                limit = min(limit, starts.get(at, limit))
            ends[i] = limit
        if tag in _BLOCKS:
            starts[at] = 2 * i
        for by in _ENDED_BY.get(tag, ()):
            starts[at, by] = 2 * i
    return ends


def raw_tree(kinds: list[int | None], tags: list[str], useless: list[bool]) -> tuple[list[list], list[int], list[int]]:
    """The tree before any clean-up: nodes (as RAW, with the useless counted around each), texts and their useless counts.

    Opens and ends are paired by depth, so that intervals nest, also for crossing tags.
    """
    ends = element_ends(kinds, tags)
    stops: dict[int, int] = {}
    for end in ends:
        if end is not None:
            stops[end] = stops.get(end, 0) + 1
    nodes, texts, shut_texts, stack = [], [], [], []
    elements = contents = shut = in_p = 0

    def pop(at: int) -> None:
        nonlocal shut, in_p
        for _ in range(stops.get(at, 0)):
            node, own_elements, own_contents, bad = stack.pop()
            node[1] = at
            bare = elements == own_elements
            node[5] = "p" if bare and node[2] in ("div", "span") else node[2]
            node[7] = contents == own_contents and node[2] in DROPPED_WHEN_EMPTY
            shut -= bad
            in_p -= node[2] == "p"

    for i, kind in enumerate(kinds):
        pop(2 * i)
        if kind == TEXT:
            contents += 1
            texts.append(2 * i)
            shut_texts.append(shut)
        elif ends[i] is not None:
            tag, bad = tags[i], bool(useless[i])
            elements += 1
            contents += 1
            shut += bad
            in_p += tag == "p"
            parent = stack[-1][0][0] if stack else -1
            node = [2 * i, None, tag, len(stack) + 1, parent, tag, shut, False, tag in ("span", "strong") and in_p > 0]
            nodes.append(node)
            stack.append((node, elements, contents, bad))
        pop(2 * i + 1)
    pop(2 * len(kinds))
    return nodes, texts, shut_texts


def clean_tree(kinds, tags, useless, chars, marks) -> tuple[list[tuple], list[tuple], list[tuple], tuple]:
    """The cleaned tree: nodes with their measures (NODE), texts (PIECE), points (POINT), and (has_body, deviation).

    Useless subtrees, empty headings and inline elements inside paragraphs are left out; videos and
    scripts stay as points. Sums over what lies inside a node are differences of running sums.
    """
    raw, places, shut_places = raw_tree(kinds, tags, useless)
    events = []
    for seq, end, tag, _, _, new_tag, shut, empty, dissolved in raw:
        if not shut and not empty and not dissolved:
            events.append((seq, new_tag, end))
        elif tag == "video" or (tag in REMEMBERED_TAGS and shut == 1):
            events.append((seq, new_tag, None))
    events += [(seq, None, None) for seq, shut in zip(places, shut_places, strict=True) if not shut]
    events.sort(key=lambda event: event[0])
    nodes, texts, points, stack, ordinals, spoken = [], [], [], [], {}, set()
    n_texts = n_filled = n_chars = link_chars = n_marks = n_nodes = n_links = n_paragraphs = in_link = in_body = 0

    def pop(at) -> None:
        nonlocal in_link, in_body
        while stack and (at is None or stack[-1][1] <= at):
            node, end, tag, linked, before = stack.pop()
            inner = [now - then for now, then in zip((n_texts, n_filled, n_chars, link_chars, n_marks, n_nodes, n_links, n_paragraphs), before)]
            node[6:14] = [inner[2] + max(inner[1] - 1, 0), 0 if linked else inner[3], inner[5], inner[6], inner[7], inner[4], before[0], inner[0]]
            in_link -= tag == "a"
            in_body -= tag == "body"

    for seq, tag, end in events:
        pop(seq)
        parent, depth = stack[-1][0][0] if stack else -1, len(stack) + 1
        if end is not None:
            n_nodes += 1
            n_links += tag == "a"
            n_paragraphs += tag == "p"
            in_link += tag == "a"
            in_body += tag == "body"
            nth = ordinals[parent, tag] = ordinals.get((parent, tag), 0) + 1
            node = [seq, end, depth, parent, tag, in_body > 0, *[0] * 8, nth]
            nodes.append(node)
            stack.append((node, end, tag, in_link > 0, (n_texts, n_filled, n_chars, link_chars, n_marks, n_nodes, n_links, n_paragraphs)))
        elif tag is not None:
            points.append((seq, parent, depth, in_body > 0, n_texts, tag))
        else:
            size = chars[seq // 2] or 0
            n_texts += 1
            n_filled += size > 0
            n_chars += size
            link_chars += size if in_link else 0
            n_marks += marks[seq // 2] or 0
            texts.append((seq, parent, depth, in_body > 0, n_texts, parent not in spoken))
            spoken.add(parent)
    pop(None)
    has_body = any(node[5] for node in nodes) if nodes else None
    density = [0.0 if n[8] == n[9] else (n[6] - n[7]) / (n[8] - n[9]) for n in nodes if n[5] or not has_body]
    return nodes, texts, points, (has_body, _deviation(density))


def _deviation(values: list[float]) -> float | None:
    """Sample standard deviation, updated value by value; null for fewer than two."""
    mean = spread = 0.0
    for n, value in enumerate(values, 1):
        delta = value - mean
        mean += delta / n
        spread += delta * (delta - delta / n)
    return math.sqrt(spread / (len(values) - 1)) if len(values) > 1 else None


def _listed(pages: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Rows per page as an array of lists of structs; None stays null."""
    offsets, flat = [0], []
    for rows in pages:
        flat += rows or ()
        offsets.append(len(flat))
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])
    empty = pa.array([rows is None for rows in pages], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=empty)


def _runs(facts: pa.Array) -> Iterator[pa.Array]:
    """The pages of a batch in order, in runs of at most RUN_TOKENS tokens; a page is never cut."""
    start = held = 0
    for at, size in enumerate(facts.value_lengths().to_pylist()):
        size = size or 0
        if at > start and held + size > RUN_TOKENS:
            yield facts.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(facts):
        yield facts.slice(start)


def _over_runs(batches: Iterator[pa.Array], work: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    """`work` of every run of every batch. No run or batch is held longer than it is worked on."""
    return map(work, chain.from_iterable(map(_runs, batches)))


def _over_pages(facts: pa.Array, work: Callable[..., object]) -> list:
    """`work(kinds, tags, useless, chars, marks)` of every page of a run; null facts give None."""
    flat = facts.flatten()
    columns = [flat.field(name).to_pylist() for name in ("kind", "tag", "useless", "chars", "marks")]
    out, at = [], 0
    sizes = facts.value_lengths().to_pylist()
    for size in sizes:
        if size is None:
            out.append(None)
            continue
        out.append(work(*[column[at : at + size] for column in columns]))
        at += size
    return out


def raw_trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Per page the nodes of its raw tree, as RAW; `useless` says whether a node lies in a useless subtree or is one."""

    def work(kinds, tags, useless, chars, marks):
        return [(*node[:6], node[6] > 0, *node[7:]) for node in raw_tree(kinds, tags, useless)[0]]

    return _over_runs(batches, lambda facts: _listed(_over_pages(facts, work), RAW))


def clean_trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Per page a struct (nodes, texts, points, has_body, deviation) of its cleaned tree."""
    return _over_runs(batches, _clean_run)


def _clean_run(facts: pa.Array) -> pa.Array:
    trees = _over_pages(facts, clean_tree)
    parts = [[None if tree is None else tree[at] for tree in trees] for at in range(3)]
    facts = [(None, None) if tree is None else tree[3] for tree in trees]
    lists = [_listed(part, fields) for part, fields in zip(parts, (NODE, PIECE, POINT), strict=True)]
    flags = [pa.array([f[0] for f in facts], pa.bool_()), pa.array([f[1] for f in facts], pa.float64())]
    return pa.StructArray.from_arrays([*lists, *flags], names=["nodes", "texts", "points", "has_body", "deviation"])


def spark_type(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean"}
    return "array<struct<" + ",".join(f"{name}:{names[kind]}" for name, kind in fields) + ">>"


RAW_TREE = spark_type(RAW)
CLEAN_TREE = f"struct<nodes:{spark_type(NODE)},texts:{spark_type(PIECE)},points:{spark_type(POINT)},has_body:boolean,deviation:double>"
