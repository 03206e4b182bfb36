import math
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemine.functions.text import decode_entities
from pagemine.operators import density as N
from pagemine.operators import dom as D
from pagemine.operators import tree
from pagemine.operators.docs import page_docs
from pagemine.operators.records import extract_records

CASES = {
    "article": '<body><nav><a href="/a">n</a></nav><div class="art"><h1>T</h1><p>long, text.</p><p>more, text.</p></div></body>',
    "implied": "<p><b>x<br><p>y",
    "script": '<script>var t="</p>";</script><p>z</p>',
    "truncated": '<p>q</p><a href="/x',
    "useless": '<div class="share-box">s</div>tail',
    "empty": "<h2></h2><span></span><h3> </h3>",
    "retag": "<div>only text</div>",
    "list": "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e</p>",
    "table": "<table><tr><td>1<td>2<tr><td>3</table><p>x",
    "crossing": "<div><section>a</div>b</section><p>c</p>",
    "stray": "</div><div>a</div></p><p>b</p>",
    "inline": "<p>one <strong>two</strong> <span>three</span></p><span>four</span>",
    "comment": "a<!-- <p>x</p>\n more -->b<p>c</p>",
    "nothing": "",
    "less": "<p>a < b</p>",
}
NAMES = list(CASES)


@pytest.fixture(scope="module")
def raw(make_pages):
    rows = D.html_nodes(make_pages(CASES.values())).collect()
    return {name: sorted((r for r in rows if r.page_id == at), key=lambda r: r.seq) for at, name in enumerate(NAMES)}


@pytest.fixture(scope="module")
def clean(make_pages):
    rows = N.measured_tree(make_pages(CASES.values())).collect()
    return {name: sorted((r for r in rows if r.page_id == at), key=lambda r: r.seq) for at, name in enumerate(NAMES)}


def tags(rows):
    return [r.tag for r in rows if getattr(r, "kind", "node") == "node"]


def test_intervals_nest(raw):
    for rows in raw.values():
        for a in rows:
            assert a.end_seq > a.seq
            inner = [b for b in rows if a.seq < b.seq < a.end_seq]
            assert all(b.end_seq <= a.end_seq for b in inner)
            for b in inner:
                owners = [c.seq for c in rows if c.seq < b.seq < c.end_seq]
                assert b.parent_seq == max(owners) and b.depth == len(owners) + 1


def test_implied_ends(raw):
    first, bold, second = raw["implied"]
    assert [first.tag, bold.tag, second.tag] == ["p", "b", "p"]
    assert bold.parent_seq == first.seq and second.parent_seq == -1 and first.end_seq == bold.end_seq == second.seq
    outer, *items = raw["list"]
    assert [i.parent_seq == outer.seq for i in items if i.tag == "li"] == [True, False, False, True]
    assert [r.depth for r in raw["table"]] == [1, 2, 3, 3, 2, 3, 1]


def test_traps(raw, clean):
    assert tags(raw["script"]) == ["script", "p"] and tags(clean["script"]) == ["p"]
    assert tags(raw["truncated"]) == ["p"]
    assert tags(raw["comment"]) == ["p"]
    assert tags(raw["stray"]) == ["div", "p"]
    assert raw["nothing"] == []


def test_clean_up(clean):
    assert tags(clean["useless"]) == [] and [r.kind for r in clean["useless"]] == ["text"]
    assert tags(clean["empty"]) == ["h3"]
    assert tags(clean["retag"]) == ["p"]
    assert tags(clean["inline"]) == ["p", "p"]


def test_measures(clean):
    div = next(r for r in clean["article"] if r.tag == "div")
    assert (div.ti, div.lti, div.tgi, div.ltgi, div.p_count, div.marks) == (25, 0, 3, 0, 2, 4)
    body = next(r for r in clean["article"] if r.tag == "body")
    assert (body.ti, body.lti, body.tgi, body.ltgi) == (27, 1, 6, 1)
    assert all(r.ti >= r.lti for rows in clean.values() for r in rows if r.kind == "node")
    assert next(r for r in clean["less"] if r.tag == "p").ti == len("a\n<\nb")


def test_content_node_of_the_article(make_pages):
    rows = N.score_top_k(make_pages([CASES["article"]])).orderBy("rank").collect()
    assert rows[0].tag == "div"
    density = {r.seq: r.density for r in rows}
    mean = sum(density.values()) / len(density)
    spread = math.sqrt(sum((d - mean) ** 2 for d in density.values()) / (len(density) - 1))
    div = rows[0]
    assert div.score == pytest.approx(math.log(spread) * 25 / 3 * math.log10(4) * math.log(5))


def test_scores_that_are_undefined_come_last(make_pages):
    rows = N.score_top_k(make_pages(["<body>x</body>"])).collect()
    assert [(r.tag, r.score, r["rank"]) for r in rows] == [("body", None, 1)]


def test_entities(spark):
    df = spark.createDataFrame([("&amp;lt; &lt;b&gt; &#20013;&#x6587; &#0; &#xZ; &copy;&nbsp;x & y",)], "t string")
    assert df.select(decode_entities(F.col("t"))).first()[0] == "&lt; <b> 中文 &#0; &#xZ; ©\u00a0x & y"


def test_nothing_is_shuffled(spark, make_pages, tmp_path, monkeypatch):
    make_pages([CASES["article"]] * 8).coalesce(1).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    # a small input is dealt to all cores, once
    assert page_docs(pages)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange RoundRobin") == 1
    monkeypatch.setattr(D, "FEW_PARTITIONS", 0)
    for df in (page_docs(pages), extract_records(pages), N.score_top_k(pages), D.html_nodes(pages)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_crossing_and_dropped_elements_keep_whole_intervals(make_pages):
    rng = random.Random(11)
    names = ["div", "p", "span", "strong", "li", "td", "a", "script", "h1", "section", "b", "video", "body", "option", "header"]

    def html():
        parts = []
        for _ in range(rng.randint(1, 40)):
            tag, draw = rng.choice(names), rng.random()
            parts.append(f"<{tag}>" if draw < 0.4 else f"</{tag}>" if draw < 0.7 else rng.choice(["text, here", " ", "<", "<!-- c -->", '<div class="share">']))
        return "".join(parts)

    for row in N.measured_tree(make_pages([html() for _ in range(200)])).where("kind = 'node'").collect():
        assert row.depth >= 1 and row.end_seq > row.seq and row.ti >= row.lti >= 0 and row.tgi >= row.ltgi


def test_a_page_of_many_nodes_takes_linear_time():
    kinds, tags = [], []
    for _ in range(20_000):
        kinds += [tree.OPEN, tree.TEXT, tree.CLOSE]
        tags += ["p", "", "p"]
    began = time.process_time()
    nodes, texts, _, _ = tree.clean_tree(kinds, tags, [False] * len(kinds), [3] * len(kinds), [0] * len(kinds))
    assert len(nodes) == len(texts) == 20_000 and nodes[-1][-1] == 20_000 and time.process_time() - began < 5


FACTS = pa.list_(pa.struct([("kind", pa.int32()), ("tag", pa.string()), ("useless", pa.bool_()), ("chars", pa.int32()), ("marks", pa.int32())]))
PARAGRAPH = [(kind, tag, False, 3, 1) for kind, tag in ((tree.OPEN, "p"), (tree.TEXT, ""), (tree.CLOSE, "p"))]


def facts_of(pages):
    names = [field.name for field in FACTS.value_type]
    return pa.array([page if page is None else [dict(zip(names, fact)) for fact in page] for page in pages], FACTS)


@pytest.mark.parametrize("build", [tree.clean_trees, tree.raw_trees])
def test_batches_are_worked_off_in_runs(monkeypatch, build):
    monkeypatch.setattr(tree, "RUN_TOKENS", 30)
    pages = [None, [], PARAGRAPH * 2, PARAGRAPH * 10, PARAGRAPH * 4, None, PARAGRAPH * 40, [], PARAGRAPH, PARAGRAPH * 9, PARAGRAPH * 8]
    batches = [facts_of(pages[:7]), facts_of([]), facts_of(pages)[7:]]
    done = list(build(iter(batches)))
    assert [len(run) for run in done] == [3, 1, 2, 1, 3, 1]
    alone = [build(iter([facts_of([page])])) for page in pages]
    assert [row for run in done for row in run.to_pylist()] == [row for one in alone for run in one for row in run.to_pylist()]
    assert [len(run) for run in build(iter([facts_of([None] * 3)]))] == [3]


def test_python_objects_do_not_grow_with_the_batch(monkeypatch):
    monkeypatch.setattr(tree, "RUN_TOKENS", 3_000)

    def peak(n_pages):
        batch = facts_of([PARAGRAPH * 50] * n_pages)
        tracemalloc.start()
        rows = sum(map(len, tree.clean_trees(iter([batch]))))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n_pages
        return most

    assert peak(400) < 1.5 * peak(40)
