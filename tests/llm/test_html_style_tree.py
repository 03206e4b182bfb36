import pytest

from pagemine.llm import html_style_tree as tree
from tests.llm.conftest import by_row

CASES = [
    (None, ""),
    ("", ""),
    ("plain text &amp; more", "plain text & more"),
    ("<p>one<p>two", "one two"),
    ("<article><h1>H&nbsp; x</h1><p><b>bold.<br><p>next&#33;</p></article><footer>f</footer>", "H x bold. next!"),
    ("<nav>n</nav><main><p>a<b>b</b>c</p><aside>s</aside><form><p>f</form><table><tr><td>1<td>2<tr><td>3</table></main>", "abc 1 2 3"),
    ("<header>top</header><article><header><h1>T</h1></header>x</article>", "T x"),
    ("<body><div class='cookie-notice'>c</div><div id=sidebarLeft>s</div><p>keep</p><div class='comments'><article>no</article></div>", "keep"),
    ("<article>a<script>var t='</p>'</script><style>p{}</style><!-- <p>c</p> -->b</article>", "ab"),
    ("<article><p>cut off<a href='/x", "cut off"),
    ("<article>1 < 2 &lt;b&gt;</article>", "1 < 2 <b>"),
    ("<article><ul><li>a<li>b <i>c</i></ul><p hidden>h</p><p style='display:none'>d</p></article>", "a b c"),
    ("<article><script>never closed <p>x</article>", ""),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<body class='has-sidebar'><div class='with-sidebar'><p>kept</p></div><div class='mainMenu'>m</div></body>", "kept"),
    ("<article><p>gradient shadows addition navigate</p><p class='gradient shadow'>kept</p></article>", "gradient shadows addition navigate kept"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_text_of_a_page(source, text):
    assert tree.main_text(tree.parse(source), frozenset()) == text


def test_quotes_that_never_close_take_linear_time():
    tree.parse("<a href='" * 20_000)


def pages_of_a_site():
    """No element of these pages says what it is: only the site's style tree can."""
    rows = []
    for i in range(40):
        top = "<div class='x1'><a href='/'>Home</a><a href='/about'>About us</a></div>"
        body = f"<div class='x2'><p>Story {i} begins {i * 7}.</p><p>It ends with {i * 13} words.</p></div>"
        rows.append((i, f"http://www.One.example/{i}", f"<html><body>{top}{body}<div class='x3'>All rights reserved</div></body></html>"))
    rows += [(100, "http://two.example/", "<body><div class='x1'>Home</div><p>Only page of its host.</p></body>"), (101, None, "<p>no url</p>"), (None, "odd url", None)]
    return rows


def test_branches_that_all_pages_share_are_cut(spark):
    rows = pages_of_a_site()
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, cut int")
    got = {r.page_id: r for r in tree.extract_main_text(pages).collect()}
    for i in range(40):
        assert got[i].text == f"Story {i} begins {i * 7}. It ends with {i * 13} words."
    assert got[100].text == "Home Only page of its host." and got[101].text == "no url" and got[None].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_an_article_stay(spark):
    page = "<nav>n</nav><article><h1>Same</h1><p>On every page.</p></article>"
    pages = spark.createDataFrame([(i, "http://h.example/", page) for i in range(50)] + [(1, "http://h.example/", page)], "page_id long, url string, html string")
    got = tree.extract_main_text(pages).collect()
    assert len(got) == 51 and {r.text for r in got} == {"Same On every page."}


def test_entropies_of_a_branch(spark):
    rows = [("h", f"<body><div class=a>same</div><div class=b>text {i}</div></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "host string, html string")
    cut = tree.unimportant_branches(pages).collect()
    page = tree.parse(rows[0][1])
    same, text = ({*r.branches} for r in page.runs)
    assert [r.host for r in cut] == ["h"] and set(cut[0].cut) == same and not same & text


def test_empty_table(spark):
    assert tree.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_rows_are_kept(spark):
    assert by_row(tree.extract_main_text(spark.createDataFrame([(1, None, "<p>a")] * 3, "page_id long, url string, html string")).select("page_id", "text").collect()) == [(1, "a")] * 3


def test_boxes_in_articles_are_cut_and_stories_beside_teasers_stay(spark):
    box = "<div class='b'><p>Read our magazine.</p></div>"
    rows = [(i, "http://h.example/", f"<article><h1>Title {i}</h1>{box}<p>Story {i} is {i * 7} long.</p></article>") for i in range(20)]
    # copies of one article do not make its own text boilerplate
    rows += [(20 + i, "http://h.example/", f"<article><h1>Same</h1>{box}<p>This one is copied.</p></article>") for i in range(20)]
    rows += [(50 + i, "http://t.example/", f"<div class=s><p>Story {i} of {i * 9} words told at some length.</p></div><article>Teaser {i}</article>") for i in range(8)]
    got = {r.page_id: r.text for r in tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} Story {i} is {i * 7} long." for i in range(20))
    assert all(got[20 + i] == "Same This one is copied." for i in range(20))
    assert all(got[50 + i] == f"Story {i} of {i * 9} words told at some length. Teaser {i}" for i in range(8))


def test_templates_of_a_small_share_of_a_host_are_cut(spark):
    rows = [(i, "http://h.example/", f"<body><div class='sec{i % 12}'><a href='/{i % 12}'>Part {i % 12}</a></div><p>Story {i}.</p></body>") for i in range(96)]
    got = tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == 96 and all(r.text == f"Story {r.page_id}." for r in got)


NAMED_CASES = [
    ("<div class='content-sidebar-wrap'><main><p>a</p></main><aside>s</aside></div>", "a"),
    ("<div id='main-and-sidebar'><p>a</p></div>", "a"),
    ("<article class='post comments-open'>a</article>", "a"),
    ("<article class='promo'>a</article>", "a"),
    ("<section class='social-sciences'><p class='related-work'>a</p></section>", "a"),
    ("<div class='site-overlay'><div><main>a</main></div></div><div class='site-overlay'>o</div>", "a"),
    ("<div class='overlay'><main>a<div class='post-comments'>c</div></main></div>", "a"),
    ("<div class='page-toolbar'><article>a</article></div>", "a"),
    ("<div class='comments'><article>c</article></div><p>a</p>", "a"),
]


@pytest.mark.parametrize(("source", "text"), NAMED_CASES)
def test_names_take_no_content_along(source, text):
    assert tree.main_text(tree.parse(source), frozenset()) == text


def test_a_name_elsewhere_weighs_a_branch_down(spark):
    rows = [("h", f"<body><div class='{c}'>Part {i % 4}</div></body>") for i in range(28) for c in ("social-sciences", "sciences")]
    cut = {r.branch for r in tree.cut_branches(spark.createDataFrame(rows, "host string, html string")).collect()}
    named, other = ({*tree.parse(html).runs[0].branches} for _, html in rows[:2])
    assert named <= cut and not other & cut
