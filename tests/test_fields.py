import pytest
from pyspark.sql import functions as F

from pagemine.functions.dates import normalize_date
from pagemine.functions.text import words
from pagemine.operators import docs as C
from pagemine.operators import fields as X
from pagemine.operators import selectors as S
from pagemine.operators import titles as T
from pagemine.sources import rules as R
from pagemine.sources.schemas import FIELDS


@pytest.mark.parametrize("field, text, value", [
    ("author", "作者：张三 ，", "作者：张三"), ("source", "来源：新华网\n", "新华网"), ("editor", "责编 李四(", "责编 李四"), ("author", "没有", None),
])
def test_pattern_fields(spark, field, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert X.with_first_match(df, "t", R.DEFAULT_PATTERNS[field], "m").select(F.trim("m.found")).first()[0] == value


def test_dates(spark):
    cases = [
        ("2018-01-01 12:01:01", "2018-01-01 12:01:01"), ("2018-01-01 12:01", "2018-01-01 12:01:00"),
        ("2018-01-0112:01", "2018-01-01 12:01:00"), ("2018年1月2日 08:30", "2018-01-02 08:30:00"),
        ("2018/1/2", "2018-01-02 00:00:00"), ("2018-1-2 9:05", "2018-01-02 00:00:00"), ("2018.01.02", ""), ("1月2日", ""),
        ("2018-02-30", ""),
    ]
    df = spark.createDataFrame(cases, "t string, want string")
    for row in X.with_publish_date(df, "t", R.DATE_PATTERNS).collect():
        assert row.publish_match is not None and row.publish_value == row.want, row


def test_date_layouts(spark):
    assert len(R.DATE_PATTERNS) == 30 and len(set(R.DATE_PATTERNS)) == 30
    df = spark.createDataFrame([("20180101",), ("x",)], "t string")
    assert [r[0] for r in df.select(normalize_date(F.col("t"))).collect()] == ["2018-01-01 00:00:00", None]


def test_default_rules(spark):
    counts = {r.field: r["count"] for r in R.default_rules(spark).groupBy("field").count().collect()}
    assert counts == {"channel": 1, "title": 1, "author": 4, "editor": 4, "source": 1, "video_url": 1, "publish_date": 30, "noise_node": 1}
    assert len(FIELDS) == 12


def test_words_of_mixed_text(spark):
    df = spark.createDataFrame([("Ab ab x 各民族 共 c3",)], "t string")
    assert sorted(df.select(words(F.col("t"))).first()[0]) == ["ab", "ab", "c3", "各民", "民族"]


def test_similarity_order(spark):
    title = "各民族共建美好家园共创美好未来--观点--人民网 "
    others = [title, "各民族共建美好家园共创美好未来", "在全国民族团结进步表彰大会上，全面分析当前我国民族工作面临的形势", ""]
    df = spark.createDataFrame([(i, title, o) for i, o in enumerate(others)], "i int, a string, b string")
    score = [r.score for r in T.cosine_scores(df, "a", "b").orderBy("i").collect()]
    assert score[0] == pytest.approx(1) and 1 > score[1] > score[2] > score[3] == 0
    blank = spark.createDataFrame([("", "")], "a string, b string")
    assert T.cosine_scores(blank, "a", "b").first().score == -1


def test_guessed_selectors_select_their_node(spark, make_pages):
    html = ('<html><body><div id="m"><ul class="x"><li>a</li><li>b <i>c</i></li></ul><p>d</p><p>e</p></div>'
            '<section><section><p>f</p></section></section></body></html>')
    docs = C.page_docs(make_pages([html]))
    made = F.transform("nodes", lambda n: F.struct(n["seq"].alias("seq"), n["tag"].alias("tag"), S.guess_selector(n).alias("xpath"),
                                                   F.transform(S.selected(S.guess_selector(n)), lambda m: m["seq"]).alias("found")))
    rows = docs.select(F.inline(made)).collect()
    by_xpath = {r.xpath: r for r in rows if r.tag != "i"}
    assert set(by_xpath) >= {'//div[@id="m"]/ul[@class="x"]/li[2]', '//div[@id="m"]/p[2]', "//section/section/p", "//body"}
    assert next(r.xpath for r in rows if r.tag == "i") == '//div[@id="m"]/ul[@class="x"]/li[2]'
    assert all(r.seq in r.found for r in by_xpath.values())


def test_selectors_outside_the_grammar_are_refused(spark, make_pages):
    docs = C.page_docs(make_pages(["<p>x</p>"]))
    with pytest.raises(Exception, match="outside the grammar"):
        S.eval_selectors(docs, [("x", "//p[contains(., 'x')]")]).collect()


def test_retraining_falls_back_to_the_defaults(spark):
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    own = spark.createDataFrame([("a", "title", "selector", 0, "//h1")], "site string, field string, kind string, priority int, expr string")
    counts = lambda df: {r.site: r["count"] for r in df.groupBy("site").count().collect()}
    assert counts(R.resolve_config(sites, own)) == {"a": 1, "b": len(R.DEFAULT_ROWS)}
    assert counts(R.resolve_config(sites, own, retraining=True)) == {"a": len(R.DEFAULT_ROWS), "b": len(R.DEFAULT_ROWS)}
