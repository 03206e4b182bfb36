import re

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from pagemine.operators import mining as M
from pagemine.sources import files

SEED = [
    "http://www.bjmy.gov.cn/col/col129/index.html", "http://www.bjmy.gov.cn/col/col3334/index.html",
    "http://www.bjmy.gov.cn/art/2020/1/2/art_2052_6.html", "http://www.bjmy.gov.cn/art/2020/1/2/art_2055_17.html",
]


def rules(spark, urls, **options):
    df = spark.createDataFrame([("s", u) for u in urls], "site string, url string")
    return {r.regex: (r.n_nodes, r.n_kinds, r.support) for r in M.mine_url_rules(df, **options).collect()}


def test_seed_case(spark):
    assert rules(spark, SEED) == {
        r".*/col/col\d+/index\.html": (3, 1, 2),
        r".*/art/2020/1/2/art_205[_\d]+\.html": (5, 2, 2),
    }


def test_equal_lengths_keep_every_url(spark):
    assert rules(spark, ["http://h/a/1", "http://h/a/2"]) == {r".*/a/\d+": (2, 0, 2)}


def test_single_and_root_urls(spark):
    assert list(rules(spark, ["http://h/a.b/c(1)"])) == [r".*/a\.b/c\(1\)"]
    assert rules(spark, ["http://h/"]) == {".*/.*": (1, 0, 1)}


@pytest.mark.parametrize("pair", [
    ("http://h/x-1/y", "http://h/x%2-/y"), ("http://h/a#b/y", "http://h/a(c/y"), ("http://h/col/y", "http://h/col3/y"),
    ("http://h/abc-page.html/y", "http://h/bcd-page.html/y"), ("http://h/né1", "http://h/nab"), ("http://h/a?p=1", "http://h/b?p=1"),
    ("http://h/[1]", "http://h/[a^]"), ("http://h/aa", "http://h/aaa"),
])
def test_a_rule_matches_its_own_urls(spark, pair):
    for rule in rules(spark, pair, drop_outliers=False):
        for url in pair:
            assert re.search(rule.replace(r"\x{80}-\x{10FFFF}", "\\x80-\U0010ffff"), url), (rule, url)


def test_every_page_url_matches_a_rule_of_its_site(spark):
    urls = I.site_urls(spark, "/root/testdata/sf0.001")
    mined = M.mine_url_rules(urls, nums=100, drop_outliers=False)
    hit = urls.join(mined.select("site", "regex"), "site").where(F.regexp_like("url", F.col("regex")))
    assert hit.select("url").distinct().count() == urls.select("url").distinct().count()


def test_outliers_are_cut_before_the_rules(spark):
    urls = [f"http://h/a/{i:03d}" for i in range(30)] + ["http://h/a/" + "9" * 80]
    assert rules(spark, urls) == {r".*/a/0\d+": (2, 0, 30)}


def test_link_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,link\n" + "".join(f"1,{u}\n2,{u}\n" for u in SEED))
    (tmp_path / "l.txt").write_text("\n  " + "\n\n".join(SEED) + "\n")
    assert files.read_link_csv(spark, str(tmp_path / "l.csv")).count() == 4
    assert {r.regex for r in files.mine_link_csv(spark, str(tmp_path / "l.csv")).collect()} == {
        r".*/col/col\d+/index\.html", r".*/art/2020/1/2/art_205[_\d]+\.html"}
    assert {r.regex.split("/col")[0] for r in files.mine_link_lines(spark, str(tmp_path / "l.txt")).where("n_nodes = 3").collect()} == {
        "http://www.bjmy.gov.cn"}


def test_sites_without_rules_get_an_empty_one(spark):
    df = spark.createDataFrame([("s", SEED[0])], "site string, url string")
    sites = spark.createDataFrame([("s",), ("t",)], "site string")
    best = {r.site: r.article_regex for r in M.best_site_rule(sites, M.mine_url_rules(df)).collect()}
    assert best["t"] == "" and best["s"].startswith(".*/col")
