import re
from collections import Counter

from pagemine.llm import line_dedup
from tests.llm.conftest import by_row

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))


def brute(texts, min_docs):
    lines = [(t or "").split("\n") for t in texts]
    counts = Counter(k for ls in lines for k in {key(line) for line in ls} if k)
    out = []
    for ls in lines:
        kept = [line for line in ls if counts[key(line)] < min_docs]
        out.append(("\n".join(kept), len(ls), len(ls) - len(kept)))
    return out


def test_lines_of_many_documents_go(odd_docs, odd_table):
    got = line_dedup.dedup_lines(odd_table, min_docs=10)
    assert got.columns == ["doc_id", "source", "key", "n", "size", "text", "n_lines", "n_dropped"]
    want = [(i, s, *row) for (i, _, s), row in zip(odd_docs, brute([t for _, t, _ in odd_docs], 10), strict=True)]
    assert by_row(got.select("doc_id", "source", "text", "n_lines", "n_dropped").collect()) == by_row(want)
    assert sum(row[-1] for row in want) >= 14


def test_a_line_counts_once_per_document_and_at_the_threshold(spark):
    rows = [(1, "a\na\na"), (2, " A "), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(line_dedup.dedup_lines(docs, min_docs=2).collect()) == [(1, "", 3, 3), (2, "", 1, 1), (3, "b", 1, 0)]
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=3).collect()) == 0


def test_only_text_and_no_rows(spark):
    one = spark.createDataFrame([("x",), (None,)], "text string")
    assert by_row(line_dedup.dedup_lines(one).collect()) == [("", 1, 0), ("x", 1, 0)]
    assert line_dedup.dedup_lines(one.limit(0)).collect() == []
