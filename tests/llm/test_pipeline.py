import hashlib

import corpus_pipeline
from pagemine.llm import compression_bands as bands
from pagemine.llm.common import components
from tests.llm import test_line_dedup, test_mixing, test_ngram_join
from tests.llm.conftest import by_row
from tests.llm.test_byte_bpe import reference_encoder


def brute(rows):
    """Rows (doc_id, text, source) through all stages, in plain Python."""
    judge = bands.Bands()
    rows = [r for r in rows if bands.measures(r[1], judge)[6]]
    texts = test_line_dedup.brute([t for _, t, _ in rows], 10)
    rows = [(i, text, s) for (i, _, s), (text, _, _) in zip(rows, texts, strict=True)]
    groups = test_ngram_join.brute([(i, t) for i, t, _ in rows], 5, 80)
    rows = list(dict.fromkeys(r for r, (i, _, component) in zip(rows, groups, strict=True) if i == component))
    taken = test_mixing.brute(rows)
    encoder, out = reference_encoder(), []
    for (i, text, _), (*_, copies) in zip(rows, taken, strict=True):
        ids = encoder.encode_ordinary(text)
        digests = (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        out += [(i, len(ids), *digests)] * copies
    return out


def test_stages_equal_plain_python(spark, odd_docs, tmp_path):
    rows = [r for r in odd_docs if r[0] is not None]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = brute(rows)
    assert len(want) > 50 and by_row(got.collect()) == by_row(want)


def test_all_stages_but_the_last_return_documents(spark, odd_docs):
    docs = spark.createDataFrame([(i, t, None, s, None, "x") for i, t, s in odd_docs[:20] + odd_docs[-12:]], "doc_id long, text string, lang string, source string, n_chars long, size string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES][0].startswith("quality")


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr("pagemine.llm.common.FOREST_EDGES", 7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(i, 5) for i in range(6, 40)] + [(3, 3), (50, 60), (60, 50), (50, 60), (-4, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 5 for i in range(5, 40)} | {50: -4, 60: -4, -4: -4}
    assert got == want
