import itertools
import random
import zlib

import numpy as np

from pagemine.llm import quality_crf as crf
from tests.llm.conftest import prose


def test_marginals_equal_those_of_all_labelings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        unary, steps = rng.normal(size=n), rng.normal(size=(2, 2))
        weights = np.zeros(n)
        total = 0.0
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(u for u, y in zip(unary, labels, strict=True) if y) + sum(steps[a, b] for a, b in itertools.pairwise(labels))
            total += np.exp(score)
            weights += np.exp(score) * np.array(labels)
        got, _, log_total = crf._forward_backward(np.vstack([unary, unary]), np.array([n, n]), steps)
        assert np.allclose(got, weights / total) and np.allclose(log_total, np.log(total))


def test_padding_changes_nothing():
    rng = np.random.default_rng(1)
    steps, unary = rng.normal(size=(2, 2)), rng.normal(size=(2, 6))
    both, pairs, _ = crf._forward_backward(unary, np.array([3, 6]), steps)
    short, one, _ = crf._forward_backward(unary[:1, :3], np.array([3]), steps)
    long, two, _ = crf._forward_backward(unary[1:], np.array([6]), steps)
    assert np.allclose(both[0, :3], short[0]) and np.allclose(both[1], long[0]) and np.allclose(pairs, one + two)


def test_line_features_of_odd_texts():
    for text in (None, "", "\n", "\n\na b\n", "ß漢🙂\r\nX", "#" * 5000):
        features, lengths = crf.line_features(text)
        lines = (text or "").split("\n")
        assert features.shape == (len(lines), crf.BASE) and lengths.tolist() == [len(line) for line in lines]
        assert np.isfinite(features).all() and (features >= 0).all() and (features <= 1).all()
    around = crf.with_neighbours(crf.line_features("a\nB\n#")[0])
    assert (around[0, crf.BASE : 2 * crf.BASE] == 0).all() and (around[1, crf.BASE : 2 * crf.BASE] == around[0, : crf.BASE]).all()


def labelled(spark, n=240):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        lines = [prose(rng, 15).capitalize() + "." for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines if good else [line.upper().replace(" ", "!! ") for line in lines])))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = crf.train(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = crf.score_documents(docs, model).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    tested = [r for r in got if r.held_out]
    assert len(tested) > 30 and all(r.predicted == known[r.doc_id] for r in tested)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark, 80)
    turned = labels.select("doc_id", (crf.F.when(crf.held_out(crf.F.col("doc_id")), 1 - crf.F.col("quality")).otherwise(crf.F.col("quality"))).alias("quality"))
    one, two = crf.train(docs, labels), crf.train(docs, turned)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.steps, two.steps)


def test_odd_rows_and_no_labels(spark, odd_table):
    none = spark.createDataFrame([(1, None), (2, 5)], "doc_id long, quality int")
    assert crf.train(odd_table, none) is None
    got = crf.score_documents(odd_table, None)
    assert got.count() == odd_table.count() and {r.score for r in got.collect()} == {0.5}
    model = crf.Crf(np.ones(crf.FEATURES), np.eye(2))
    scores = crf.score_documents(odd_table, model).collect()
    assert all(0 <= r.score <= 1 for r in scores) and all(r.held_out for r in scores if r.doc_id is None)
    assert crf.score_documents(odd_table.limit(0), model).collect() == []
