import math

import numpy as np
import pytest

from pagemine.llm import embedding_dedup as dedup
from tests.llm.conftest import by_row


def brute(rows, threshold):
    vectors = {i: (label, v) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in vectors}
    for i, (label, v) in vectors.items():
        for j, (other, w) in vectors.items():
            if i != j and label == other and len(v) == len(w):
                cosine = sum(a * b for a, b in zip(v, w, strict=True)) / (math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in w)))
                if cosine >= threshold:
                    links[i].add(j)
    out = []
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        smallest = None if i is None else min(seen)
        out.append((i, len(links.get(i, ())), smallest, i is None or smallest == i))
    return out


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(2))) for i in range(80)]
    at = 100
    for base in range(0, 20):
        for noise in (0.0, 0.1, 0.2, 0.35):
            rows.append((at, (np.array(rows[base][1]) * 3 + rng.normal(size=6) * noise).tolist(), rows[base][2]))
            at += 1
    family = rng.normal(size=6)
    rows += [(at + i, (family + rng.normal(size=6) * 0.05).tolist(), 1) for i in range(60)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 6, 1), (503, [float("nan")] * 6, 1), (504, [None, *[1.0] * 5], 1), (505, [float("inf")] * 6, 0)]
    rows += [(506, rows[0][1], None), (507, [1.0, 2.0], 0), (508, [2.0, 4.0], 0), (None, rows[0][1], 0), (509, [1e-200] * 6, 0), (510, [1e200] * 6, 0)]
    return rows


@pytest.mark.parametrize(("seed", "cell_size", "block"), [(1, 4096, 512), (2, 8, 16)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, seed, cell_size, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "PART", 50)
    rows = rows_of(seed)
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, unit string, links int")
    want = brute([r for r in rows if r[0] not in (509, 510)], 0.93)
    got = dedup.near_duplicates(vectors, cell_size=cell_size).collect()
    assert by_row([r for r in got if r.vec_id not in (509, 510)]) == by_row(want)
    assert {(r.vec_id, r.n_links) for r in got if r.vec_id in (509, 510)} == {(509, 1), (510, 1)}


def test_repeated_rows_are_one_vector(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert by_row(got) == by_row([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)])


def test_empty_table(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_guests_reach_every_cell_that_holds_a_link():
    rng = np.random.default_rng(3)
    x = dedup._unit(rng.normal(size=(400, 4)))
    centroids = dedup.spherical_kmeans(x, 20)
    own, guests, _ = dedup.cells_of(x, centroids, 0.93)
    i, j = np.nonzero(x @ x.T >= 0.93)
    lower = own[i] <= own[j]
    assert ((own[i] == own[j]) | guests[j, own[i]])[lower].all() and guests.any() and not guests.all()


def test_an_id_with_several_vectors_has_the_links_of_all(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (3, [0.0, -1.0], 1), (4, [5.0, 0.1], 0), (5, [-1.0, 0.0], 0), (0, [0.0, -2.0], 1)]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 3, 0), (2, 2, 0), (3, 2, 0), (4, 2, 0), (5, 0, 5), (0, 1, 0)}


def test_columns_named_like_the_operators_own(spark):
    rows = [(1, [1.0, 0.0], 0, 1, 1, "x"), (2, [1.0, 0.0], 0, 2, 2, "y")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int, blocks int, digest string")
    assert by_row(dedup.near_duplicates(frame).collect()) == by_row([(1, 1, 1, True), (2, 1, 1, False)])
