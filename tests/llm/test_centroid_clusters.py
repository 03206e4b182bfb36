import hashlib
import math
import random

import numpy as np
import pytest

from pagemine.llm import centroid_clusters
from tests.llm.conftest import by_row

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance double"


def brute(rows, k, width, rounds, seed="2", scale=256):
    """Squared distances to all centroids, in Python's integers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            exact = [x.as_integer_ratio() for x in v]
            kept.append((vec_id, [a * scale // b for a, b in exact]))
    name = lambda row: "null" if row[0] is None else str(row[0])
    first = sorted(kept, key=lambda row: (hashlib.sha256(f"{seed}:{name(row)}".encode()).hexdigest(), row[1]))
    centroids = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min((far(v, c), at) for at, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for at in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == at]
            if members:
                centroids[at] = [sum(m[i] for m in members) // len(members) for i in range(width)]
    near = assign()
    inertia = {}
    for d, c in near:
        inertia[c] = inertia.get(c, 0) + d
    long = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(vec_id, c, long(d), long(inertia[c]), long(sum(inertia.values())), digest[c]) for (vec_id, _), (d, c) in zip(kept, near, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_are_those_of_all_distances(spark, monkeypatch, seed):
    monkeypatch.setattr(centroid_clusters, "BATCH", 37)
    rng = random.Random(seed)
    # few values, so that ties, equal vectors and empty clusters occur
    rows = [(i, [rng.choice((-0.5, -0.25, 0.0, 0.003, 0.25)) for _ in range(4)]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [0.1] * 3), (403, [None, 0.0, 0.0, 0.0]), (404, [math.nan] * 4), (405, [math.inf] * 4)]
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (None, [0.2, 0.2, 0.3, 0.4]), rows[0], rows[0], (5, [0.9, 0.9, 0.9, 0.9])]
    got = centroid_clusters.clusters(frame(spark, rows), k=12, width=4, rounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert by_row(got.collect()) == by_row(brute(rows, 12, 4, 3))


def test_large_and_tiny_components_are_exact(spark):
    rows = [(1, [1e6, -1e6]), (2, [1e9, 3.0]), (3, [1e-300, -1e-300]), (4, [0.0, 0.0]), (5, [1e9, 2.0]), (6, [1e15, 0.0]), (7, [-0.0, 1.0])]
    got = centroid_clusters.clusters(frame(spark, rows), k=3, width=2, rounds=2)
    assert by_row(got.collect()) == by_row(brute(rows, 3, 2, 2))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.1, 0.0])]
    got = centroid_clusters.clusters(frame(spark, rows), k=9, width=2)
    assert by_row(got.collect()) == by_row(brute(rows, 9, 2, 5))
    assert centroid_clusters.clusters(frame(spark, []), k=9, width=2).collect() == []
    assert centroid_clusters.clusters(frame(spark, [(1, None)])).collect() == []


def test_a_sign_of_zero_favours_the_smaller_number():
    near, apart = centroid_clusters.Tournament([[4, 0], [0, 0], [0, 0], [2, 2]]).nearest(np.array([[2, 0], [0, 0], [2, 1], [0, 1]], np.int64))
    assert near.tolist() == [0, 1, 3, 1] and apart.tolist() == [4, 0, 1, 1]
