import re

import numpy as np
import pytest

from pagemine.llm import ngram_join
from tests.llm.conftest import by_row


def brute(rows, size, percent):
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and 100 * common >= percent * (len(x) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        smallest[r] = min([d for d in (smallest.get(r), doc_id) if d is not None], default=None)
    return [(d, len(sets[i]), smallest[root(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_are_those_of_all_pairs(odd_docs, odd_table, size, percent):
    got = ngram_join.near_duplicates(odd_table, size, percent).collect()
    assert by_row(got) == by_row(brute([(i, t) for i, t, _ in odd_docs], size, percent))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).collect() == []


def test_prefixes_meet_whenever_sets_are_similar():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        x = set(rng.choice(60, n, replace=False).tolist())
        y = set(x)
        for _ in range(int(rng.integers(0, 4))):
            y.discard(int(rng.integers(60)))
            y.add(int(rng.integers(60)))
        common = len(x & y)
        if y and 100 * common >= 80 * (len(x) + len(y) - common):
            first = lambda s: set(sorted(s)[: ngram_join.prefix_length(len(s), 80)])
            assert first(x) & first(y)
