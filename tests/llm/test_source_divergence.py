import random
import re

import numpy as np
import pytest

from pagemine.llm import source_divergence
from tests.llm.conftest import by_row

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(ASCII))


def brute(rows, min_docs=10, top=10):
    """All shares of all groups and terms."""
    out, by_lang = [], {}
    for text, lang, source in rows:
        by_lang.setdefault(lang or "", {}).setdefault(source or "", []).append(terms_of(text))
    for lang, sources in by_lang.items():
        docs = [d for ds in sources.values() for d in ds]
        seen = {}
        for d in docs:
            for t in set(d):
                seen[t] = seen.get(t, 0) + 1
        kept = sorted(t for t, n in seen.items() if n >= min_docs)

        def shares(ds, kept=kept):
            count = {t: sum(d.count(t) for d in ds) for t in kept}
            total = sum(count.values())
            return count, {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(docs)[1]
        own = {s: shares(ds) for s, ds in sources.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (count, p) in own.items():
            pairs = [(sum(f(p[t], own[o][1][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[t], whole[t]), t) for t in kept if count[t] and p[t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, at + 1) for at, (value, item) in enumerate(ranked)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n long, term string, total int")


WORDS = "a I the The word Word eightchr ninechars sixteencharacter seventeencharact é ÉÉ übergrößenträger 漢字漢字漢字漢字 x" + "y" * 40 + " z" + "w" * 300


def rows_of(seed, n=120):
    rng, words = random.Random(seed), WORDS.split(" ")
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "é", "漢", None])
        text = "".join(rng.choice(words) + rng.choice([" ", "1", "\n", "@", "-", "\x00", "."]) for _ in range(rng.randrange(30)))
        rows.append((text, lang, source))
    rows += [(None, "en", "none"), ("", "fr", "s1"), ("12 34", "fr", "s2"), ("once", "xx", "alone"), ("the " * 5000, "en", "s1"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("seed", "tile", "terms", "held"), [(1, 128, 8192, 1 << 22), (2, 2, 3, 50)])
def test_rows_are_those_of_all_groups_and_terms(spark, monkeypatch, seed, tile, terms, held):
    monkeypatch.setattr(source_divergence, "TILE", tile)
    monkeypatch.setattr(source_divergence, "TERMS", terms)
    monkeypatch.setattr(source_divergence, "HELD", held)
    monkeypatch.setattr(source_divergence, "SLICE", 16)
    rows = rows_of(seed)
    got = source_divergence.audit(frame(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert by_row(got.collect()) == by_row(brute(rows))


def test_counts_of_a_task():
    counter, want = source_divergence.TermCounter(), {}
    texts = [t or "" for t, _, _ in rows_of(3)]
    groups = [len(t) % 3 for t in texts]
    for at in range(0, len(texts), 7):
        part = [t.encode() for t in texts[at : at + 7]]
        offsets = np.cumsum([0, *map(len, part)])
        counter.add(np.frombuffer(b"".join(part), np.uint8), offsets, np.array(groups[at : at + 7]))
    for text, group in zip(texts, groups, strict=True):
        for term in set(terms_of(text)):
            n, docs = want.get((term, group), (0, 0))
            want[term, group] = (n + terms_of(text).count(term), docs + 1)
    got = {(t.decode(), int(g)): (int(n), int(d)) for terms, gs, ns, ds in counter.counts() for t, g, n, d in zip(terms, gs, ns, ds, strict=True)}
    assert got == want and counter.held == 0 and not list(counter.counts())


def test_radix_order_is_stable_and_complete():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 1 << 63, 500).astype(np.uint64) >> np.uint64(shift) for shift in (61, 20)] + [rng.integers(0, 5, 500).astype(np.uint32)]
    assert source_divergence.radix_order(keys).tolist() == np.lexsort(keys[::-1]).tolist()
    assert source_divergence.radix_order([np.empty(0, np.uint64)]).tolist() == []


def test_empty_table_and_no_terms(spark):
    assert source_divergence.audit(frame(spark, [])).collect() == []
    got = source_divergence.audit(frame(spark, [(None, None, None), ("", None, "b")])).collect()
    assert by_row(got) == by_row([("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)])
