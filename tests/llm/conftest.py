import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_docs():
    """Rows (doc_id, text, source): nulls, empty and very long texts, repeated rows, exact and near copies."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (60, 90, 200, 400, 400)]
    rows = [(i, t, "s1") for i, t in enumerate(base)]
    at = 10
    for t in base:
        for edits in (0, 1, 2, 3, 5, 8, 12):
            rows.append((at, edited(rng, t, edits), "s2"))
            at += 1
        rows.append((at, t.upper(), None))
        at += 1
    family = prose(rng, 150)
    for _ in range(40):
        rows.append((at, edited(rng, family, rng.randint(0, 6)), "s3"))
        at += 1
    shared = "this very line stands in many of the documents"
    for i in range(14):
        rows.append((at, f"{prose(rng, 20 + i)}\n  {shared if i % 2 else shared.upper()}\t\n{prose(rng, 30)}\n{shared}", "s1"))
        at += 1
    rows += [(at, None, "s1"), (at + 1, "", None), (at + 2, " \n\t\n", "s2"), (at + 3, "one", "s2"), (at + 4, "One", "s2"), (at + 5, "two words", "s3")]
    rows += [(at + 6, prose(rng, 20_000), "s1"), (at + 7, "word " * 3000, "s1"), (None, base[0], "s1"), (None, None, None)]
    rows += [rows[0], rows[0], (at + 8, "héé ünd 漢字 🙂 \x00 � naïve\r\nline\x0bbreak\x0cform", "s3")]
    return rows


@pytest.fixture(scope="session")
def odd_table(spark, odd_docs):
    """The rows with columns named like those that operators make."""
    rows = [(i, t, s, 1, 2.0, "z") for i, t, s in odd_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key int, n double, size string")


def by_row(rows):
    return sorted(map(tuple, rows), key=repr)
