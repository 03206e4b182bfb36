import base64
import random
import re
import string
from collections import Counter

import zstandard

from pagemine.llm import compression_bands as bands
from tests.llm.conftest import by_row, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dups, len(covered), failed


def test_counts_on_odd_texts(odd_docs, odd_table):
    got = bands.quality_rules(odd_table).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_row([tuple(r[n] for n in names) for r in got]) == by_row([(i, *brute(t)) for i, t, _ in odd_docs])
    assert all(not r.kept for r in got if r.base_failed)


def test_counts_on_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c ", "#x ", "\n", "ü\t", "b b ", "a\n"]) for _ in range(rng.randrange(40)))
        assert bands.measures(text, bands.Bands())[:6] == brute(text)


def test_bands_reject_what_repeats_or_does_not_compress():
    rng = random.Random(5)
    judge = bands.Bands().judge
    for n in (60, 200, 1000, 8000):
        assert judge(prose(rng, n).encode())[2] is None
    assert judge(b"the same words again and again. " * 200)[2] == "repetitive"
    assert judge(rng.randbytes(20_000))[2] == "incompressible"
    half = prose(rng, 2500).encode()
    assert judge(half + b"x" * (len(half) * 2))[2] in ("chunks", "repetitive")
    assert judge(b"") == (None, 0.0, "empty")


def expected(text):
    """The whole-text verdict, from limits written down here."""
    data = text.encode()
    ratio = len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data)
    limits = {256: (0.40, 1.10), 1024: (0.495, 0.85), 2048: (0.46, 0.70), 8192: (0.41, 0.60), 32768: (0.384, 0.50), 10**12: (0.22, 0.50)}
    low, high = limits[min(size for size in limits if len(data) < size)]
    plain = sum(b < 128 for b in data) >= 0.9 * len(data)
    return "repetitive" if ratio < low - (0 if plain else 0.15) else "incompressible" if ratio > high + (0 if plain else 0.05) else None


def test_whole_texts_against_an_own_computation():
    rng, judge, seen = random.Random(8), bands.Bands().judge, set()
    for _ in range(400):
        size = rng.choice((100, 300, 900, 1500, 4000, 12_000, 50_000))
        pool = prose(rng, rng.choice((5, 20, 80, 300, 3000))).split(" ")
        letters = rng.choice(("abc", "abcdefghij", "ünïcödé漢字語文章", "aé", string.ascii_letters + string.digits))
        known = rng.choice((0.8, 0.8, 0.0))
        words = [rng.choice(pool) if rng.random() < known else "".join(rng.choice(letters) for _ in range(5)) for _ in range(size // 5)]
        text = " ".join(words)
        want, (_, _, reason) = expected(text), judge(text.encode())
        assert (reason if reason != "chunks" else None) == want
        seen.add((want, reason))
    assert {w for w, _ in seen} == {None, "repetitive", "incompressible"}


def test_accepted_rows_are_those_marked(odd_table):
    kept = bands.quality_rules(odd_table).where("kept").select("doc_id").collect()
    assert by_row(bands.accepted(odd_table, ["doc_id", "text"]).select("doc_id").collect()) == by_row(kept)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bands.quality_rules(empty).collect() == [] and bands.accepted(empty, ["text"]).collect() == []


def encoded_texts(rng):
    """Texts of about 24 kB that a string column can hold and no one wrote."""
    raw = rng.randbytes(18_000)
    hexed = raw[:12_000].hex()
    code = base64.b64encode(raw).decode()
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {
        "base64 lines": base64.encodebytes(raw).decode(),
        "base64 words": " ".join(code[i : i + 12] for i in range(0, len(code), 12)),
        "hex lines": "\n".join(hexed[i : i + 76] for i in range(0, len(hexed), 76)),
        "random words": " ".join("".join(rng.choices(letters, k=7)) for _ in range(3000)),
        "random Latin-1": " ".join("".join(chr(rng.randrange(0xA1, 0x100)) for _ in range(7)) for _ in range(1600)),
    }


def test_encoded_text_is_rejected():
    judge = bands.Bands()
    for name, text in encoded_texts(random.Random(9)).items():
        *_, failed, kept, _, _, reason = bands.measures(text, judge)
        assert (name, failed, kept, reason) == (name, False, False, "incompressible")
    short = base64.encodebytes(random.Random(9).randbytes(1200)).decode()
    assert judge.judge(short.encode())[2] == "incompressible"


def test_junk_in_a_part_of_a_text_is_found():
    rng = random.Random(11)
    judge = bands.Bands().judge
    good = prose(rng, 3200)
    noise = "".join(chr(rng.randrange(32, 127)) for _ in range(20_000))
    for share in (0.3, 0.4, 0.48):
        size = int(len(good) * share / (1 - share))
        for junk in (("the same sentence stands here again. " * 600)[:size], noise[:size], base64.b64encode(rng.randbytes(size)).decode()[:size]):
            for text in (good + " " + junk, junk + " " + good, good[:7000] + junk + good[7000:]):
                assert judge(text.encode())[2] is not None
    # the last, partial chunk counts
    assert judge((good[:6144] + noise[:1500]).encode())[2] == "chunks"
    for n in (400, 700, 3200):
        assert judge(prose(rng, n).encode())[1:] == (0.0, None)
