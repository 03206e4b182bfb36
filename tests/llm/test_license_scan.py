import random
import re

from pagemine.llm import license_scan as scan
from tests.llm.conftest import by_row

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, notices, threshold):
    words = words_of(text)
    places = []
    for phrase, label in scan.PHRASES:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    base, best, labels = {label for _, label in places}, 0.0, set()
    for label, notice, must in notices:
        template, span = set(words_of(notice)), len(words_of(notice))
        for end in range(1, len(words) + 1):
            held = set(words[max(0, end - span) : end])
            if must in held and len(template & held) >= threshold * len(template):
                labels.add(label)
                best = max(best, len(template & held) / len(template))
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best)


def test_scan_equals_every_block_against_every_template(spark, odd_docs):
    rng = random.Random(4)
    pool = [w for _, notice, _ in scan.TEMPLATES for w in notice.split()] + ["apache", "License", "other", "words", "über"]
    texts = []
    for at in range(150):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(scan.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(pool)
            lines.append(" ".join(words[: rng.randint(1, len(words))] if at % 3 else words))
        texts.append("\n".join(lines))
    texts += ["MIT License mit license", "the general public\nlicense, general-public license", None, ""] + [t for _, t, _ in odd_docs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for threshold in (0.8, 1.0, 0.5):
        got = scan.scan_licenses(docs, threshold=threshold).select(*columns).collect()
        assert by_row(got) == by_row([(i, *brute(t, scan.TEMPLATES, threshold)) for i, t in enumerate(texts)])


def test_blocks_name_their_first_word(spark):
    docs = spark.createDataFrame([(1, "x\nreleased under the MIT license.\ny")], "doc_id long, text string")
    row = scan.scan_licenses(docs).first()
    assert [(b.start, b.label, b.containment) for b in row.blocks] == [(1, "mit", 1.0)]
    assert (row.n_base, row.first_word, row.last_word, row.base_labels, row.score) == (1, 4, 4, "mit", 1.0)


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    def wrapped(text, width):
        words = text.split()
        return "\n".join(" # " + " ".join(words[at : at + width]) for at in range(0, len(words), width))

    texts = [wrapped(notice, width) for _, notice, _ in scan.TEMPLATES for width in (3, 9)]
    texts += ["The band released its album under the radar and later asked the city for a liquor license.", "released under the license"]
    texts.append("Permission is hereby granted, free of charge, " + "to quote at length " * 40 + "any person obtaining a copy of this software and associated documentation files")
    found = {r.doc_id: r for r in scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for at, (label, _, _) in enumerate(t for t in scan.TEMPLATES for _ in range(2)):
        assert label in found[at].labels.split(",") and found[at].score == 1.0
    assert all(found[at].labels == "" and found[at].score == 0.0 for at in range(len(texts) - 3, len(texts)))


def test_ties_and_other_columns(odd_table):
    assert scan.scan_licenses(odd_table).count() == odd_table.count()
    assert scan.scan_licenses(odd_table.limit(0)).collect() == []
