"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of a text's words, across line ends, as long as the template's notice; a
template is the word set of a license notice, and the words among them that tell it from others. A
block matches when it holds at least THRESHOLD of the template's words and all telling ones. Template
words are ordered by the number of documents that hold them, counted over the whole table, rare
first. A match holds one of a template's first n - need + 1 words, so only templates with such a word
in the text are tried (prefix filter), only if the text holds enough of their words at all (length
filter), and only in stretches of the text where enough of them stand within reach of such a word
(positional filter); there every window is counted, by sliding over the template's words.

The templates and their order are a few kB, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Phrases whose consecutive words name a license, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Labels, notices of common licenses as their texts recommend them, and the words that must occur.
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "software"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "sharealike"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "nc"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "copyright"),
)

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; all others become blanks.
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
SLICE = 512


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]
    need: int
    span: int
    must: frozenset[bytes]


def templates_of(notices=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    found = []
    for label, text, must in notices:
        words = frozenset(words_of(text))
        need = next(k for k in range(len(words) + 1) if k >= threshold * len(words))
        found.append(Template(label, words, max(1, need), len(words_of(text)), frozenset(words_of(must))))
    return found


def word_frequencies(texts: DataFrame, templates: list[Template]) -> dict[bytes, int]:
    """In how many rows of texts(text) each template word occurs: one row per word comes back."""
    vocabulary = frozenset().union(*(t.words for t in templates)) if templates else frozenset()

    def count(batches):
        found: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for word in vocabulary.intersection(words_of(text)):
                    found[word] = found.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    sums = rows.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(sums.column("word").to_pylist(), sums.column("n").to_pylist(), strict=True))


class Scanner:
    """Templates indexed by their rarest words."""

    def __init__(self, templates: list[Template], frequencies: dict[bytes, int]):
        vocabulary = {word for template in templates for word in template.words}
        self.place = {word: at for at, word in enumerate(sorted(vocabulary, key=lambda w: (frequencies.get(w, 0), w)))}
        self.templates = templates
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}
        for number, template in enumerate(templates):
            for at, word in enumerate(sorted(template.words, key=self.place.__getitem__)[: len(template.words) - template.need + 1]):
                self.by_word.setdefault(word, []).append((number, at))
        self.first_words = frozenset(self.by_word)

    def candidates(self, held: set[bytes]):
        """(template number, its rarest words in the text) of the templates that a text may match."""
        anchors: dict[int, set[bytes]] = {}
        for word in self.first_words & held:
            for number, _ in self.by_word[word]:
                anchors.setdefault(number, set()).add(word)
        for number, words in sorted(anchors.items()):
            template = self.templates[number]
            if template.must <= held and len(template.words & held) >= template.need:
                yield number, words

    def windows(self, template: Template, anchors: set[bytes], hits: list[tuple[int, bytes]]):
        """(start, shared words) of each run of overlapping matches: the best window, the first of equals.

        `hits` are the places of the template's words. Windows end at a hit; others hold no more.
        """
        near = [at for at, word in hits if word in anchors]
        inside: dict[bytes, int] = {}
        low, best, end, next_anchor = 0, None, -1, 0
        for k, (at, word) in enumerate(hits):
            inside[word] = inside.get(word, 0) + 1
            while hits[low][0] <= at - template.span:
                old = hits[low][1]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                low += 1
            while next_anchor < len(near) and near[next_anchor] <= at - template.span:
                next_anchor += 1
            if k - low + 1 < template.need or next_anchor == len(near) or near[next_anchor] > at:
                continue
            if len(inside) >= template.need and template.must <= inside.keys():
                if best is not None and hits[low][0] > end:
                    yield best
                    best = None
                if best is None or len(inside) > best[1]:
                    best = (hits[low][0], len(inside))
                end = at
        if best is not None:
            yield best

    def scan(self, text: str | None) -> tuple[list[bytes], list[tuple[int, int, int]]]:
        """The words of a text, and (start word, template, shared words) of its matches."""
        words = words_of(text)
        held = set(words)
        matches = []
        if not self.first_words.isdisjoint(held):
            places = None
            for number, anchors in self.candidates(held):
                places = [(at, word) for at, word in enumerate(words) if word in self.place] if places is None else places
                template = self.templates[number]
                hits = [(at, word) for at, word in places if word in template.words]
                matches += [(start, number, shared) for start, shared in self.windows(template, anchors, hits)]
        return words, matches


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(start word, label) wherever a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases:
        parts = words_of(phrase)
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                found.append((at, label))
    return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start:int,label:string,containment:double>>"


def scan_licenses(docs: DataFrame, notices=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """Per row of docs(doc_id, text): the columns of SCHEMA.

    blocks are all (start word, label) with the best containment of a template of that label; labels are
    those of blocks and phrases together, distinct, sorted, joined by commas. score is 1 where a
    phrase stands, else the best containment, else 0. Null and empty texts have no words: counts 0,
    places null, labels empty. Null ids and repeated rows are kept; other columns are ignored;
    whole texts are read; an empty table gives an empty result.
    """
    templates = templates_of(notices, threshold)
    scanner = Scanner(templates, word_frequencies(docs, templates))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for text in part.column("text").to_pylist():
                    words, matches = scanner.scan(text)
                    places = phrase_places(words, phrases) if b"license" in words or phrases is not PHRASES else []
                    best: dict[tuple[int, str], float] = {}
                    for start, number, shared in matches:
                        template = templates[number]
                        spot = (start, template.label)
                        best[spot] = max(best.get(spot, 0.0), shared / len(template.words))
                    base = {label for _, label in places}
                    starts = [start for start, _ in places]
                    rows.append(
                        (
                            len(words),
                            len(places),
                            min(starts, default=None),
                            max(starts, default=None),
                            ",".join(sorted(base)),
                            ",".join(sorted(base | {label for _, label in best})),
                            1.0 if places else max(best.values(), default=0.0),
                            [{"start": start, "label": label, "containment": value} for (start, label), value in sorted(best.items())],
                        )
                    )
                columns = zip(*rows, strict=True) if rows else [()] * 8
                block = pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block]
                arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
