import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from pagemine.llm import piece_bpe
from tests.llm.conftest import by_row


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_and_round_trip(odd_docs, odd_table, library):
    want = []
    for doc_id, text, _ in odd_docs:
        ids = library.encode(text or "", add_eos=True)
        spelt = " ".join(map(str, ids))
        want.append((doc_id, len(ids), ids, hashlib.sha256(spelt.encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert by_row(piece_bpe.encode_documents(odd_table).collect()) == by_row(want)
    without = piece_bpe.encode_documents(odd_table, with_ids=False).select("doc_id", "n_tokens", "ids").collect()
    assert by_row(without) == by_row((w[0], w[1], None) for w in want)


def test_odd_texts(library):
    bpe = piece_bpe.encoder()
    texts = ["<s>", "</s> <unk><0x0A>", " " * 100, "a" * 5000, "\x00a\x00", "x▁▁y", "\r\n\t ", " " * 17 + "x" + " " * 33, "🏳️‍🌈", "ﷺ" * 40, "héé 漢字"]
    texts += [chr(c) + "a " + chr(c) + "1" for c in range(1, 0xD800, 41)]
    for text, ids in zip(texts, bpe.encode_many(texts), strict=True):
        assert ids == library.encode(text, add_eos=True)
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids)
    assert bpe.encode(None) == bpe.encode("") == [bpe.end_id] and bpe.decode([bpe.end_id]) == ""


def test_random_pieces_uncut_and_cut(library):
    bpe, rng = piece_bpe.encoder(), random.Random(5)
    pieces = list(bpe.ids)
    for _ in range(3000):
        if rng.random() < 0.5:
            text = "".join(rng.choice(pieces) for _ in range(rng.choice((1, 2, 3, 8))))
        else:
            text = "".join(rng.choice("aeinrst ▁\n漢") for _ in range(rng.randint(1, 40)))
        want = library.encode(text, add_eos=True)
        assert bpe.encode(text) == want
        assert bpe.encode_many([text]) == [want]


def test_the_last_token_of_every_prefix_is_that_of_plain_merging():
    bpe, rng = piece_bpe.encoder(), random.Random(6)
    for _ in range(300):
        text = "▁" + "".join(rng.choice("etaoin▁sh") for _ in range(rng.randint(1, 25)))
        table = bpe.last_tokens(text)
        for end in range(1, len(text) + 1):
            assert table[end - 1] == bpe.merged(text[:end])[-1]


def test_stretches_are_forgotten_without_harm(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "KEPT", 3)
    monkeypatch.setattr(piece_bpe, "PAIRS_KEPT", 3)
    bpe = piece_bpe.PieceBpe()
    for text in ("alpha beta gamma delta", "epsilon zeta eta", "x" * 200):
        assert bpe.encode_many([text]) == [library.encode(text, add_eos=True)]


def test_empty_table(spark):
    assert piece_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
