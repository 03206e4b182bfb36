import base64
import hashlib

import public_tokenizers
import tiktoken

from pagemine.llm import byte_bpe
from tests.llm.conftest import by_row


def reference_encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(odd_docs, odd_table):
    encoder = reference_encoder()
    got = byte_bpe.encode_documents(odd_table).collect()
    want = []
    for doc_id, text, _ in odd_docs:
        ids = encoder.encode_ordinary(text or "")
        spelt = " ".join(map(str, ids))
        want.append((doc_id, len(ids), ids, hashlib.sha256(spelt.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert by_row(got) == by_row(want)


def test_special_strings_are_text_and_odd_characters_agree():
    encoder, bpe = reference_encoder(), byte_bpe.tokenizer()
    texts = ["<|endoftext|>", "a<|endoftext|>b", "   x\n\n\n y  ", "'s'S 'll", " \u0085᠎​", "٣४Ⅷ²", "𝔘𝔫🏳️‍🌈", "a" * 5000, "\x00\x7f\xa0", "ﷺ" * 40]
    texts += [chr(c) + "a " + chr(c) + "1" for c in range(0x20, 0xD800, 37)]
    spelt, ids = bpe.encode_many(texts)
    for text, one, numbers in zip(texts, spelt, ids, strict=True):
        assert one == " ".join(map(str, encoder.encode_ordinary(text)))
        assert bpe.encode(text)[0] == numbers.tolist()
        assert bpe.decode_bytes(numbers) == text.encode()


def test_split_characters_and_offsets():
    bpe = byte_bpe.tokenizer()
    ids, offsets = bpe.encode("漢🙂x")
    parts = bpe.decode(ids)
    assert "".join(parts) == "漢🙂x" and "" in parts
    assert offsets[0][0] == 0 and offsets[-1] == (2, 3)
    assert bpe.decode(ids[:1]) == ["�"] and bpe.decode([]) == []


def test_byte_table_is_a_bijection():
    assert len(set(byte_bpe.byte_characters().values())) == 256


def test_pieces_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES_KEPT", 3)
    bpe, encoder = byte_bpe.ByteBpe(), reference_encoder()
    for text in ("alpha beta gamma delta", "epsilon zeta eta", "x" * 200):
        assert bpe.encode_many([text])[1][0].tolist() == encoder.encode_ordinary(text)


def test_empty_table(spark):
    assert byte_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
