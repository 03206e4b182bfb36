"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut by the tokenizer's pattern; each piece is encoded by itself, so a piece seen
before costs a lookup, and only a new one goes to the library's model. Byte-level models
write every byte as one printable character; `byte_characters` rebuilds that table, and
decoding reverses it: ids to characters to bytes, across tokens that end inside a character.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import sha256_hex

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pieces whose ids a task remembers, and the longest that it remembers.
PIECES_KEPT, PIECE_KEPT = 400_000, 64


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + at) for at, b in enumerate(other)}


def merge_pairs(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merges, in order: a token's two halves are what merging by lower ranks leaves of it."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if len(token) < 2:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        merges.append((parts[0], parts[1]))
    return merges


class ByteBpe:
    """Encodes by a file of ranks. `encode` gives ids and character offsets; `encode_many` remembers pieces."""

    def __init__(self, ranks_file: str = RANKS, pattern: str = PATTERN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        shown = byte_characters()
        table = dict(shown)
        self.spell = lambda token: token.decode("latin-1").translate(table)
        model = models.BPE(vocab={self.spell(t): r for t, r in ranks.items()}, merges=[(self.spell(a), self.spell(b)) for a, b in merge_pairs(ranks)])
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.pieces = regex.compile(pattern).findall
        hidden = {c: b for b, c in shown.items()}
        tokens = {id_: bytes(hidden[c] for c in token) for token, id_ in self.tokenizer.get_vocab().items()}
        self.lengths = np.array([len(tokens.get(id_, b"")) for id_ in range(max(tokens) + 1)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(tokens[id_] for id_ in sorted(tokens)), np.uint8)
        self.known: dict[str, str] = {}
        self.packed: dict[str, bytes] = {}

    def encode(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the characters (from, to) of the text that it covers or cuts."""
        found = self.tokenizer.encode(text or "", add_special_tokens=False)
        return found.ids, found.offsets

    def decode_bytes(self, ids) -> bytes:
        """The bytes of all ids: their places in one string of all tokens, gathered at once."""
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.spelling[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()

    def decode(self, ids) -> list[str]:
        """The text each id completes: a character split over ids appears with the last of them."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [decoder.decode(self.decode_bytes([i])) for i in ids]
        tail = decoder.decode(b"", True)
        return parts if not tail else [*parts[:-1], parts[-1] + tail]

    def encode_many(self, texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
        """For each text its ids: in decimal, joined by one space, and as numbers."""
        cut = [self.pieces(text) if text else [] for text in texts]
        known, packed = self.known, self.packed
        if len(known) > PIECES_KEPT:
            known.clear()
            packed.clear()
        tokenize, spell, long = self.tokenizer.model.tokenize, self.spell, []
        for piece in {piece for pieces in cut for piece in pieces if piece not in known}:
            ids = [token.id for token in tokenize(spell(piece.encode()))]
            known[piece] = " ".join(map(str, ids))
            packed[piece] = array("i", ids).tobytes()
            if len(piece) > PIECE_KEPT:
                long.append(piece)
        spelt = [" ".join(map(known.__getitem__, pieces)) for pieces in cut]
        ids = [np.frombuffer(b"".join(map(packed.__getitem__, pieces)), np.int32) for pieces in cut]
        for piece in long:
            del known[piece], packed[piece]
        return spelt, ids


@lru_cache(maxsize=2)
def tokenizer(ranks_file: str = RANKS, pattern: str = PATTERN) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(ranks_file, pattern)


SLICE = 256


def encode_documents(docs: DataFrame, ranks_file: str = RANKS, pattern: str = PATTERN, with_ids: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, ids (array of int, null without with_ids), ids_sha256, decoded_sha256.

    ids are those the ranks give, each match of the pattern encoded separately, no special
    tokens. decoded_sha256 is the digest of the bytes decoded from the ids; ids_sha256 that of
    the decimal ids joined by one space. Null and empty texts have no tokens and the digests of
    nothing. Null ids and repeated rows are kept; other columns are ignored; texts of any length
    are encoded whole; an empty table gives an empty result.
    """

    def run(batches):
        bpe = tokenizer(ranks_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                spelt, ids = bpe.encode_many(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array(ids if with_ids else [None] * len(ids), pa.list_(pa.int32())),
                        pa.array([sha256_hex(s.encode()) for s in spelt]),
                        pa.array([sha256_hex(bpe.decode_bytes(i)) for i in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
