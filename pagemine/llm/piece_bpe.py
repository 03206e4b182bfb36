"""SentencePiece encoding and decoding: the last token of every prefix, and ids recovered backwards.

Merging by score has a property that makes it computable from left to right: the encoding of a
prefix ends with exactly one token, and that token is the only one that ends there and stands
compatibly after the last token of the prefix before it. Two tokens are compatible when merging
their joined characters gives just the two of them. So a table with one token per prefix is
enough: an automaton over all pieces names the tokens that end at a place, pair tests (remembered)
choose the one, and the ids are read off from the end. Cost is linear in the text.

A normalised text is first cut where no piece reaches across: before a run of spaces, after a run of
letters, and around characters that are in no longer piece. Such a stretch seen before costs a lookup.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import sha256_hex

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Stretches whose ids a task remembers, the longest that it remembers, and pair tests remembered.
KEPT, LONGEST, PAIRS_KEPT = 600_000, 64, 500_000


class PairTests(dict):
    """Whether two tokens stand compatibly: merging their joined characters gives just the two. Remembered."""

    def __init__(self, merged):
        self.merged = merged

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) > PAIRS_KEPT:
            self.clear()
        known = self[pair] = self.merged(pair[0] + pair[1]) == list(pair)
        return known


class PieceBpe:
    """Encodes and decodes by a SentencePiece model of merge type with byte fallback and no user-defined pieces."""

    def __init__(self, model_file: str = MODEL):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        unknown, is_byte = self.library.unk_id(), self.library.is_byte
        special = [self.library.is_control(i) or is_byte(i) or i == unknown for i in range(size)]
        if not any(map(is_byte, range(size))) or any(map(self.library.is_unused, range(size))):
            raise ValueError("needs a model with byte fallback and without unused pieces")
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if not special[i]}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        self.end_id = self.library.eos_id()
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # a piece that merging never makes of its own characters is never a token
            if len(piece) > 1 and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.stretches = re.compile(self._stretch_pattern()).findall
        self.fits = PairTests(self.merged)
        self.names = list(map(str, range(size)))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _stretch_pattern(self) -> str:
        """Stretches that no piece reaches out of: read off the pairs of neighbours that pieces hold."""
        longer = [piece for piece in self.ids if len(piece) > 1]
        inside = {c for piece in longer for c in piece}
        pairs = {pair for piece in longer for pair in zip(piece, piece[1:])}
        if any((b == SPACE and a != SPACE) or (a.isalpha() and not b.isalpha()) for a, b in pairs):
            return f"(?s)[{''.join(map(re.escape, sorted(inside)))}]+|."
        letters = "".join(re.escape(c) for c in sorted(inside) if c.isalpha())
        marks = "".join(re.escape(c) for c in sorted(inside - {SPACE}) if not c.isalpha())
        return f"(?s){SPACE}*[{marks}]*[{letters}]+|{SPACE}*[{marks}]+|{SPACE}+|."

    def merged(self, text: str) -> list[str]:
        """Merging as defined: the neighbours with the best score first, the leftmost of equals. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def last_tokens(self, text: str) -> list[str]:
        """The last token of every non-empty prefix of a normalised text."""
        table, fits, done = list(text), self.fits, -1  # the last character, unless a longer token is found
        for end, (piece, length) in self.automaton.iter(text):
            if end != done:
                before = end - length
                if before < 0 or fits[table[before], piece]:
                    table[end], done = piece, end
        return table

    def ids_of(self, text: str) -> list[int]:
        """Ids of a normalised text, recovered from the end of its table."""
        table, ids, found, end = self.last_tokens(text), self.ids, [], len(text)
        while end:
            piece = table[end - 1]
            end -= len(piece)
            if piece in ids:
                found.append(ids[piece])
            else:
                found.extend(self.byte_ids[b] for b in reversed(piece.encode()))
        found.reverse()
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, the end id last."""
        return [*self.ids_of(self.library.normalize(text or "")), self.end_id]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, the end id last; stretches seen before are looked up."""
        cut = [self.stretches(self.library.normalize(text)) if text else [] for text in texts]
        if len(self.known) > KEPT // 2:
            self.older, self.known = self.known, {}
        known, older, long = self.known, self.older, []
        for stretch in set().union(*cut).difference(known):
            known[stretch] = older.get(stretch) or array("i", self.ids_of(stretch)).tobytes()
            if len(stretch) > LONGEST:
                long.append(stretch)
        end = array("i", [self.end_id]).tobytes()
        found = [array("i", b"".join([*map(known.__getitem__, stretches), end])).tolist() for stretches in cut]
        for stretch in long:
            del known[stretch]
        return found

    def spelt(self, ids: list[int]) -> str:
        """Ids in decimal, joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(model_file: str = MODEL) -> PieceBpe:
    """One per worker process."""
    return PieceBpe(model_file)


SLICE = 256


def encode_documents(docs: DataFrame, model_file: str = MODEL, with_ids: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, ids (array of int, null without with_ids), ids_sha256, decoded_sha256.

    ids are the library's with an end id and without sampling, in n_tokens and both digests too.
    decoded_sha256 is the digest of what the model's decode(ids) gives, in UTF-8; ids_sha256 that
    of the decimal ids joined by one space. Null and empty texts have the end id alone. Null ids
    and repeated rows are kept; other columns are ignored; texts of any length are encoded whole;
    an empty table gives an empty result. The model file lies at the same place on every executor.
    """

    def run(batches):
        bpe = encoder(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = bpe.encode_many(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array(ids if with_ids else [None] * len(ids), pa.list_(pa.int32())),
                        pa.array([sha256_hex(bpe.spelt(i).encode()) for i in ids]),
                        pa.array([sha256_hex(bpe.decode(i).encode()) for i in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
