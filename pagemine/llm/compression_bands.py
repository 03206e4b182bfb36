"""Quality rules by compression bands.

Natural prose compresses to a fairly narrow band of ratios (compressed / raw bytes), which
narrows and sinks as texts grow. Repetitive text lies below its band, random or encoded
matter above. The whole text is held against the limits for its length, and its chunks of
fixed size, the text's last bytes included, against the chunk limits, so that a repetitive or
encoded third cannot hide in a long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
CHUNK_BYTES = 2048
#: (bytes below which the row holds, lowest ratio, highest ratio) of whole texts. The highest ratios of prose measured
#: (sf0.1 and English license texts) are 0.75 from 256 bytes, 0.63 from 1 kB, 0.56 from 2 kB, 0.46 from 8 kB; hex has 0.51,
#: random words 0.59, base64 0.75 of long texts. Below 8 kB hex cannot be told from prose by its ratio. The lowest are 0.02 under
#: the 0.5 % quantile of prose labelled good (half of sf0.1, by id): 0.515, 0.481, 0.431, 0.414, and 0.03 under it from 8 kB,
#: as ratios go on sinking; longer prose was not measured and keeps a wide band.
BANDS = ((256, 0.40, 1.10), (1024, 0.495, 0.85), (2048, 0.46, 0.70), (8192, 0.41, 0.60), (32768, 0.384, 0.50), (float("inf"), 0.22, 0.50))
#: Where less than PLAIN of the bytes are ASCII: letters of several bytes carry more each, and their leading bytes repeat.
WIDER, DEEPER, PLAIN = 0.05, 0.15, 0.9
#: Limits of a chunk, and the share of chunks outside above which a text is rejected. No chunk of sf0.1's prose is outside.
CHUNK_BAND, CHUNKS_OUT = (0.20, 0.60), 0.2

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
ASCII = bytes(range(128))
SLICE = 512


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which occurs twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # windows numbered pair by pair, so that no product overflows
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").split()]
    return len(lines) - len(set(lines))


class Bands:
    """Compression ratios of a text and what they say."""

    def __init__(self, level: int = LEVEL, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band=CHUNK_BAND, chunks_out: float = CHUNKS_OUT):
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.bands, self.chunk_bytes, self.chunk_band, self.chunks_out = bands, chunk_bytes, chunk_band, chunks_out

    def judge(self, data: bytes) -> tuple[float | None, float, str | None]:
        """(ratio, share of chunks outside their limits, reason to reject or None)."""
        if not data:
            return None, 0.0, "empty"
        ratio = len(self.compress(data)) / len(data)
        low, high = next((low, high) for below, low, high in self.bands if len(data) < below)
        plain = data.isascii() or len(data.translate(None, ASCII)) <= (1 - PLAIN) * len(data)
        wider, deeper = (0.0, 0.0) if plain else (WIDER, DEEPER)
        size = self.chunk_bytes
        starts = list(range(0, len(data) - size + 1, size))
        if starts and len(data) % size:
            starts.append(len(data) - size)
        chunks = [len(self.compress(data[at : at + size])) / size for at in starts]
        out = sum(not self.chunk_band[0] <= r <= self.chunk_band[1] + wider for r in chunks) / len(chunks) if chunks else 0.0
        if ratio < low - deeper:
            return ratio, out, "repetitive"
        if ratio > high + wider:
            return ratio, out, "incompressible"
        return ratio, out, "chunks" if out > self.chunks_out else None


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunks_out double, reason string"
)


def measures(text: str | None, bands: Bands) -> tuple:
    """The columns of SCHEMA after doc_id."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    joined = b"".join(words)
    # code points are the bytes that do not continue a character
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > 50 * len(words)
    ratio, out, reason = bands.judge(data)
    return len(words), chars, symbols, repeated_lines(text), repeats, failed, not failed and reason is None, ratio, out, reason


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs(doc_id, text): the columns of SCHEMA.

    Words are [^\\x20\\x09-\\x0D]+. base_failed: fewer than 50 words, or over half of the words in
    repeated 3-word windows. kept is false then, else whether the compression bands accept the
    text; reason says which band rejects it (empty, repetitive, incompressible, chunks). Null and
    empty texts have no words and fail. Null ids and repeated rows are kept; other columns are
    ignored; long texts are read whole; an empty table gives an empty result.
    """

    def run(batches):
        bands = Bands(**options)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [measures(text, bands) for text in part.column("text").to_pylist()]
                columns = list(zip(*found, strict=True)) if found else [()] * 10
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
                names = [field.split()[0] for field in SCHEMA.split(", ")]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, columns, **options) -> DataFrame:
    """The rows of docs that the rules keep, with the given columns: judged row by row, nothing is shuffled."""
    kept_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches):
        bands = Bands(**options)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keep = [measures(text, bands)[6] for text in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.select(*columns).mapInArrow(run, kept_schema)
