"""Text expressions: entities, whitespace, attributes, words, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities decoded in text and attributes; "&amp;" comes last.
ENTITIES = [
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&middot;", "·"), ("&bull;", "•"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&times;", "×"), ("&deg;", "°"), ("&euro;", "€"), ("&yen;", "¥"), ("&amp;", "&"),
]
BLANKS = " \t\n\r\f\x0b\u00a0\u3000"
# The Chinese and English punctuation marks that are counted.
PUNCTUATION = "！，。？、；：“”‘’《》%（）,.?:;'\"!()"


def _decode_numeric(text: Column) -> Column:
    """Decode decimal and hexadecimal character references."""
    pieces = F.split(text, "&#")

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 0)
        code = F.when(
            F.lower(F.substring(number, 1, 1)) == "x",
            F.conv(F.regexp_extract(number, r"([0-9A-Fa-f]+);", 1), 16, 10).cast("bigint"),
        ).otherwise(F.regexp_extract(number, r"([0-9]+);", 1).cast("bigint"))
        valid = (number != "") & (code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF))
        safe = F.when(valid, code).otherwise(F.lit(32))
        char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.substring(piece, F.length(number) + 1, F.length(piece)))).otherwise(
            F.concat(F.lit("&#"), piece)
        )

    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), decoded)
    return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))


def decode_entities(text: Column) -> Column:
    """Decode the entities above; texts without an ampersand are left alone."""
    named = F.when(F.contains(text, F.lit("&#")), _decode_numeric(text)).otherwise(text)
    for name, value in ENTITIES:
        named = F.replace(named, F.lit(name), F.lit(value))
    return F.when(F.contains(text, F.lit("&")), named).otherwise(text)


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse_text(text: Column) -> Column:
    """Trim, squeeze runs of spaces, remove newlines."""
    return F.translate(F.regexp_replace(strip_blanks(text), " +", " "), "\n", "")


def count_punctuation(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag, null when absent."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.when(found != "", F.regexp_replace(found, r"""^["']|["']$""", ""))


def words(text: Column) -> Column:
    """Lower-cased runs of two or more word characters; bigrams inside Chinese runs."""
    plain = F.regexp_replace(F.lower(text), "[一-龥]", " ")
    runs = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    chinese = F.regexp_extract_all(text, F.lit("[一-龥]{2,}"), F.lit(0))
    pairs = F.flatten(
        F.transform(
            chinese,
            lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda at: F.substring(run, at, F.lit(2))),
        )
    )
    return F.concat(runs, pairs)


def square_sum(sorted_words: Column) -> Column:
    """Sum of the squared word counts of a sorted word array.

    A run of k equal words adds 1 + 3 + … + (2k - 1) = k².
    """
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("total"))

    def step(state: Column, word: Column) -> Column:
        run = F.when(word == state["word"], state["run"] + 1).otherwise(F.lit(1))
        return F.struct(word.alias("word"), run.alias("run"), (state["total"] + 2 * run - 1).cast("bigint").alias("total"))

    return F.aggregate(sorted_words, start, step, lambda state: state["total"])
