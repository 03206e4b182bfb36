"""WARC archives with a two-level capture index.

Archives are files of gzip members, one member per record, written by tasks through
pyarrow's file systems (local, HDFS, S3, GCS) under names no other attempt can have; the table
of captures that the write returns lists the files that count, so what a lost attempt left
behind is never read. The index holds a line per capture, sorted by reversed-host URL key, in
compressed blocks; a sparse directory keeps the first key of every block. A lookup finds its
block by binary search in the directory, reads that range, finds its line by binary search,
and reads the record's range of the archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import shared_folder, staged

#: Payloads of fewer bytes are stored every time.
MIN_REVISIT = 1000
#: Bytes after which a new archive begins; lines of an index block; the directory's largest length.
ARCHIVE_BYTES, BLOCK_LINES, DIRECTORY_LINES = 256 << 20, 300, 1 << 18
DATE = "2026-01-01T00:00:00Z"
LEVEL = 6
SLICE = 256


def url_key(url: str | None) -> str:
    """Reversed host, port and path of a URL, lower-cased: com,example,www)/path?query. Odd URLs are keys as they are."""
    url = url or ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return url.strip().lower()
    turned = ",".join(reversed(host.rstrip(".").split(".")))
    query = f"?{parts.query}" if parts.query else ""
    return f"{turned}{f':{port}' if port else ''}){(parts.path or '/').lower()}{query.lower()}"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", "", text)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record as a gzip member. A revisit has no payload of its own, but its length and digest."""
    body = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode("utf-8", "surrogatepass")
    return gzip.compress(head + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record and Content-Length differ")
    return headers, rest[:size]


def _page_id(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _read(system: fs.FileSystem, files: dict, path: str, offset: int, length: int) -> bytes:
    """A range of a file; the last few files stay open."""
    if path not in files:
        if len(files) >= 16:
            files.pop(next(iter(files))).close()
        files[path] = system.open_input_file(path)
    return files[path].read_at(length, offset)


def payload_digest(html: Column) -> Column:
    return F.sha1(F.encode(F.coalesce(html, F.lit("")), "UTF-8"))


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, url, html) with digest and refers_to: the largest page_id of its payload, where that is another's.

    Only digests that occur again are joined back, as a table of two columns.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", payload_digest(F.col("html")))
    large = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    again = staged(large.where("n > 1").select("digest", "last"), "payloads")
    joined = rows.join(again, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("last") != F.coalesce("page_id", F.lit(-(2**63))), F.col("last")).alias("refers_to"))


CAPTURE = "key string, page_id long, archive string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) into archives in `folder`; returns the captures, staged.

    Null html is an empty payload. Of equal payloads of at least min_bytes bytes, the row with the
    largest page_id is the response, others are revisits that refer to it (a null id is smaller than
    any; rows that repeat the largest id are responses too).
    """

    def write(batches):
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = []
                for page_id, url, source, digest, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    payload = source.encode("utf-8", "surrogatepass")
                    member = record("response" if refers_to is None else "revisit", page_id, url, payload, digest, refers_to)
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return staged(with_revisits(pages, min_bytes).mapInArrow(write, CAPTURE), "captures")


def _order(key: str, page_id: int | None) -> tuple[str, int]:
    return key, -(2**63) if page_id is None else page_id


def _line(key: str, page_id: int | None, archive: str, offset: int, length: int) -> str:
    shown = key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    return f"{shown}\t{'' if page_id is None else page_id}\t{archive}\t{offset}\t{length}"


_SPECIAL = {"\\\\": "\\", "\\t": "\t", "\\n": "\n", "\\r": "\r"}


def _capture(line: str) -> tuple[str, int | None, str, int, int]:
    key, page_id, archive, offset, length = line.split("\t")
    key = re.sub(r"\\[\\tnr]", lambda m: _SPECIAL[m[0]], key) if "\\" in key else key
    return key, int(page_id) if page_id else None, archive, int(offset), int(length)


DIRECTORY = "first_key string, first_id long, file string, offset long, length long, lines long"


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, directory_lines: int = DIRECTORY_LINES) -> DataFrame:
    """Sort captures by (key, page_id), write compressed blocks, return the sparse directory, staged.

    Rows are range-partitioned by key and id, so a host or URL with very many captures spans
    partitions and blocks. Blocks grow beyond block_lines only as far as needed to keep the
    directory within directory_lines entries: that bound is what lets readers hold it.
    """
    total = captures.count()
    lines_each = max(block_lines, -(-total // directory_lines))
    order = [F.col("key").asc(), F.coalesce("page_id", F.lit(-(2**63))).asc()]
    partitions = max(1, min(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * lines_each))))
    ranged = captures.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def blocks(batches):
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        name, out, at, held, entries = f"{uuid.uuid4().hex}.index.gz", None, 0, [], []

        def flush():
            nonlocal out, at
            if out is None:
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            packed = gzip.compress("\n".join(_line(*c) for c in held).encode("utf-8", "surrogatepass"), LEVEL, mtime=0)
            out.write(packed)
            entries.append((held[0][0], held[0][1], name, at, len(packed), len(held)))
            at += len(packed)
            held.clear()

        for batch in batches:
            for capture in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "length")), strict=True):
                held.append(capture)
                if len(held) >= lines_each:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array([e[i] for e in entries], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["first_key", "first_id", "file", "offset", "length", "lines"])

    return staged(ranged.mapInArrow(blocks, DIRECTORY), "directory")


class Directory:
    """The sparse directory, in key order: which blocks can hold a key."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: _order(r[0], r[1]))
        self.blocks = [tuple(r[2:5]) for r in rows]
        self.firsts = [_order(r[0], r[1]) for r in rows]

    def block_of(self, key: str, page_id: int | None) -> int | None:
        """The block in which a capture must stand, by binary search."""
        at = bisect.bisect_right(self.firsts, _order(key, page_id)) - 1
        return at if at >= 0 else None

    def blocks_of(self, key: str) -> range:
        """All blocks that can hold captures of a URL key."""
        low = bisect.bisect_left(self.firsts, (key, -(2**63) - 1)) - 1
        high = bisect.bisect_right(self.firsts, (key, 2**63))
        return range(max(0, low), high)


def read_directory(directory: DataFrame) -> Directory:
    """At most directory_lines rows, by construction."""
    rows = directory.select("first_key", "first_id", "file", "offset", "length").toArrow()
    return Directory(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)))


def _captures_of_block(packed: bytes) -> list[tuple]:
    return [_capture(line) for line in zlib.decompress(packed, 31).decode("utf-8", "surrogatepass").split("\n")]


def find_url(directory: Directory, folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All records of one URL, for interactive use: binary searches and range reads only."""
    system, base = open_folder(folder)
    files: dict = {}
    key, found = url_key(url), []
    for number in directory.blocks_of(key):
        name, offset, length = directory.blocks[number]
        captures = _captures_of_block(_read(system, files, f"{base}/{name}", offset, length))
        keys = [c[0] for c in captures]
        for capture in captures[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
            found.append(parse_record(_read(system, files, f"{base}/{capture[2]}", capture[3], capture[4])))
    return found


#: Index blocks a task of the reading stage looks up, on clusters of fewer cores than that gives tasks.
BLOCKS_A_TASK = 8

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The records of wanted(page_id, url), each found through the index: page_id, url, and what its headers and body say.

    A capture is wanted as often as it is named, and a URL and id archived several times gives
    every record once. A response's length and digest are computed from the body read back and
    must be those in its headers.
    """
    spark = wanted.sparkSession
    known_blocks = read_directory(directory)
    shared = spark.sparkContext.broadcast(known_blocks)

    def place(batches):
        known = shared.value
        for batch in batches:
            keys = [url_key(u) for u in batch.column("url").to_pylist()]
            ids = batch.column("page_id").to_pylist()
            numbers = [known.block_of(k, i) for k, i in zip(keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(keys), batch.column("page_id")], names=["block", "key", "page_id"])

    def fetch(key, table):
        system, base = open_folder(folder)
        files: dict = {}
        known = shared.value
        number = key[0].as_py()
        rows = []
        if number is not None:
            asked = sorted({_order(k, i) for k, i in zip(table.column("key").to_pylist(), table.column("page_id").to_pylist(), strict=True)})
            # equal captures may run over into the blocks before and after
            last = number
            while last + 1 < len(known.firsts) and known.firsts[last + 1] <= asked[-1]:
                last += 1
            first = number
            while first > 0 and known.firsts[first] == asked[0]:
                first -= 1
            captures = []
            for at in range(first, last + 1):
                name, offset, length = known.blocks[at]
                captures += _captures_of_block(_read(system, files, f"{base}/{name}", offset, length))
            orders = [_order(c[0], c[1]) for c in captures]
            hits = [c for one in asked for c in captures[bisect.bisect_left(orders, one) : bisect.bisect_right(orders, one)]]
            for capture in sorted(hits, key=lambda c: (c[2], c[3])):
                headers, body = parse_record(_read(system, files, f"{base}/{capture[2]}", capture[3], capture[4]))
                rows.append(_facts(headers, body))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [f.split()[0] for f in RECORD.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    places = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(place, "block int, key string, page_id long")
    # a few bytes name a capture, while reading it is the work: the directory's size says how many tasks, not the rows'
    blocks = len(known_blocks.blocks)
    tasks = max(1, min(blocks, max(spark.sparkContext.defaultParallelism, -(-blocks // BLOCKS_A_TASK))))
    return places.repartition(tasks, "block").groupBy("block").applyInArrow(fetch, RECORD)


def _facts(headers: dict[str, str], body: bytes) -> tuple:
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if headers["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, size):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    refers_to = _page_id(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
    return _page_id(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], refers_to


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all rows of pages(page_id, url, html) as archives with an index, then read every capture back through it.

    Returns the columns of RECORD, a row per record. The archives lie in a new folder under the
    shared one unless `folder` names another. Repeated rows are archived each; null urls have the
    key ''; other columns are ignored; an empty table gives an empty result.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    captures = write_archives(pages, folder, **options)
    directory = write_index(captures, folder)
    return read_captures(pages, directory, folder)
