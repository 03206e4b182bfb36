import gzip
import hashlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from pagemine.llm import warc_index as warc
from tests.llm.conftest import by_row


def pages_rows():
    rows = [(i, f"http://www.Host{i % 3}.example.com:80{i % 2}/p/{i % 25}?q={i % 2}", f"<p>page {i}</p>" * (1 + i % 200)) for i in range(400)]
    rows += [(1000 + i, "http://hot.example/same", "<p>copy</p>" * 200) for i in range(50)]
    rows += [(2000, "http://a.example/", "short"), (2001, "http://b.example/", "short"), (2002, None, None), (None, "http://c.example/", "<p>copy</p>" * 200)]
    rows += [(2003, "", ""), (2004, "http://ü.example/x\ty\r\nInjected: 1", "漢🙂" * 400), (2005, "not a url", "x" * 999), (2006, "http://[bad", "y" * 1000), (2007, "http://big.example/", "z" * 3_000_000)]
    return [*rows, rows[0], rows[0]]


def brute(rows):
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            last[data] = max(x for x in (last.get(data), i, -1) if x is not None)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = last.get(data)
        kind = "response" if first is None or i == first else "revisit"
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, first if kind == "revisit" else None))
    return out


@pytest.mark.parametrize(("lines", "archive"), [(300, 1 << 28), (7, 20_000)])
def test_every_capture_comes_back(spark, tmp_path, lines, archive):
    rows = pages_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    captures = warc.write_archives(pages, str(tmp_path), archive_bytes=archive)
    directory = warc.write_index(captures, str(tmp_path), block_lines=lines)
    got = warc.read_captures(pages, directory, str(tmp_path))
    assert by_row(got.drop("url").collect()) == by_row(brute(rows))


def test_files_are_warc_and_the_index_is_sorted(spark, tmp_path):
    rows = pages_rows()[:60]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write_archives(pages, f"file://{tmp_path}")
    directory = warc.write_index(captures, f"file://{tmp_path}", block_lines=9)
    names = [p.name for p in tmp_path.iterdir()]
    found = []
    for name in names:
        if name.endswith(".warc.gz"):
            data = gzip.decompress((tmp_path / name).read_bytes())
            assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
            found.append(data.count(b"WARC/1.1\r\n"))
    assert sum(found) == len(rows)
    known = warc.read_directory(directory)
    assert len(known.firsts) >= 60 // 9 and known.firsts == sorted(known.firsts)
    system, base = warc.open_folder(str(tmp_path))
    keys = []
    for name, offset, length in known.blocks:
        keys += [warc._order(c[0], c[1]) for c in warc._captures_of_block(warc._read(system, {}, f"{base}/{name}", offset, length))]
    assert keys == sorted(keys) and len(keys) == 60
    assert isinstance(system, fs.LocalFileSystem)


def test_lookup_of_one_url(spark, tmp_path):
    rows = pages_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.write_index(warc.write_archives(pages, str(tmp_path)), str(tmp_path), block_lines=5)
    known = warc.read_directory(directory)
    hits = warc.find_url(known, str(tmp_path), "http://hot.example/same")
    assert sorted(h["WARC-Record-ID"] for h, _ in hits) == sorted(f"<urn:page:{1000 + i}>" for i in range(50))
    assert sorted(h["WARC-Type"] for h, _ in hits) == ["response"] + ["revisit"] * 49
    assert warc.find_url(known, str(tmp_path), "http://nowhere.example/") == []


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.COM:8080/A/b?Q=1#f") == "com,example,www:8080)/a/b?q=1"
    assert warc.url_key("http://example.com") == "com,example)/" and warc.url_key(None) == "" and warc.url_key("odd") == "odd"


def test_directory_stays_within_its_bound(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", "x") for i in range(200)], "page_id long, url string, html string")
    directory = warc.write_index(warc.write_archives(pages, str(tmp_path)), str(tmp_path), block_lines=1, directory_lines=10)
    assert directory.count() <= 10 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(empty, str(tmp_path)).collect() == []


def test_reading_takes_as_many_tasks_as_the_directory_asks_for(spark, tmp_path):
    pages = spark.createDataFrame(pages_rows(), "page_id long, url string, html string")
    directory = warc.write_index(warc.write_archives(pages, str(tmp_path)), str(tmp_path), block_lines=7)
    got = warc.read_captures(pages, directory, str(tmp_path))
    tasks = got.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks >= min(4, spark.sparkContext.defaultParallelism)
