import hashlib
import zlib

import pytest
from feedloom.llm import warc
from pyspark.sql import functions as F

PAGE = "<p>" + "page " * 60 + "</p>"
ROWS = [
    (7, "http://www.A.example.org/x?y=1#z", PAGE), (3, "https://a.example.org:443/x?y=1", PAGE), (9, None, PAGE), (None, "not an address", PAGE),
    (4, "ftp://b.example.org/with blank\r\nand: break", "short"), (5, "http://b.example.org", "short"), (6, "http://b.example.org/", None),
    (8, "http://b.example.org/é", "é" * 50), (10, "http://b.example.org/long", "x" * 3_000_000), (10, "http://b.example.org/long", "x" * 3_000_000),
    (11, "http://b.example.org/blank", ""), (12, "http://c.example.org/", "a" * 99), (13, "http://c.example.org/", "a" * 99),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("payload", F.lit(1))


def brute(rows):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 100 and page is not None:
            first[digest(html)] = min(page, first.get(digest(html), page))
    out = []
    for page, _, html in rows:
        refers = first.get(digest(html), page)
        refers = None if refers == page else refers
        out.append((page, len((html or "").encode()), digest(html), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_records_come_back_through_the_index(spark):
    archive = warc.write_archive(pages(spark, ROWS).repartition(3), block_lines=2, file_bytes=2_000)
    records = warc.read_archive(archive)
    assert found(records) == brute(ROWS)
    texts = {r.page_id: r.payload for r in records.collect()}
    assert texts[10] == b"x" * 3_000_000 and texts[7] is None and texts[3] == PAGE.encode() and texts[6] == b""
    assert archive.captures.select("file").distinct().count() > 1


def test_files_are_plain_warc(spark):
    archive = warc.write_archive(pages(spark, ROWS).coalesce(1))
    (name,) = {r.file for r in archive.captures.select("file").collect()}
    text = zlib.decompressobj(31)
    whole, rest = b"", open(name, "rb").read()
    members = 0
    while rest:
        text = zlib.decompressobj(31)
        whole += text.decompress(rest)
        rest, members = text.unused_data, members + 1
    assert members == len(ROWS) + 1 and whole.count(b"WARC/1.1\r\n") == members
    assert b"WARC-Target-URI: ftp://b.example.org/with%20blank%0D%0Aand:%20break\r\n" in whole
    assert b"WARC-Refers-To: <urn:x-page:3>\r\n" in whole


def test_lookup_of_some_addresses(spark):
    archive = warc.write_archive(pages(spark, ROWS).repartition(4), block_lines=1)
    ask = spark.createDataFrame([(warc.sort_key(u),) for u in ("https://a.example.org/x?y=1", "http://c.example.org", "http://none.example.org/", None)] * 2, "key string")
    assert sorted((r.page_id for r in warc.lookup(archive, ask).collect()), key=str) == sorted([7, 3, 12, 13, 9, None], key=str)


def test_one_address_over_many_parts(spark):
    rows = [(i, "http://hot.example.org/", f"{i} {PAGE}") for i in range(400)] + [(1000 + i, f"http://h{i}.example.org/", PAGE) for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archive = warc.write_archive(pages(spark, rows).repartition(5), block_lines=7)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = archive.parts.filter(F.col("last") >= warc.sort_key(rows[0][1])).filter(F.col("first") <= warc.sort_key(rows[0][1]))
    assert hot.count() > 1
    ask = spark.createDataFrame([(warc.sort_key(rows[0][1]),)], "key string")
    assert sorted(r.page_id for r in warc.lookup(archive, ask).collect()) == list(range(400))
    assert found(warc.read_archive(archive)) == brute(rows)


def test_changed_bytes_are_noticed(spark):
    head = {"WARC-Record-ID": "<urn:x-page:1>", "WARC-Payload-Digest": "sha256:" + "0" * 64}
    with pytest.raises(ValueError, match="not what its header says"):
        warc._record_row(warc._packed(warc._record("response", head, b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody")))


def test_empty_table_and_keys(spark):
    archive = warc.write_archive(pages(spark, ROWS).filter("false"))
    assert warc.read_archive(archive).count() == 0
    assert warc.sort_key("HTTP://user@www.Example.org:80?q") == "org,example)/?q" and warc.sort_key("") == "-"
