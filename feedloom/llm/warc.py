"""WARC archives of pages, and their two-level capture index.

Each task writes its pages as WARC records, one gzip member each, into files of its own. Payloads of at least
``LEAST_BYTES`` that occur more than once are stored with the smallest page_id; the others become revisit records
that name it. Digests are counted before anything is written, so pages move only if the repeated digests are too
many to send out.

The index has a line per capture, sorted by reversed host and path. Range partitions of it become parts:
compressed blocks of lines, then a sparse directory with the first key of each block, both in one file. A lookup
finds the parts that can hold a key (one row a part, written by one task each), a binary search in the part's directory
finds its first block, and blocks are read by byte range until the key is passed. The page is part of the sort
order, so the captures of a very common address lie in many parts. Records are then read by byte range, file by
file, neighbouring ones in one read, and checked against their digest.

Files go to the shared staging folder under names no other task uses, and count only if the written table of
captures or parts names them: an attempt that fails or runs twice leaves nothing that is read.

Edge cases: a null page is an empty payload; a null or odd address is indexed under ``-``; rows without a page_id
revisit a payload that has one and are responses otherwise; rows that repeat page_id and payload are written once
each, as responses if theirs is the smallest page_id; blanks and control characters in addresses are percent-coded in
the records; an empty table gives an archive without captures; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import sized
from feedloom.plans.staging import stage, staging_root

# The shortest payload that is revisited; lines of an index block; bytes of a file, a read and a task.
LEAST_BYTES, BLOCK_LINES, FILE_BYTES, READ_BYTES, TASK_BYTES = 100, 2_000, 1 << 30, 4 << 20, 64 << 20
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)")
_PORT = re.compile(r":(?:80|443)?$")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class Archive(NamedTuple):
    """The captures (key, page_id, file, offset, length) and the parts of their index."""

    captures: DataFrame
    parts: DataFrame


def sort_key(url: str | None) -> str:
    """Reversed host and path of an address: ``http://www.A.org/x?y#z`` -> ``org,a)/x?y``; ``-`` for what is none."""
    found = _URL.match(url or "")
    if not found or not found[1]:
        return "-"
    host = _PORT.sub("", found[1].lower()).removeprefix("www.")
    path = found[2] if found[2].startswith("/") else f"/{found[2]}"
    return f"{','.join(reversed(host.split('.')))}){path}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _packed(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in headers.items() if value is not None]
    head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def _page_name(page) -> str:
    return f"<urn:x-page:{'-' if page is None else page}>"


def _page_record(page, url, payload: bytes, digest: str, refers, date: str) -> bytes:
    safe = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": _page_name(page),
        "WARC-Date": date,
        "WARC-Target-URI": safe,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers is None:
        return _record("response", headers, http + payload)
    headers |= {"WARC-Refers-To": _page_name(refers), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return _record("revisit", headers, http)


def _capture_rows(root: str, date: str, file_bytes: int):
    """Write records; (key, page_id, file, offset, length) of each."""

    def write(batches):
        store, folder = _store(root)
        out, name = None, None
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers")), strict=True):
                    if out is None or out.tell() >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(name, compression=None)
                        out.write(_packed(_record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                    record = _packed(_page_record(page, url, payload, digest, refers, date))
                    rows.append((sort_key(url), page, name, out.tell(), len(record)))
                    out.write(record)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CAPTURE.values(), strict=True)], list(_CAPTURE))
        finally:
            if out is not None:
                out.close()

    return write


_CAPTURE = {"key": pa.string(), "page_id": pa.int64(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}
_CAPTURE_ROW = "key string, page_id long, file string, offset long, length long"


def _part_rows(root: str, block_lines: int):
    """Sorted captures -> one index part: blocks, then their directory; (first, last, file, offset, length) of the directory."""

    def write(batches):
        store, folder = _store(root)
        name = f"{folder}/{uuid.uuid4().hex}.cdx.gz"
        out, lines, directory, first, last = None, [], [], None, None

        def close_block():
            block = _packed("\n".join(json.dumps(line) for line in lines).encode())
            directory.append((lines[0][0], out.tell(), len(block)))
            out.write(block)
            lines.clear()

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in _CAPTURE), strict=True):
                if out is None:
                    out, first = store.open_output_stream(name, compression=None), line[0]
                last = line[0]
                lines.append(line)
                if len(lines) >= block_lines:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            packed, at = _packed(json.dumps(directory).encode()), out.tell()
            out.write(packed)
            out.close()
            row = [pa.array([first]), pa.array([last]), pa.array([name]), pa.array([at]), pa.array([len(packed)])]
            yield pa.RecordBatch.from_arrays(row, ["first", "last", "file", "offset", "length"])

    return write


def write_archive(pages: DataFrame, block_lines: int = BLOCK_LINES, file_bytes: int = FILE_BYTES) -> Archive:
    """Write every page as a WARC record and index the records by address."""
    spark = pages.sparkSession
    root = f"{staging_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, folder = _store(root)
    store.create_dir(folder, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_ones = rows.filter(F.octet_length("payload") >= LEAST_BYTES)
    repeated = long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = sized(stage(repeated.select("digest", "first"), "warc-repeated"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers")
    marked = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", refers)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    captures = stage(marked.mapInArrow(_capture_rows(root, date, file_bytes), _CAPTURE_ROW), "warc-captures")
    order = ["key", "page_id", "file", "offset"]
    parts = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.mapInArrow(_part_rows(root, block_lines), "first string, last string, file string, offset long, length long")
    return Archive(captures, stage(parts, "warc-parts"))


def _read(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _found(root: str):
    """(part, key) sorted, ``part`` being file, offset and length of a directory -> the captures with these keys."""

    def find(batches):
        store, _ = _store(root)
        open_part, handle, directory, firsts, block_at, block = None, None, [], [], -1, []
        for batch in batches:
            rows: list[list] = []
            for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if part != open_part:
                    open_part, block_at = part, -1
                    handle = store.open_input_file(part["file"])
                    directory = json.loads(_unpacked(_read(handle, part["offset"], part["length"])))
                    firsts = [entry[0] for entry in directory]
                at = max(bisect_left(firsts, key) - 1, 0)
                while at < len(firsts) and firsts[at] <= key:
                    if at != block_at:
                        block_at, data = at, _unpacked(_read(handle, directory[at][1], directory[at][2]))
                        block = [json.loads(line) for line in data.decode().split("\n")]
                    start = bisect_left(block, key, key=lambda line: line[0])
                    while start < len(block) and block[start][0] == key:
                        rows.append(block[start])
                        start += 1
                    if len(rows) >= BLOCK_LINES:
                        yield _captures(rows)
                        rows = []
                    at += 1
            yield _captures(rows)

    return find


def _captures(rows):
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_CAPTURE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CAPTURE.values(), strict=True)], list(_CAPTURE))


_PART = pa.struct([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _routed(parts: list[dict]):
    """(part, key): every key with the parts of the index that can hold it."""
    lasts = [p["last"] for p in parts]

    def route(batches):
        for batch in batches:
            where, keys = [], []
            for key in batch.column("key").to_pylist():
                at = bisect_left(lasts, key)
                while at < len(parts) and parts[at]["first"] <= key:
                    where.append({c: parts[at][c] for c in ("file", "offset", "length")})
                    keys.append(key)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(where, _PART), pa.array(keys, pa.string())], ["part", "key"])

    return route


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """The captures of the sort keys in ``keys.key``, by the index alone; each distinct key once."""
    spark = keys.sparkSession
    # One row for each task that wrote the index.
    parts = [r.asDict() for r in archive.parts.orderBy("last", "first", "file").collect()]
    routed = keys.select("key").distinct().mapInArrow(_routed(parts), "part struct<file: string, offset: long, length: long>, key string")
    # Few narrow rows stand for many blocks to be read, so their number of partitions is given.
    in_order = routed.repartition(max(1, len(parts)), "part").sortWithinPartitions("part", "key")
    return in_order.mapInArrow(_found(staging_root(spark)), _CAPTURE_ROW)


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


_RECORD = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
}


def _page_number(name: str | None) -> int | None:
    number = (name or ":-").strip("<>").rpartition(":")[2]
    return None if number == "-" else int(number)


def _record_row(data: bytes) -> tuple:
    headers, block = _parsed(_unpacked(data))
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not what its header says")
    page, refers = _page_number(headers["WARC-Record-ID"]), _page_number(headers.get("WARC-Refers-To"))
    return page, headers.get("WARC-Target-URI"), kind, refers, payload if kind == "response" else None, size, digest


def _records(root: str, read_bytes: int):
    """(file, offset, length) sorted -> the records there; neighbours are read together."""

    def read(batches):
        store, _ = _store(root)
        opened, handle = None, None
        for batch in batches:
            spans = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(spans):
                file, begin, length = spans[at]
                end, last = begin + length, at + 1
                while last < len(spans) and spans[last][0] == file and spans[last][1] == end and end - begin < read_bytes:
                    end, last = end + spans[last][2], last + 1
                if file != opened:
                    opened, handle = file, store.open_input_file(file)
                data = memoryview(_read(handle, begin, end - begin))
                rows = [_record_row(bytes(data[o - begin : o - begin + n])) for _, o, n in spans[at:last]]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RECORD.values(), strict=True)], list(_RECORD))
                at = last

    return read


def fetch(captures: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records of the captures: page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest."""
    order = ["file", "offset"]
    spark = captures.sparkSession
    spans = stage(captures.select("file", "offset", "length"), "warc-spans")
    # Narrow rows stand for records to be read: partitions of so many bytes of these, or one a core.
    tasks = max(spark.sparkContext.defaultParallelism, (spans.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    spans = spans.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    return spans.mapInArrow(_records(staging_root(spark), read_bytes), schema)


def read_archive(archive: Archive) -> DataFrame:
    """All records of an archive, found through the index under every address it holds."""
    return fetch(lookup(archive, archive.captures.select("key")))
