"""Exact removal of repeated byte strings by a distributed merge sort of front-coded suffixes.

A byte goes if a string of ``width`` bytes that covers it also starts earlier (smaller doc_id, or the
same document further left). Strings are judged on the input and never cross documents.

Sorting every suffix of a corpus is out of reach, and most suffixes have no equal. The 32-byte grams
of each window of ``width`` bytes name an anchor, the leftmost gram of least hash, so equal windows
have the same anchor at the same place, and neighbouring windows mostly share theirs: a document
falls into spans of windows with one anchor. Only spans whose anchor gram occurs twice can hold a
repeat. Their suffixes (cut at the span's last window, with the anchor's hash in front) are sorted
in runs by the map tasks, runs are front-coded (bytes shared with the line before, then the rest)
and exchanged, and each receiving task combines its runs with a loser tree. The tree compares the
lengths of the prefixes known to be shared with the last line put out, and bytes only beyond them.
Lines shared in full are repeats; where one anchor has different spans, their windows are compared.

Copies within a run are folded before the exchange, so a passage that a third of all documents hold
arrives once per run. An anchor with more than ``crowd`` different spans is not compared in one task:
its windows are dealt out by their content.

Edge cases: a null text has no bytes; texts shorter than ``width`` stay; rows without a doc_id stay
whole and hide nothing; rows that repeat a doc_id must repeat its text and share its fate; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from struct import pack, unpack_from

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import sized
from feedloom.llm.simhash import _last_run
from feedloom.plans.staging import stage

# Bytes of a repeat and of an anchor gram; the odd base of the rolling hash.
WIDTH, GRAM = 100, 32
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_RUN_LINES = 50_000
_PLACE = "<qq"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.cumprod(np.full(n, _BASE, "uint64")) * np.uint64(inverse)
    down = np.cumprod(np.full(n, inverse, "uint64")) * np.uint64(_BASE)
    return up, down


_UP, _DOWN = _powers(_PIECE + (1 << 16))


def spans(data: np.ndarray, valid: np.ndarray, width: int = WIDTH):
    """(anchor hash, first window, windows) of every span in a piece of at most _PIECE bytes and a margin.

    ``valid`` tells for each window start whether the window lies in one document.
    """
    grams = width - GRAM + 1
    n = len(data)
    none = np.zeros(0, "int64")
    if n < width or not valid.any():
        return none, none, none
    total = np.concatenate([np.zeros(1, "uint64"), np.cumsum((data.astype("uint64") + np.uint64(1)) * _UP[:n])])
    value = (total[GRAM:] - total[:-GRAM]) * _DOWN[: n - GRAM + 1]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0x94D049BB133111EB)
    # The place in the low bits makes ties go to the left; what is above them orders the grams.
    least = (value & ~np.uint64(0xFFFFFF)) | np.arange(len(value), dtype="uint64")
    size = 1
    while 2 * size <= grams:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < grams:
        least = np.minimum(least[: len(least) - (grams - size)], least[grams - size :])
    anchor = (least & np.uint64(0xFFFFFF)).astype("int64")
    valid = valid[: len(anchor)]
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(anchor)))
    good = valid[first]
    first, count = first[good], count[good]
    return value[anchor[first]].view("int64"), first, count


def _pieces(texts, width: int):
    """(bytes, rows, starts, offsets): whole texts put together up to _PIECE bytes, long texts in overlapping parts.

    Part j of the piece belongs to row rows[j], begins at starts[j] of the piece and at byte
    offsets[j] of its text. Long texts are cut at fixed window numbers, the same in every pass.
    """
    held, rows, starts, offsets, size = [], [], [], [], 0
    for row, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - width + 1), _PIECE):
            part = raw[at : at + _PIECE + width - 1] if len(raw) > _PIECE + width - 1 else raw
            if size and size + len(part) > _PIECE:
                yield b"".join(held), np.array(rows), np.array(starts), np.array(offsets)
                held, rows, starts, offsets, size = [], [], [], [], 0
            if len(part) >= width:
                held.append(part)
                rows.append(row)
                starts.append(size)
                offsets.append(at)
                size += len(part)
            if part is raw:
                break
    if size:
        yield b"".join(held), np.array(rows), np.array(starts), np.array(offsets)


def _document_spans(texts, width: int):
    """(piece, hash, first in piece, windows, row, first in text) for all texts of a batch."""
    for piece, rows, starts, offsets in _pieces(texts, width):
        data = np.frombuffer(piece, "uint8")
        valid = np.ones(max(0, len(data) - width + 1), bool)
        for s in starts[1:].tolist():
            valid[max(0, s - width + 1) : s] = False
        g, first, count = spans(data, valid, width)
        part = np.searchsorted(starts, first, side="right") - 1
        yield piece, g, first, count, rows[part], first - starts[part] + offsets[part]


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _anchor_rows(width: int):
    """(g, doc_id, at): hash of the anchor, and first window and number of windows of its span."""

    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for _, g, _, count, row, first in _document_spans(_texts(batch), width):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(ids[row]), pa.array(first << 8 | count)], ["g", "doc_id", "at"])

    return rows


def _common(batches):
    """(doc_id, at) of the rows, sorted by g, whose g occurs at least twice."""
    before = None  # the last row of the batches so far, and whether it was put out
    for batch in batches:
        g = batch.column("g").to_numpy()
        if not len(g):
            continue
        same = g[1:] == g[:-1]
        twice = np.zeros(len(g), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out = []
        if before is not None and before[0] == g[0]:
            twice[0] = True
            if not before[3]:
                out.append(before)
        doc, at = batch.column("doc_id").to_numpy(), batch.column("at").to_numpy()
        before = (g[-1], doc[-1], at[-1], bool(twice[-1]))
        docs = np.concatenate([np.array([o[1] for o in out], "int64"), doc[twice]])
        ats = np.concatenate([np.array([o[2] for o in out], "int64"), at[twice]])
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(ats)], ["doc_id", "at"])


def union(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that half-open intervals cover."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    opens = np.concatenate([[True], first[1:] > end[:-1]])
    closes = np.append(opens[1:], True)
    return first[opens], end[closes]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ranges(spans_of: pd.Series) -> pd.Series:
    """Packed spans of a document -> begin and end of the stretches of windows they make up, in turn."""
    out = []
    for packed in spans_of:
        at = np.asarray(packed, dtype="int64")
        first, end = union(at >> 8, (at >> 8) + (at & 0xFF))
        out.append(np.stack([first, end], axis=1).ravel())
    return pd.Series(out, dtype=object)


def _encode_run(lines: list[tuple[bytes, int, int, int]]) -> bytes:
    """Front-code sorted lines (key, doc, first, windows): shared length, rest length, windows, place, rest."""
    out, before = [], b""
    for key, doc, first, count in lines:
        shared = _shared(before, key, 0)
        out.append(bytes((shared, len(key) - shared, count)) + pack(_PLACE, doc, first) + key[shared:])
        before = key
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _decode_run(blob: bytes):
    """The lines of a run in turn, each with the length it shares with the one before."""
    raw, at, before = zstandard.ZstdDecompressor().decompress(blob), 0, b""
    while at < len(raw):
        shared, rest, count = raw[at], raw[at + 1], raw[at + 2]
        doc, first = unpack_from(_PLACE, raw, at + 3)
        at += 19 + rest
        before = before[:shared] + raw[at - rest : at]
        yield shared, before, doc, first, count


def _shared(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


def merge(runs):
    """Lines of sorted runs in one order, each as (shared with the line before, key, doc, first, windows).

    A loser tree over the runs' next lines. Each keeps the length it shares with the last line put
    out: of two, the one that shares more comes first and no byte is looked at; at equal lengths
    only what lies beyond is compared. Equal keys go by place.
    """
    heads = [next(r, None) for r in runs]
    k = len(heads)
    # shared[i]: with the last line put out; -1 for a run that has ended.
    shared = [-1 if h is None else 0 for h in heads]
    losers = [-1] * k

    def settle(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes the one with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if shared[a] < 0:
            return a, b
        x, y = heads[a], heads[b]
        n = _shared(x[1], y[1], shared[a])
        if n == len(x[1]) or n == len(y[1]):
            first = (len(x[1]), x[2], x[3]) <= (len(y[1]), y[2], y[3])
        else:
            first = x[1][n] < y[1][n]
        if not first:
            a, b = b, a
        shared[b] = n
        return a, b

    def play(i: int) -> int:
        winner, node = i, (i + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = winner
                return -1
            winner, losers[node] = settle(winner, losers[node])
            node //= 2
        return winner

    champion = -1
    for i in range(k):
        champion = play(i) if k > 1 else i
    while k and shared[champion] >= 0:
        _, key, doc, first, count = heads[champion]
        yield shared[champion], key, doc, first, count
        following = next(runs[champion], None)
        heads[champion] = following
        # The next line of the same run knows what it shares with the line just put out.
        shared[champion] = -1 if following is None else following[0]
        champion = play(champion) if k > 1 else champion


def _suffix_runs(width: int, parts: int):
    """Rows of docs with their ranges -> (part, blob) front-coded runs, and (doc_id, first, end) covered already."""

    def flush(lines):
        lines.sort()
        kept: dict[int, list] = {}
        gone = []
        before = None
        for line in lines:
            if before is not None and line[0] == before[0]:
                if line[1:3] != before[1:3]:
                    gone.append((line[1], line[2], line[2] + line[3] + width - 1))
                continue
            before = line
            kept.setdefault(int.from_bytes(line[0][:4]) % parts, []).append(line)
        rows = [(part, None, None, None, _encode_run(run)) for part, run in kept.items()]
        # What is covered already only passes through; any task may carry it.
        rows += [(doc % parts, doc, first, end, None) for doc, first, end in gone]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "doc_id", "first", "end", "blob"])

    def rows(batches):
        lines: list[tuple[bytes, int, int, int]] = []
        for batch in batches:
            ids, ranges = batch.column("doc_id").to_pylist(), batch.column("ranges").to_pylist()
            edges = [np.array(r, dtype="int64") for r in ranges]
            for piece, g, at, count, row, first in _document_spans(_texts(batch), width):
                cuts = np.flatnonzero(np.diff(row)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(row)], strict=True):
                    if lo == hi:
                        continue
                    inside = np.searchsorted(edges[row[lo]], first[lo:hi], side="right") % 2 == 1
                    doc = ids[row[lo]]
                    pick = lo + np.flatnonzero(inside)
                    for h, a, n, f in zip(g[pick].tolist(), at[pick].tolist(), count[pick].tolist(), first[pick].tolist(), strict=True):
                        lines.append(((h & 0xFFFFFFFFFFFFFFFF).to_bytes(8) + piece[a : a + n + width - 1], doc, f, n))
                if len(lines) >= _RUN_LINES:
                    yield flush(lines)
                    lines = []
        yield flush(lines)

    return rows


def _combine(width: int, crowd: int):
    """Rows sorted by part -> (doc_id, first, end) covered, and (window, doc_id, first) of crowded anchors."""

    def compare(group):
        """Windows of the different spans of one anchor: all but the first place of each are repeats."""
        best: dict[bytes, tuple[int, int]] = {}
        for key, doc, first, count in group:
            for q in range(count):
                window, place = key[8 + q : 8 + q + width], (doc, first + q)
                if place < best.setdefault(window, place):
                    best[window] = place
        for key, doc, first, count in group:
            begin = None
            for q in range(count + 1):
                covered = q < count and best[key[8 + q : 8 + q + width]] != (doc, first + q)
                if covered and begin is None:
                    begin = q
                elif not covered and begin is not None:
                    yield doc, first + begin, first + q - 1 + width
                    begin = None

    def windows(group):
        for key, doc, first, count in group:
            for q in range(count):
                yield hashlib.blake2b(key[8 + q : 8 + q + width], digest_size=16).digest(), doc, first + q

    def merged(blobs):
        """Yields ('gone', ...) and ('window', ...) rows of one part."""
        group, crowded, last = [], False, None
        for shared, key, doc, first, count in merge([_decode_run(b) for b in blobs]):
            if shared < 8:
                if crowded:
                    yield from (("window", *w) for w in windows(group))
                elif len(group) > 1:
                    yield from (("gone", *c) for c in compare(group))
                group, crowded = [], False
            elif shared == len(key) == len(last[0]):
                if (doc, first) != last[1:3]:
                    yield "gone", doc, first, first + count + width - 1
                continue
            last = (key, doc, first, count)
            group.append(last)
            if len(group) > crowd:
                yield from (("window", *w) for w in windows(group))
                group, crowded = [], True
        if crowded:
            yield from (("window", *w) for w in windows(group))
        elif len(group) > 1:
            yield from (("gone", *c) for c in compare(group))

    def out(gone, seen):
        n = len(gone)
        columns = [
            pa.array([None] * n + [s[0] for s in seen], pa.binary()),
            pa.array([g[0] for g in gone] + [s[1] for s in seen], pa.int64()),
            pa.array([g[1] for g in gone] + [s[2] for s in seen], pa.int64()),
            pa.array([g[2] for g in gone] + [None] * len(seen), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["window", "doc_id", "first", "end"])

    def finish(blobs):
        gone, seen = [], []
        for kind, *row in merged(blobs):
            (gone if kind == "gone" else seen).append(row)
            if len(gone) + len(seen) >= 50_000:
                yield out(gone, seen)
                gone, seen = [], []
        yield out(gone, seen)

    def rows(batches):
        blobs, current = [], None
        for batch in batches:
            plain = batch.filter(batch.column("blob").is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(plain.num_rows, pa.binary()), plain.column("doc_id"), plain.column("first"), plain.column("end")],
                    ["window", "doc_id", "first", "end"],
                )
            coded = batch.filter(batch.column("blob").is_valid())
            for part, blob in zip(coded.column("part").to_pylist(), coded.column("blob").to_pylist(), strict=True):
                if part != current and blobs:
                    yield from finish(blobs)
                    blobs = []
                current = part
                blobs.append(blob)
        if blobs:
            yield from finish(blobs)

    return rows


def repeated_bytes(docs: DataFrame, width: int = WIDTH, part_bytes: int = 4 << 20, crowd: int = 5_000) -> DataFrame:
    """(doc_id, out): begin and end of the maximal removed stretches of each document, in turn."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    anchors = texts.mapInArrow(_anchor_rows(width), "g long, doc_id long, at long")
    common = anchors.repartition("g").sortWithinPartitions("g").mapInArrow(_common, "doc_id long, at long")
    # At most as many entries as the document has spans.
    listed = common.groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    asked = stage(listed.select("doc_id", _ranges("at").alias("ranges")), "suffix-ranges")
    held = asked.agg(F.sum(F.size("ranges")).alias("n"), F.sum(F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: x - a)).alias("bytes")).first()
    # A range of windows is about as many bytes of suffixes and more by the overlap of spans.
    parts = max(12, int(3 * (held.bytes or 0)) // part_bytes)
    small = F.broadcast(asked) if (held.n or 0) <= 4_000_000 else asked
    runs = texts.join(small, "doc_id").mapInArrow(_suffix_runs(width, parts), "part int, doc_id long, first long, end long, blob binary")
    found = stage(
        runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_combine(width, crowd), "window binary, doc_id long, first long, end long"),
        "suffix-repeats",
    )
    crowded = found.filter("window is not null")
    firsts = crowded.groupBy("window").agg(F.min(F.struct("doc_id", "first")).alias("least"))
    later = crowded.join(firsts, "window").filter(F.struct("doc_id", "first") != F.col("least"))
    gone = found.filter("window is null").select("doc_id", "first", "end").union(later.select("doc_id", "first", F.col("first") + width))
    packed = gone.groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("end").alias("end"))
    return packed.select("doc_id", _union("first", "end").alias("out"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _union(firsts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for first, end in zip(firsts, ends, strict=True):
        out.append(np.stack(union(np.asarray(first, "int64"), np.asarray(end, "int64")), axis=1).ravel())
    return pd.Series(out, dtype=object)


def cut_out(raw: bytes, edges) -> bytes:
    """``raw`` without the stretches between edges 0 and 1, 2 and 3, ..."""
    if edges is None:
        return raw
    points = [0, *edges, len(raw)]
    return b"".join(raw[points[i] : points[i + 1]] for i in range(0, len(points), 2))


def without_repeated_bytes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs``."""
    joined = _with_edges(docs, **options)

    @F.pandas_udf("binary")
    def kept(texts: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([cut_out((t or "").encode(), e) for t, e in zip(texts, edges, strict=True)], dtype=object)

    return joined.select("doc_id", *_figures(), kept("text", "out").alias("kept"))


def digest_without_repeats(docs: DataFrame, **options) -> DataFrame:
    """As ``without_repeated_bytes`` with the sha256 of what is kept in its place."""
    joined = _with_edges(docs, **options)

    @F.pandas_udf("string")
    def sha(texts: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(cut_out((t or "").encode(), e)).hexdigest() for t, e in zip(texts, edges, strict=True)], dtype=object)

    return joined.select("doc_id", *_figures(), sha("text", "out").alias("kept_sha256"))


def _with_edges(docs: DataFrame, **options) -> DataFrame:
    out = stage(repeated_bytes(docs, **options), "repeated-bytes")
    small = F.broadcast(out) if (out.agg(F.sum(F.size("out")).alias("n")).first().n or 0) <= 4_000_000 else out
    return docs.select("doc_id", "text").join(small, "doc_id", "left")


def _figures():
    signed = F.aggregate(F.coalesce("out", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: x - a)
    return (
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        signed.alias("n_removed"),
        (F.coalesce(F.size("out"), F.lit(0)) / 2).cast("long").alias("n_spans"),
    )
