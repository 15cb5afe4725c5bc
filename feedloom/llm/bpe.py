"""Byte-level BPE as a bounded-lookahead streaming transducer, and the way back.

The text goes through in windows, the pre-tokens through a transducer that takes their bytes as they come and emits a
token as soon as its end lies at least the merge list's sufficient lookahead before the bytes seen so far, because no
later byte can change it. A pre-token that is open at the end of a window stays open in the transducer: what is kept is
bounded by the window and the lookahead, never by the text. Pre-tokens that end inside the window are the same
transduction with nothing to come; the outcome of short ones is remembered, together with the decimals and the bytes of
their tokens. Ids go straight into the caller's sink; decoding turns tokens to bytes and bytes to text incrementally,
holding back at most an unfinished character.

Edge cases: a null text counts as empty and has no ids; the strings of special tokens in a text
become those tokens; bytes that are no UTF-8 decode to U+FFFD as the tokenizer library does.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from heapq import heapify, heappop, heappush
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How byte-level tokenizers cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 1 << 16
# Entries of each half of a worker's memo.
MEMO = 250_000
# Pieces up to so many bytes are merged side by side; bits of a rank table, and the factor of its hash.
SHORT = 64
_TABLE_BITS, _ODD = 20, 0x9E3779B97F4A7C15
# Characters of texts whose new words are merged side by side.
AHEAD = 1 << 20
# Rows that a task encodes before it hands them on.
ROWS_AT_ONCE = 128


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabulary:
    """Merge ranks, the bytes of every token, special tokens, and the sufficient lookahead."""

    def __init__(self, content: str):
        spec = json.loads(content)
        symbols = byte_symbols()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(symbols[c] for c in t) for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for char, value in symbols.items():
            self.byte_id[value] = ids[char]
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made_by: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left], ids[right]] = rank
            self.made_by.append(ids[left + right])
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes to the right of a token's end that can still decide whether it stands.

        A token s is taken by its right neighbour z through rule (s, z); whether z is there by then
        depends on z's own bytes and on rules of lower rank that would take a piece off z's right
        edge. ``reach[s]`` is the farthest any rule seen so far lets s look, ``edge[z]`` the farthest
        any piece on z's right edge looks before it is merged into z. Rules come in rank order, so
        one pass is enough.
        """
        reach: dict[int, int] = {}
        edge: dict[int, int] = {}
        for (left, right), rank in self.ranks.items():
            made = self.made_by[rank]
            far = len(self.bytes_of[right]) + max(reach.get(right, 0), edge.get(right, 0))
            edge[made] = max(edge.get(made, 0), edge.get(right, 0), reach.get(right, 0))
            reach[left] = max(reach.get(left, 0), far)
        everything = [*reach.values(), *edge.values()]
        return max(everything, default=0) + 1

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of a whole piece: lowest rank first, leftmost first among equals."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank_of, made_by, never = self.ranks.get, self.made_by, len(self.made_by)
        ranks = [rank_of(both, never) for both in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i] = made_by[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), never)
        return ids

    def _rank_tables(self) -> None:
        """Ranks of pairs for whole arrays: a hash table, and a second one for the pairs that collide in the first."""
        pairs = np.array(list(self.ranks), "uint64").reshape(-1, 2)
        keys = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        self.tables, left = [], np.arange(len(keys))
        for _ in range(64):
            if not len(left):
                break
            factor = np.uint64(_ODD * (2 * len(self.tables) + 1) & (1 << 64) - 1)
            at = (keys[left] * factor) >> np.uint64(64 - _TABLE_BITS)
            held, rank = np.full(1 << _TABLE_BITS, (1 << 64) - 1, "uint64"), np.zeros(1 << _TABLE_BITS, "int32")
            held[at], rank[at] = keys[left], left
            self.tables.append((factor, held, rank))
            left = left[held[at] != keys[left]]
        self.byte_ids, self.made_ids = np.array(self.byte_id, "uint64"), np.array([*self.made_by, 0], "uint64")

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, never = left << np.uint64(32) | right, len(self.made_by)
        out = np.full(len(keys), never, "int32")
        for factor, held, rank in self.tables:
            at = (keys * factor) >> np.uint64(64 - _TABLE_BITS)
            hit = held[at] == keys
            out[hit] = rank[at[hit]]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of each of many short pieces, all merged side by side: a round makes the next merge of every piece."""
        if not hasattr(self, "tables"):
            self._rank_tables()
        sizes, never = np.array([len(p) for p in pieces], "int64"), len(self.made_by)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), "uint8")]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), never, "int32")
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inside] = self._ranks_of(ids[inside], ids[inside + 1])
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            open_ = best < never
            done_ids.append(ids[~open_])
            done_owner.append(owner[~open_])
            at = np.flatnonzero(open_ & (rank == best))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])[: len(at)]]
            ids[at] = self.made_ids[rank[at]]
            open_[at + 1] = False
            ids, owner = ids[open_], owner[open_]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        flat = ids[order].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a queue of pairs over a linked list, for long pieces."""
        ranks, n = self.ranks, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            j = after[i]
            # An entry is stale once either of its tokens has changed.
            if ids[i] < 0 or j < 0 or ranks.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.made_by[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := ranks.get((ids[a], ids[b]))) is not None:
                    heappush(queue, (r, a))
        return [t for t in ids if t >= 0]


class Piece(NamedTuple):
    """Tokens in a row: how many, their ids as decimals joined by commas, their bytes, and the ids themselves."""

    n: int
    decimals: str
    data: bytes
    ids: list[int]


class _Memo(dict):
    """Text -> Piece in two halves; the older half is dropped when the newer one is full, so frequent texts stay."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def unknown(self, texts: set[str]) -> set[str]:
        """Those that are not remembered; the others are in the newer half afterwards and outlive the next ``keep``."""
        missing, older = [t for t in texts if t not in self], self.older
        self.update((t, older[t]) for t in missing if t in older)
        return {t for t in missing if t not in older}

    def keep(self, found: dict[str, Piece]) -> None:
        if len(self) + len(found) > self.size:
            self.older = dict(self)
            self.clear()
        self.update(found)

    def __missing__(self, text: str) -> Piece:
        found = self[text] = self.older[text]
        return found


def _joined(parts: list[Piece]) -> Piece:
    if len(parts) == 2:
        a, b = parts
        return Piece(a[0] + b[0], f"{a[1]},{b[1]}", a[2] + b[2], a[3] + b[3])
    counts, decimals, data, ids = zip(*parts, strict=True)
    return Piece(sum(counts), ",".join(decimals), b"".join(data), list(chain(*ids)))


class Transducer:
    """Bytes of one pre-token in, stable tokens out; holds no more than a step and the lookahead."""

    def __init__(self, vocabulary: Vocabulary, sink, step: int = WINDOW):
        self.v, self.sink, self.step, self.held = vocabulary, sink, max(step, 2 * vocabulary.lookahead), b""

    def feed(self, data: bytes) -> None:
        for start in range(0, len(data), self.step):
            self.held += data[start : start + self.step]
            self._settle()

    def _settle(self) -> None:
        tokens, end, stable, keep = self.v.merge(self.held), 0, 0, 0
        for n, token in enumerate(tokens):
            end += len(self.v.bytes_of[token])
            if end > len(self.held) - self.v.lookahead:
                break
            stable, keep = n + 1, end
        if stable:
            self.sink(tokens[:stable])
            self.held = self.held[keep:]

    def finish(self) -> None:
        if self.held:
            self.sink(self.v.merge(self.held))
            self.held = b""


class Encoder:
    """Streams one text at a time, a window of characters in hand."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW):
        self.v = vocabulary
        self.window = window
        # Stretches from a blank to the next, which are one pre-token or a few; and those pre-tokens that are parts of some.
        self.chunks, self.parts = _Memo(MEMO), _Memo(MEMO // 4)
        self.split = re.compile(r" (?=\S)").split
        pattern = regex.compile(PATTERN)
        self.find, self.each = pattern.findall, pattern.finditer
        longest_first = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)").finditer

    def piece(self, ids: list[int]) -> Piece:
        return Piece(len(ids), ",".join([self.v.decimal[i] for i in ids]), b"".join([self.v.bytes_of[i] for i in ids]), list(ids))

    def ahead(self, texts):
        """The same texts, after what is new in some of them at a time has been merged side by side."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= AHEAD:
                yield from self._prepared(held)
                held, size = [], 0
        yield from self._prepared(held)

    def _prepared(self, texts: list[str]) -> list[str]:
        # A long text comes window by window, with its own look at what is new.
        chunks = set(chain.from_iterable(self.split(t) for t in texts if len(t) <= self.window))
        self._learn(self.chunks.unknown(chunks))
        return texts

    def _learn(self, chunks: set[str]) -> None:
        """Remember the Pieces of new chunks: of their pre-tokens, the short ones are merged side by side."""
        cut = {c: [" " + c] if c.isascii() and c.isalpha() else self.find(" " + c) for c in chunks}
        self._learn_parts({p for parts in cut.values() for p in parts})
        part = self.parts.__getitem__
        self.chunks.keep({c: part(ps[0]) if len(ps) == 1 else _joined([part(p) for p in ps]) for c, ps in cut.items()})

    def _learn_parts(self, pretokens: set[str]) -> None:
        unknown = list(self.parts.unknown(pretokens))
        data = [p.encode() for p in unknown]
        short = [n for n, d in enumerate(data) if len(d) <= SHORT]
        merged = dict(zip(short, self.v.merge_many([data[n] for n in short]), strict=True)) if short else {}
        found = {}
        for n, text in enumerate(unknown):
            # With nothing to come, a pre-token's tokens are all stable.
            ids = merged[n] if n in merged else self.v.merge(data[n])
            found[text] = Piece(len(ids), ",".join([self.v.decimal[i] for i in ids]), data[n], ids)
        # All that is asked for stays until the next call.
        self.parts.keep(found)

    def encode(self, text: str, sink) -> None:
        """Call ``sink`` with lists of the ids of ``text``."""
        self.pieces(text, lambda pieces: sink([i for p in pieces for i in p.ids]))

    def pieces(self, text: str, sink) -> None:
        """Call ``sink`` with lists of the Pieces of ``text``, a list for a window at most."""
        at = 0
        for found in self.special(text):
            self._stretch(text, at, found.start(), sink)
            sink([self.piece([self.v.special[found.group()]])])
            at = found.end()
        self._stretch(text, at, len(text), sink)

    def _stretch(self, text: str, at: int, end: int, sink) -> None:
        """What lies between special tokens."""
        while end - at > self.window:
            limit = at + self.window
            cut = self._blank(text, at, limit)
            if cut > at:
                self._plain(text[at:cut], sink)
                at = cut
            else:
                at = self._unbroken(text, at, limit, end, sink)
        if at < end:
            self._plain(text[at:end], sink)

    def _blank(self, text: str, at: int, limit: int) -> int:
        """The last place up to ``limit`` where a blank stands before a character that is none, and so a pre-token starts."""
        cut = text.rfind(" ", at + 1, limit)
        while cut > at and text[cut + 1].isspace():
            cut = text.rfind(" ", at + 1, cut)
        return cut

    def _plain(self, text: str, sink) -> None:
        """A stretch that ends where a pre-token ends."""
        first, *spaced = self.split(text)
        pieces = [self.piece(self.v.merge(p.encode())) for p in self.find(first)]
        if unknown := self.chunks.unknown(set(spaced)):
            self._learn(unknown)
        pieces += map(self.chunks.__getitem__, spaced)
        sink(pieces)

    def _unbroken(self, text: str, at: int, limit: int, end: int, sink) -> int:
        """Pre-tokens of a window without a place to cut, up to the one that crosses ``limit``; returns where it ends."""
        whole: list[Piece] = []
        for found in self.each(text, at, end):
            at, stop = found.span()
            if stop - at <= self.window:
                whole.append(self.piece(self.v.merge(text[at:stop].encode())))
            else:
                sink(whole)
                whole = []
                through = Transducer(self.v, lambda ids: sink([self.piece(ids)]), self.window)
                for start in range(at, stop, self.window):
                    through.feed(text[start : min(start + self.window, stop)].encode())
                through.finish()
            if stop >= limit:
                break
        sink(whole)
        return stop


class Decoder:
    """Tokens to text, a few at a time; an unfinished character waits for its next byte."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        bytes_of = self.bytes_of
        return self.take(b"".join([bytes_of[i] for i in ids]))

    def take(self, data: bytes) -> str:
        """The text that the bytes of the next tokens complete."""
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, Encoder] = {}


def encoder(content: str, window: int = WINDOW) -> Encoder:
    """The encoder of a tokenizer file, kept by a Python worker between batches."""
    key = f"{hashlib.md5(content.encode()).hexdigest()}:{window}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Vocabulary(content), window)
    return _LOADED[key]


def digest(coder: Encoder, text: str) -> tuple[int, str, str]:
    """Number of ids, sha256 of the ids as decimals joined by commas, sha256 of the decoded text."""
    ids_sha, text_sha, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(coder.v), 0

    def sink(pieces):
        nonlocal n
        counts, decimals, data, _ = zip(*pieces, strict=True) if pieces else ((), (), (), ())
        if added := sum(counts):
            ids_sha.update((("," if n else "") + ",".join(decimals)).encode())
            text_sha.update(decoder.take(b"".join(data)).encode())
            n += added

    coder.pieces(text, sink)
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _file(spark: SparkSession, path: str):
    """The tokenizer file, read once on the driver and sent to the executors (its size is fixed)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(spark: SparkSession, path: str, text):
    """array<int> of token ids of a text column."""
    content = _file(spark, path)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        coder, out = encoder(content.value), []
        for text in coder.ahead(text or "" for text in texts):
            ids: list[int] = []
            coder.encode(text, ids.extend)
            out.append(ids)
        return pd.Series(out, dtype=object)

    return encode(text)


def decode_column(spark: SparkSession, path: str, ids):
    """The text of a column of token ids; null ids give an empty text."""
    content = _file(spark, path)

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        vocabulary, out = encoder(content.value).v, []
        for row in rows:
            decoder = Decoder(vocabulary)
            out.append(decoder.feed([] if row is None else list(row)) + decoder.finish())
        return pd.Series(out, dtype=object)

    return decode(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; nothing as long as a text's ids is kept."""
    content = _file(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both_ways(texts: pd.Series) -> pd.DataFrame:
        coder = encoder(content.value)
        rows = [digest(coder, text) for text in coder.ahead(text or "" for text in texts)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", both_ways("text").alias("r")).select("doc_id", "r.*")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, decoded_sha256 of every row, a few rows in memory at a time."""
    content = _file(docs.sparkSession, path)
    kept = docs.select("doc_id", "source", "text")
    schema = T.StructType(
        [
            *kept.schema.fields[:2],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("token_ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def both_ways(batches):
        coder = encoder(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                counts, flat, digests = [], [], []
                for text in coder.ahead(text or "" for text in part.column("text").to_pylist()):
                    ids: list[int] = []
                    decoder, sha = Decoder(coder.v), hashlib.sha256()

                    def sink(pieces):
                        for p in pieces:
                            ids.extend(p.ids)  # noqa: B023
                        sha.update(decoder.take(b"".join([p.data for p in pieces])).encode())  # noqa: B023

                    coder.pieces(text, sink)
                    sha.update(decoder.finish().encode())
                    counts.append(len(ids))
                    flat.append(np.array(ids, dtype="int32"))
                    digests.append(sha.hexdigest())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                columns = [part.column(0), part.column(1), pa.array(counts, pa.int64()), tokens, pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(both_ways, schema)
