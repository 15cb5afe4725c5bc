"""SimHash near-duplicates of documents by anchor-point covering.

The 64 bits are cut into three blocks; fingerprints that differ in at most 4 bits differ in at most
one bit of some block. On a block the anchors are the words of a covering code of radius 1: a
perfect Hamming code on 15 bits, every value on the other 6 or 7. A fingerprint is at home at its
nearest anchor and is also copied to every anchor within radius plus threshold (a differing bit
moves it by one from any anchor), so the home anchor of one end of a link always holds the other
end too. Anchors are compared one by one, each task keeping a spanning forest, never all pairs.

Equal fingerprints are folded first, so a group of copies of any size is one row. An anchor at
which more than ``block`` fingerprints are at home is cut into pairs of blocks.

Edge cases: null and word-less texts have fingerprint 0 and are linked like any other; a shorter
text is one shingle; repeated rows share their class; null doc_ids are never a class's smallest
id (a class of only such rows has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.bits import counts, decide
from feedloom.llm.common import sized
from feedloom.llm.components import components
from feedloom.plans.staging import stage

# Words per shingle, hash seed, and the most differing bits of a link.
SHINGLE, SEED, MAX_BITS = 4, 42, 4
BLOCKS = ((0, 22), (22, 21), (43, 21))
_HASHES_AT_ONCE = 200_000
_PAIRS_AT_ONCE = 1_000_000
_LARGE_GROUP = 4_096


def _shingle_hashes(text: str, words_per_shingle: int):
    """An iterator over the hashes of a text's shingles, and how many there are."""
    words = text.encode().lower().split()
    if len(words) < words_per_shingle:
        pieces = [b" ".join(words)] if words else []
        return map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), len(pieces)
    windows = zip(*(islice(words, i, None) for i in range(words_per_shingle)), strict=False)
    return map(xxhash.xxh64_intdigest, map(b" ".join, windows), repeat(SEED)), len(words) - words_per_shingle + 1


def fingerprints(texts, words_per_shingle: int = SHINGLE) -> np.ndarray:
    """A fingerprint (uint64) per text; memory follows _HASHES_AT_ONCE, not the texts."""
    total = np.zeros((len(texts), 64), "int64")
    sizes = np.zeros(len(texts), "int64")
    parts, owners, lengths, held = [], [], [], 0

    def flush():
        if parts:
            np.add.at(total, owners, counts(np.concatenate(parts), np.array(lengths)))

    for row, text in enumerate(texts):
        hashes, n = _shingle_hashes(text or "", words_per_shingle)
        sizes[row] = n
        while n > 0:
            take = min(n, _HASHES_AT_ONCE)
            parts.append(np.fromiter(islice(hashes, take), "uint64", take))
            owners.append(row)
            lengths.append(take)
            held, n = held + take, n - take
            if held >= _HASHES_AT_ONCE:
                flush()
                parts, owners, lengths, held = [], [], [], 0
    flush()
    return decide(total, sizes)


def fingerprint(text, words_per_shingle: int = SHINGLE):
    """The fingerprint column of a text column, as a signed long."""

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.tolist(), words_per_shingle).view("int64"))

    return compute(text)


# The Hamming code on 15 bits: word i has the syndrome XOR of (position + 1) of its set bits.
_SYNDROME = np.zeros(1 << 15, "uint8")
for _bit in range(15):
    _SYNDROME[(np.arange(1 << 15) >> _bit) & 1 == 1] ^= _bit + 1
# To a word with syndrome s, the code words two flips away are reached by the pairs with (i+1) ^ (j+1) = s.
_TWO_FLIPS = np.array(
    [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 16) if s != i < i ^ s] if s else [0] * 7 for s in range(16)],
    dtype="uint64",
)


def anchors(fp: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, row, is home) of every anchor a fingerprint belongs to."""
    keys, rows, home = [], [], []
    every = np.arange(len(fp))

    def add(key, row, at_home):
        keys.append(key.astype("int64"))
        rows.append(row)
        home.append(np.full(len(key), at_home))

    for number, (start, width) in enumerate(BLOCKS):
        value = (fp >> np.uint64(start)) & np.uint64((1 << width) - 1)
        low, rest = value & np.uint64(0x7FFF), value >> np.uint64(15)
        syndrome = _SYNDROME[low]
        nearest = low ^ np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - 1).astype("uint64"), np.uint64(0))
        base = np.uint64(number << 22)
        add(base | rest << np.uint64(15) | nearest, every, True)
        if homes_only:
            continue
        off = np.flatnonzero(syndrome)
        for k in range(7):
            word = low[off] ^ _TWO_FLIPS[syndrome[off], k]
            add(base | rest[off] << np.uint64(15) | word, every[off], False)
        for bit in range(width - 15):
            add(base | (rest ^ np.uint64(1 << bit)) << np.uint64(15) | nearest, every, False)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(home)


def _anchor_rows(homes_only: bool):
    def explode(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype("int64")
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                key, row, home = anchors(part.view("uint64"), homes_only)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(home)], ["key", "fp", "home"])

    return explode


class _Forest:
    """Keeps a link only if it joins two sets that were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def _find(self, node: int) -> int:
        up = self.up
        root = node
        while (parent := up.get(root, root)) != root:
            root = parent
        while node != root:
            up[node], node = root, up.get(node, node)
        return root

    def add(self, a: int, b: int) -> bool:
        ra, rb = self._find(a), self._find(b)
        if ra == rb:
            return False
        self.up[max(ra, rb)] = min(ra, rb)
        return True


def _spread(members: np.ndarray, max_bits: int):
    """Links of a spanning forest of a large group: each member looks only at those not yet reached."""
    left = np.unique(members)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                yield from ((int(node), int(other)) for other in found)


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int):
    """Links (pairs of fingerprints) among rows sorted by key, each group complete."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    homes = np.add.reduceat(home.astype("int64"), starts)
    large = homes * sizes > _LARGE_GROUP
    forest = _Forest()
    for g in np.flatnonzero(large):
        for a, b in _spread(fp[starts[g] : starts[g] + sizes[g]], max_bits):
            if forest.add(a, b):
                yield a, b
    group = np.repeat(np.arange(len(starts)), sizes)
    seekers = np.flatnonzero(home & ~large[group] & (sizes[group] > 1))
    width = sizes[group[seekers]]
    cut = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()) + _PAIRS_AT_ONCE, _PAIRS_AT_ONCE))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        who, w = seekers[lo:hi], width[lo:hi]
        if not len(who):
            continue
        other = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(starts[group[who]], w)
        one = np.repeat(who, w)
        apart = fp[one] ^ fp[other]
        near = np.flatnonzero((np.bitwise_count(apart) <= max_bits) & (apart != 0))
        for a, b in zip(fp[one[near]].tolist(), fp[other[near]].tolist(), strict=True):
            if forest.add(a, b):
                yield a, b


def _compare(max_bits: int):
    """Rows sorted by (key, part) -> links. Only whole groups are compared; the open one is carried on."""

    def compare(batches):
        held = None
        for batch in batches:
            now = np.rec.fromarrays(
                [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "fp", "home")], names="group,fp,home"
            )
            held = now if held is None else np.concatenate([held, now])
            if not len(held):
                continue
            whole = _last_run(held["group"])
            if whole:
                yield from _emit(held[:whole], max_bits)
                held = held[whole:]
        if held is not None and len(held):
            yield from _emit(held, max_bits)

    return compare


def _last_run(group: np.ndarray) -> int:
    """Where the last run of equal values starts."""
    changes = np.flatnonzero(group[1:] != group[:-1])
    return int(changes[-1]) + 1 if len(changes) else 0


def _emit(rows, max_bits):
    links = np.array(
        list(_links(rows["group"], rows["fp"].astype("int64").view("uint64"), rows["home"].astype(bool), max_bits)), dtype="uint64"
    ).reshape(-1, 2).view("int64")
    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def link_fingerprints(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = 20_000) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) with the same connected components as all links."""
    schema = "key long, fp long, home boolean"
    homes = nodes.select("fp").mapInArrow(_anchor_rows(True), schema)
    full = homes.groupBy("key").count().filter(F.col("count") > block)
    hot = sized(stage(full.select("key", F.ceil(F.col("count") / block).cast("int").alias("parts")), "hot-anchors"))
    members = nodes.select("fp").mapInArrow(_anchor_rows(False), schema).join(hot, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
    others = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    # Plain anchors are group (key, 0, 0). In a hot one, homes of part i meet members of part j in group (key, i, j).
    as_home = F.transform(others, lambda j: F.struct(mine.cast("int").alias("i"), j.alias("j"), F.lit(True).alias("home")))
    as_member = F.transform(others, lambda i: F.struct(i.alias("i"), mine.cast("int").alias("j"), F.lit(False).alias("home")))
    roles = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home"))))
    roles = roles.when(F.col("home"), F.concat(as_home, as_member)).otherwise(as_member)
    dealt = members.select("key", "fp", F.explode(roles).alias("r")).select(
        F.when((F.col("r.i") == 0) & (F.col("r.j") == 0), F.col("key")).otherwise(F.xxhash64("key", "r.i", "r.j")).alias("group"),
        "fp",
        F.col("r.home").alias("home"),
    )
    sorted_groups = dealt.repartition("group").sortWithinPartitions("group")
    return sorted_groups.mapInArrow(_compare(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable) for every row of ``docs``."""
    prints = stage(docs.select("doc_id", fingerprint(F.col("text"), words_per_shingle).alias("fp")), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = components(link_fingerprints(nodes, max_bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(rooted.join(smallest, "root").select("fp", "component_id"), "fingerprint-classes")
    return prints.join(sized(classes), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold the smallest doc_id of their class; rows without a doc_id stay."""
    classes = near_duplicates(docs, **options)
    gone = sized(stage(classes.filter("doc_id != component_id").select("doc_id").distinct(), "near-copies"))
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
