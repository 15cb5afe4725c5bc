"""Phrases that stick together, from suffix subtrees built group by group within a memory budget.

Every position of a piece of text starts a suffix of at most LONGEST words. Of the tree of all these suffixes
only the nodes with ``least`` occurrences matter. The tree is partitioned vertically, as ERA does: the
suffixes are counted by first word, a prefix with more of them than the budget is lengthened by a word until
it fits, and prefixes are dealt to groups of about one budget. Each group's subtree is built
by itself from its sorted suffixes, and the count of a node is the total of the leaves below it.

Before, two passes find what cannot lie on a frequent phrase: words, and pairs of neighbouring words, are
counted (pairs in buckets of their hash), and a suffix is cut where it meets a rarer word or bucket. The
buckets of ``least`` or more occurrences go to the tasks as bitmaps of a fixed size; a bucket may hold a rare
pair too, which costs work but changes no count. Equal suffixes of a stretch of text are folded before they travel.

Words travel as 64-bit hashes of language and word; two frequent words with one hash raise an error.

Edge cases: a null text has no words, a null lang is ``und``; texts are read in slices, so a text of any length
is whole; copies of rows count as often as they occur; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import sized
from feedloom.plans.staging import stage

# What separates pieces, what separates their words, the case that is folded, the longest phrase.
_BREAKS, _LARGE = b".,;:!?\n\x0b\x0c\r", bytes(range(65, 91))
_PLAIN = bytes.maketrans(_BREAKS + b"\t" + _LARGE, b"\n" * len(_BREAKS) + b" " + _LARGE.lower())
LONGEST, NO_LANG = 5, "und"
# Bits of the bitmaps (2 MB and 8 MB), suffixes of a group, and what a task holds: bytes of text, words, known words.
WORD_BITS, PAIR_BITS, BUDGET = 24, 26, 500_000
# Into how many parts a bitmap is cut to be made.
BITMAP_PARTS = 256
_SLICE, _STRETCH, _KNOWN = 1 << 21, 1_000_000, 300_000
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


class _Ids(dict):
    """Word -> id in one language; ``names``, if asked for, leads back from the ids of all languages."""

    def __init__(self, lang: str, names: dict[int, tuple[str, bytes]] | None):
        super().__init__()
        self.lang, self.seed, self.names = lang, xxhash.xxh64_intdigest(lang), names

    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        if self.names is not None:
            self.names[made] = self.lang, word
        return made


def _slices(data: bytes, size: int):
    """``data`` in parts of about ``size`` bytes, cut behind a separator."""
    start = 0
    while len(data) - start > size:
        cut = max(data.rfind(b"\n", start, start + size), data.rfind(b" ", start, start + size)) + 1
        if cut <= start:
            ends = [e for e in (data.find(b"\n", start + size), data.find(b" ", start + size)) if e >= 0]
            cut = min(ends, default=len(data) - 1) + 1
        yield data[start:cut]
        start = cut
    yield data[start:]


def _stretches(batches, size: int = _STRETCH, part: int = _SLICE, named: bool = False):
    """(ids, starts, names) of stretches of words, 0 for the end of a piece; the first ``starts`` places are to be counted.

    The words behind them come again at the start of the next stretch, so no suffix is cut.
    """
    words: list[int] = []
    names: dict[int, tuple[str, bytes]] | None = {} if named else None
    known: dict[str, _Ids] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for data in _slices(text.encode().translate(_PLAIN), part):
                if (ids := known.get(lang)) is None:
                    ids = known[lang] = _Ids(lang, names)
                first, *pieces = data.split(b"\n")
                words.extend(map(ids.__getitem__, first.split()))
                for piece in pieces:
                    words.append(0)
                    words.extend(map(ids.__getitem__, piece.split()))
                if len(words) >= size:
                    yield np.array(words, "uint64"), len(words) - LONGEST + 1, names
                    del words[: len(words) - LONGEST + 1]
                    if sum(map(len, known.values())) > _KNOWN:
                        # The words that come again must stay known.
                        known, names = {}, {w: names[w] for w in words if w} if named else None
            words.append(0)
    yield np.array(words, "uint64"), len(words), names


def _word_rows(batches):
    """(id, lang, word, n): the words of every stretch, and one row a language without a word for how many there are."""
    for ids, starts, names in _stretches(batches, named=True):
        found, n = np.unique(ids[:starts], return_counts=True)
        found, n = (found[1:], n[1:]) if len(found) and not found[0] else (found, n)
        langs, words = zip(*(names[i] for i in found.tolist()), strict=True) if len(found) else ((), ())
        totals: dict[str, int] = {}
        for lang, count in zip(langs, n.tolist(), strict=True):
            totals[lang] = totals.get(lang, 0) + count
        columns = [
            pa.array([*found.view("int64").tolist(), *[0] * len(totals)], pa.int64()),
            pa.array([*langs, *totals], pa.string()),
            pa.array([*(w.decode() for w in words), *[None] * len(totals)], pa.string()),
            pa.array([*n.tolist(), *totals.values()], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "word", "n"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


def _marked(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[(buckets >> np.uint64(6)).astype("int64")] >> (buckets & np.uint64(63)) & np.uint64(1)).astype(bool)


def _frequent(ids: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """The ids, those that cannot be frequent set to 0."""
    return np.where(_marked(words, ids >> np.uint64(64 - bits)), ids, np.uint64(0))


def _pair_rows(words, word_bits: int, pair_bits: int):
    """(bucket, n): how many pairs of neighbouring frequent words fall into each bucket."""

    def rows(batches):
        for ids, starts, _ in _stretches(batches):
            ids = _frequent(ids, words.value, word_bits)
            a, b = ids[: min(starts, len(ids) - 1)], ids[1 : starts + 1]
            both = (a != 0) & (b != 0)
            found, n = np.unique(_mixed(a[both], b[both]) >> np.uint64(64 - pair_bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype("int64")), pa.array(n.astype("int64"))], ["bucket", "n"])

    return rows


def _folded(window: list[np.ndarray]) -> pa.RecordBatch:
    """(w1 to w5, n): the distinct rows of a window matrix, given by column, and how often each occurs."""
    order = np.lexsort(window[::-1])
    window = [w[order] for w in window]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [w[1:] != w[:-1] for w in window])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    columns = [*(pa.array(w[first].view("int64")) for w in window), pa.array(n.astype("int64"))]
    return pa.RecordBatch.from_arrays(columns, [*_WORDS, "n"])


def _leaf_rows(words, pairs, word_bits: int, pair_bits: int):
    """(w1 to w5, n): suffixes of at least two words, cut where they cannot be frequent, equal ones of some stretches folded."""

    def rows(batches):
        held, size = [], 0
        for ids, starts, _ in _stretches(batches):
            ids = np.append(_frequent(ids, words.value, word_bits), np.zeros(LONGEST, "uint64"))
            on = (ids[:-1] != 0) & (ids[1:] != 0)
            on[on] = _marked(pairs.value, _mixed(ids[:-1][on], ids[1:][on]) >> np.uint64(64 - pair_bits))
            at = np.flatnonzero(on[:starts])
            window, open_ = [ids[at]], np.ones(len(at), bool)
            for k in range(1, LONGEST):
                open_ = open_ & on[at + k - 1]
                window.append(np.where(open_, ids[at + k], np.uint64(0)))
            held.append(window)
            size += len(at)
            if size >= _STRETCH:
                yield _folded([np.concatenate(c) for c in zip(*held, strict=True)])
                held, size = [], 0
        if held:
            yield _folded([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows


def _bitmap_parts(size: int):
    """(bucket) -> (part, words): the parts of a bitmap whose buckets a task has, each ``size`` words long."""

    def rows(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            bucket = batch.column("bucket").to_numpy().view("uint64")
            word = (bucket >> np.uint64(6)).astype("int64")
            part, mask = word // size, np.uint64(1) << (bucket & np.uint64(63))
            for p in np.unique(part).tolist():
                mine = part == p
                np.bitwise_or.at(parts.setdefault(p, np.zeros(size, "uint64")), word[mine] % size, mask[mine])
        columns = [pa.array(list(parts), pa.int64()), pa.array([w.tobytes() for w in parts.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "words"])

    return rows


def _bitmap(buckets: DataFrame, bits: int):
    """The set of buckets as a broadcast bitmap of 2 to the ``bits`` bits, whatever the corpus.

    The tasks write its parts, so the driver gets a row per part and holds no more than a few copies of the bitmap.
    """
    words = max(1, 1 << bits >> 6)
    size = max(1, words // BITMAP_PARTS)
    of_part = buckets.repartition(F.shiftright("bucket", 6 + size.bit_length() - 1)).mapInArrow(_bitmap_parts(size), "part long, words binary")
    bitmap = np.zeros(words, "uint64")
    for part, found in of_part.collect():
        bitmap[part * size : (part + 1) * size] |= np.frombuffer(found, "uint64")
    return buckets.sparkSession.sparkContext.broadcast(bitmap)


def _grouped(leaves: DataFrame, budget: int) -> DataFrame:
    """The leaves with ``group`` and ``plen``: prefixes of at most ``budget`` suffixes, dealt to groups of about a budget."""
    placed, total = leaves.withColumn("plen", F.lit(None).cast("int")), leaves.count()
    for k in range(1, LONGEST):
        key = _WORDS[:k]
        # Longer prefixes of those that are too large; fewer of these than the leaves hold budgets.
        counts = placed.filter("plen is null").groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        over = stage(counts.filter(F.col("rows") > budget).select(*key, F.lit(True).alias("_over")), "phrase-prefixes")
        placed = placed.join(sized(over), key, "left")
        fits = F.when(F.col("plen").isNull() & F.col("_over").isNull(), k).otherwise(F.col("plen"))
        placed = placed.withColumn("plen", fits).drop("_over")
        if not over.limit(1).count():
            break
    placed = placed.withColumn("plen", F.coalesce("plen", F.lit(LONGEST)))
    prefix = [F.when(F.col("plen") >= k, F.col(w)).otherwise(0) for k, w in enumerate(_WORDS, 1)]
    groups = max(1, 2 * total // budget)
    return placed.select(F.pmod(F.xxhash64("plen", *prefix), F.lit(groups)).alias("group"), "plen", *_WORDS, "n")


def _subtrees(least: int):
    """Sorted suffixes of whole groups -> (w1 to w5, a): the nodes of two words or more, those above a group's prefix in part."""

    def build(table):
        depth = table.column("plen").to_numpy()
        words = [table.column(w).to_numpy() for w in _WORDS]
        n = table.column("n").to_numpy()
        new = np.ones(len(n), bool)
        new[1:] = False
        for k, word in enumerate(words, 1):
            new[1:] |= word[1:] != word[:-1]
            if k == 1:
                continue
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            good = (word[first] != 0) & ((total >= least) | (depth[first] > k))
            first, total = first[good], total[good]
            columns = [words[j][first] if j < k else np.zeros(len(first), "int64") for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, total)], [*_WORDS, "a"])

    def trees(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            groups = batch.column("group").to_numpy()
            while len(groups):
                # The rows of the group that was open, or of the first one here.
                mine = held[-1].column("group")[-1].as_py() if held else groups[0]
                end = int(np.argmax(groups != mine)) if (groups != mine).any() else len(groups)
                if end:
                    held.append(batch.slice(0, end))
                batch, groups = batch.slice(end), groups[end:]
                if len(groups):
                    yield from build(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from build(pa.Table.from_batches(held))

    return trees


def frequent_phrases(docs: DataFrame, least: int, budget: int = BUDGET, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS):
    """(words, totals, phrases): (id, lang, word, n), (lang, n) of all words, (w1 to w5, a) of two words and more; at least ``least`` times."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").filter("text is not null")
    counted = texts.mapInArrow(_word_rows, "id long, lang string, word string, n long")
    counted = stage(counted.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    totals, words = counted.filter("word is null").select("lang", "n"), counted.filter("word is not null")
    if words.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("two frequent words have one 64-bit hash")
    known = _bitmap(words.select(F.shiftrightunsigned("id", 64 - word_bits).alias("bucket")), word_bits)
    buckets = texts.mapInArrow(_pair_rows(known, word_bits, pair_bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    pairs = _bitmap(buckets.filter(F.col("n") >= least).select("bucket"), pair_bits)
    row = ", ".join(f"{w} long" for w in _WORDS)
    leaves = stage(texts.mapInArrow(_leaf_rows(known, pairs, word_bits, pair_bits), f"{row}, n long"), "phrase-leaves")
    sorted_ = _grouped(leaves, budget).repartition("group").sortWithinPartitions("group", *_WORDS)
    nodes = sorted_.mapInArrow(_subtrees(least), f"{row}, a long").groupBy(_WORDS).agg(F.sum("a").alias("a"))
    return words, totals, stage(nodes.filter(F.col("a") >= least), "phrases")


def collocations(docs: DataFrame, least: int = 100, limit: int = 2_000, **options) -> DataFrame:
    """The ``limit`` phrases of each language that stick together most: lang, rank, phrase, a, l, r, n, score.

    The score is 1000 times how much oftener the phrase occurs than its two parts would meet by chance, at the cut
    that makes the least of it. A phrase that always occurs inside a longer one is left to that one.
    """
    words, totals, phrases = frequent_phrases(docs, least, **options)
    array = F.filter(F.array(*_WORDS), lambda w: w != 0)
    phrases = phrases.withColumn("words", array)
    k = F.size("words")
    # A longer phrase with the same count contains ones of every length in between with that count.
    inside = phrases.filter(k > 2).select(F.explode(F.array(F.slice("words", F.lit(1), k - 1), F.slice("words", F.lit(2), k - 1))).alias("words"), F.col("a").alias("over"))
    over = inside.groupBy("words").agg(F.max("over").alias("over"))
    open_phrases = stage(phrases.join(sized(stage(over, "phrase-inside")), "words", "left").filter("over is null or over < a").select("words", "a"), "phrase-candidates")
    counts = phrases.select("words", F.col("a").alias("f")).union(words.select(F.array("id"), "n"))
    counts = sized(stage(counts, "phrase-counts"))
    cuts = open_phrases.select("*", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cuts = cuts.select("*", F.expr("slice(words, 1, cut)").alias("left"), F.expr("slice(words, cut + 1, size(words) - cut)").alias("right"))
    cuts = cuts.join(counts.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    named = words.select(F.col("id").alias("w"), "lang", "word")
    of_first = named.select(F.array("w").alias("start"), "lang").join(totals, "lang")
    cuts = cuts.withColumn("start", F.slice("words", 1, 1)).join(sized(stage(of_first, "phrase-langs")), "start")
    # Up to 38 digits: exact below 10^17 words.
    score = F.expr("(1000BD * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    cuts = cuts.withColumn("score", score)
    least_cut = F.min(F.struct("score", "cut", "l", "r")).alias("c")
    scored = cuts.groupBy("words", "a", "lang", "n").agg(least_cut).select("words", "a", "lang", "n", "c.score", "c.l", "c.r")
    best = scored.withColumn("phrase", F.lit(""))
    # Very many phrases may tie (all those of a passage that is copied whole), so ties are broken word by word. A word
    # but the last has its blank behind it, so the order is that of the whole phrases.
    for k in range(LONGEST + 1):
        if k:
            blank = F.when(k < F.size("words"), F.concat("word", F.lit(" "))).otherwise(F.coalesce("word", F.lit("")))
            spelled = best.withColumn("w", F.get("words", F.lit(k - 1))).join(sized(named.select("w", "word")), "w", "left")
            best = spelled.withColumn("phrase", F.concat("phrase", blank)).drop("w", "word")
        in_order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = stage(best.withColumn("rank", F.rank().over(in_order).cast("long")).filter(F.col("rank") <= limit), "phrase-best")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
