import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from feedloom.llm import phrases
from pyspark.sql import functions as F


def brute(rows, least, limit):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j]: max(good[p], 0) for p in good for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and good.get(p[i:j]) == good[p]}
        rows_of = []
        for p, a in good.items():
            if p in inside:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows_of)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("clash")).withColumn("words", F.lit(1))


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for _ in range(150):
        parts = [rng.choice(words) if rng.random() < 0.6 else rng.choice(["New York city", "salt and pepper", "a a a a a a", "x of the"]) for _ in range(40)]
        rows.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", " ", "\t ", ", ", "!?", "\r\n"]) for p in parts)))
    return rows + [rows[0]] * 5


@pytest.mark.parametrize("budget", [20, phrases.BUDGET])
def test_against_counting_everything(spark, budget):
    rows = corpus()
    assert found(phrases.collocations(table(spark, rows), 12, 40, budget=budget)) == brute(rows, 12, 40)


def test_full_bitmaps_change_nothing(spark):
    rows = corpus()[:60]
    assert found(phrases.collocations(table(spark, rows), 6, 10_000, word_bits=6, pair_bits=6)) == brute(rows, 6, 10_000)


def test_odd_texts(spark):
    long = "the one phrase. " * 30_000 + "y" * 300_000 + " ends here " * 3
    rows = [("en", None), ("en", ""), (None, ".,;\t \n"), ("und", "Ä b Ä b Ä b"), (None, "Ä b"), ("", "q\x0br\xa0s q\x0cr\xa0s"), ("en", long)]
    assert found(phrases.collocations(table(spark, rows), 2, 50)) == brute(rows, 2, 50)
    assert found(phrases.collocations(table(spark, rows).filter("false"))) == []


def test_stretches_cut_no_suffix():
    texts = ["a b c d e f g h. i j " * 20, "k " * 50, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(texts)], ["lang", "text"])
    (whole, n, _), = phrases._stretches([batch])
    expected = Counter(tuple(whole[i : i + 5]) for i in range(n) if whole[i] and len(whole[i : i + 5]) == 5)
    parts = Counter()
    for ids, starts, names in phrases._stretches([batch], size=7, part=9, named=True):
        ids = np.append(ids, np.zeros(5, "uint64"))
        parts.update(tuple(ids[i : i + 5]) for i in range(starts) if ids[i])
        assert all(int(i) in names for i in ids if i)
    cut = lambda c: Counter({k: v for k, v in c.items() if 0 not in k})
    assert cut(parts) == cut(expected) and sum(parts.values()) == np.count_nonzero(whole[:n])


@pytest.mark.parametrize("bits", [3, 6, 12, 17])
def test_a_bitmap_reaches_the_driver_in_few_rows(spark, monkeypatch, bits):
    taken, frame = [], type(spark.range(0))
    for name in ("collect", "toPandas"):
        def counting(self, f=getattr(frame, name)):
            taken.append(len(out := f(self)))
            return out
        monkeypatch.setattr(frame, name, counting)
    buckets = sorted({*random.Random(bits).choices(range(1 << bits), k=5_000), 0, (1 << bits) - 1})
    table = spark.createDataFrame([(b,) for b in buckets * 2], "bucket long")
    bitmap = phrases._bitmap(table, bits).value
    assert bitmap.dtype == "uint64" and len(bitmap) == max(1, 1 << bits >> 6)
    assert np.flatnonzero(np.unpackbits(bitmap.view("uint8"), bitorder="little")).tolist() == buckets
    assert sum(taken) <= phrases.BITMAP_PARTS
    assert not phrases._bitmap(table.filter("false"), bits).value.any()
