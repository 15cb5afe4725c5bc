import numpy as np
import pandas as pd
import pytest
import xxhash
from feedloom.llm import simhash
from feedloom.llm.bits import majority
from feedloom.llm.components import components
from pyspark.sql import functions as F


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows):
    ids, fps = [r[0] for r in rows], np.array([r[1] for r in rows], dtype="uint64")
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    smallest = {}
    for i, d in enumerate(ids):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return {d: smallest[find(i)] for i, d in enumerate(ids)}


def test_majority_of_long_and_empty_segments():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 2000, dtype="uint64")
    lengths = np.array([0, 1, 700, 0, 255, 256, 788])
    got, at = majority(h, lengths), 0
    for n, g in zip(lengths, got, strict=True):
        seg = h[at : at + n].tolist()
        at += n
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in seg) > n)


def test_every_close_pair_meets_at_a_home_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype="uint64") * np.uint64(2) + np.uint64(1)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    kx, rx, hx = simhash.anchors(x)
    ky, ry, _ = simhash.anchors(y)
    at_home = {(int(r), int(k)) for k, r, h in zip(kx, rx, hx, strict=True) if h}
    met = {int(r) for k, r in zip(ky, ry, strict=True) if (int(r), int(k)) in at_home}
    assert met == set(range(len(x)))


def test_whole_table_against_brute_force(spark, sf):
    from feedloom.llm.registry import load

    got = load()[0]["op3_simhash_anchor_covering"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = {d: brute_print(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert dict(zip(got.doc_id, got.fingerprint, strict=True)) == {d: f"{v:016x}" for d, v in want.items()}
    classes = brute_classes(sorted(want.items()))
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == classes
    assert len(set(classes.values())) < len(classes)


@pytest.mark.parametrize("block", [3, 20_000])
def test_tight_group_split_anchors_and_chains(spark, block):
    """A hot group: thousands of fingerprints around one centre, chains, and far ones, at any block size."""
    rng = np.random.default_rng(3)
    centre = 0x0123456789ABCDEF
    near = {centre}
    while len(near) < (60 if block == 3 else 1500):
        v = centre
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            v ^= 1 << int(b)
        near.add(v)
    chain, far = [0xFFFF0000FFFF0000], [int(v) for v in rng.integers(0, 1 << 63, 40)]
    for i in range(20):
        chain.append(chain[-1] ^ (0b1111 << (3 * i)))
    values = sorted(near | set(chain) | set(far))
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = components(simhash.link_fingerprints(fps, block=block)).collect()
    got = {}
    for r in roots:
        got.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    want = {}
    for v, c in brute_classes([(v, v) for v in values]).items():
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "One two", 4), (5, "one  TWO", 5), (None, "alone here", 6), (4, "One two", 7), (6, "É é " * 40_000, 8)],
        "doc_id long, text string, fp long",
    )
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None), (6, 6)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.fp for r in kept.collect()) == [1, 4, 6, 7, 8]
    empty = docs.filter(F.lit(False))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
