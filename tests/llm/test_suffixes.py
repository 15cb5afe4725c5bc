import hashlib
import random

import pandas as pd
import pytest
from feedloom.llm import suffixes
from pyspark.sql import functions as F


def brute(docs, width=100):
    """doc_id -> (bytes, removed, stretches, kept) by a table of every string."""
    first = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - width + 1):
            first.setdefault(raw[p : p + width], (d, p))
    out = {}
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] != (d, p):
                gone[p : p + width] = b"\1" * width
        stretches = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), stretches, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (80, 99, 100, 101, 130, 180, 400)]
    docs = []
    for d in range(70):
        parts = [rng.choice([*passages, text(rng.randint(0, 150))]) for _ in range(rng.randint(0, 6))]
        docs.append((d, rng.choice(["", text(20)]).join(parts)))
    docs += [(100, "ab" * 300), (101, "x" * 500), (102, "x" * 130 + "y"), (103, docs[3][1]), (104, None), (105, "")]
    # A passage that many documents share, with other words around it.
    docs += [(200 + i, text(rng.randint(0, 60)) + passages[-1] + text(rng.randint(0, 60))) for i in range(40)]
    return docs


@pytest.mark.parametrize(("crowd", "run_lines"), [(20_000, 100_000), (5, 40)])
def test_against_brute_force(spark, monkeypatch, crowd, run_lines):
    docs = made(7)
    monkeypatch.setattr(suffixes, "_RUN_LINES", run_lines)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = suffixes.without_repeated_bytes(df, crowd=crowd, part_bytes=20_000).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    want = brute(docs)
    assert {d: v for d, v in got.items() if v != want[d]} == {} and len(got) == len(want)


def test_runs_and_loser_tree():
    rng = random.Random(8)
    for k in (1, 2, 3, 5, 8, 13):
        lines = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 14))), rng.randint(0, 5), rng.randint(0, 9), 1) for _ in range(400)]
        runs = [sorted(lines[i::k]) for i in range(k)]
        merged = list(suffixes.merge([suffixes._decode_run(suffixes._encode_run(r)) for r in runs]))
        assert [m[1:4] for m in merged] == [x[:3] for x in sorted(lines)]
        for before, line in zip(merged, merged[1:], strict=False):
            assert line[0] == suffixes._shared(before[1], line[1], 0)
    assert list(suffixes.merge([])) == []


def test_long_text_is_cut_into_pieces(monkeypatch):
    rng = random.Random(9)
    raw = bytes(rng.choice(b"abcdef") for _ in range(9000))
    raw += raw[2000:2600]
    monkeypatch.setattr(suffixes, "_PIECE", 1000)
    windows = set()
    for _, g, _, count, _, first in suffixes._document_spans([b"", raw, raw[:99], raw[:150]], 100):
        assert len(g) == len(first)
        windows |= {(int(f) + q) for f, n in zip(first, count, strict=True) for q in range(n)}
    assert windows == set(range(len(raw) - 99))


def test_whole_table(spark, sf):
    from feedloom.llm.registry import load

    got = load()[0]["op10_suffix_merge_sort"](spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)))
    for d, (n, removed, stretches, kept) in want.items():
        assert list(got.loc[d]) == [n, removed, stretches, hashlib.sha256(kept).hexdigest()], d
    assert got.n_removed.sum() > 0


def test_odd_rows(spark):
    text = "a text of more than one hundred bytes, " * 4
    docs = spark.createDataFrame(
        [(None, text, 1), (1, text, 2), (1, text, 3), (2, "é" * 49 + "z", 4), (3, "é" * 49 + "z", 5), (4, "é" * 50, 6), (5, "é" * 50, 7)], "doc_id long, text string, first int"
    )
    rows = suffixes.without_repeated_bytes(docs).collect()
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in rows)
    own = brute([(1, text)])[1][1]
    assert got == [(0, 156, 0), (1, 156, own), (1, 156, own), (2, 99, 0), (3, 99, 0), (4, 100, 0), (5, 100, 100)]
    assert suffixes.digest_without_repeats(docs.filter(F.lit(False))).count() == 0
