import hashlib
import random
import re

import pandas as pd
from feedloom.llm import secrets
from pyspark.sql import functions as F

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(found)]


def check(rows, texts):
    for row in rows.itertuples():
        want = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), row
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if not s.startswith("markov")] == want


def test_whole_table(spark, sf):
    from feedloom.llm.registry import load

    got = load()[0]["op7_markov_secrets"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert len(got) == len(docs)
    check(got, dict(zip(docs.doc_id, docs.text, strict=True)))
    assert got.base_sha256.nunique() > 1


def test_odd_texts_and_added_spans(spark):
    parts = ["tion", "er", "ou", "ing", "and", "ble", "here", "son", "ly", "ea"]
    rng = random.Random(4)
    word = " ".join("".join(rng.choice(parts) for _ in range(9)) for _ in range(300))
    key = hashlib.sha256(b"x").hexdigest()
    texts = {
        1: None,
        2: "",
        3: f'ü password: "{key[:30]}" and AKIA{"Z9" * 8} é token=short secret=token:{key} AKIA12',
        4: f"{word} Zk3v9QwLr7Tb2XcP5nHs {word}",
        5: word,
        6: "api_key = " + "a1b2c3d4e5f60718" * 4 + " passwd='" + "9f8e7d6c5b4a3210" * 3,
        7: "TOKEN :: x token=" + "q" * 11 + " token=secret=" + "0123456789abcdef" * 2,
        8: ("ordinary words here " * 3000) + "PassWord=" + key,
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, base string")
    out = secrets.scan(docs)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    rows = out.select(
        "doc_id",
        *[n(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    ).toPandas()
    assert len(rows) == len(texts)
    check(rows, texts)
    spans = dict(zip(rows.doc_id, rows.spans, strict=True))
    at = texts[4].index("Zk3v")
    assert spans[4] == f"markov:{at}:{at + 20}" and spans[5] == "" and spans[1] == ""
    masked = {r.doc_id: r.text for r in secrets.mask(docs, out).collect()}
    assert "Zk3v" not in masked[4] and masked[5] == texts[5] and key not in masked[8]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_models_without_samples_add_nothing(spark):
    docs = spark.createDataFrame([(1, "Zk3v9QwLr7Tb2XcP5nHs alone")], "doc_id long, text string")
    assert secrets.scan(docs).first().spans == []


def test_models_decide_on_every_run(spark):
    rng = random.Random(11)
    parts = ["tion", "er", "ou", "ing", "and", "ble", "here", "son", "ly", "ea"]
    word = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(4, 9))) for _ in range(600))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    draw = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    runs = [draw(mixed, 24), draw(mixed[:26], 32), draw("0123456789", 15), draw(mixed + "0123456789", 13)]
    docs = spark.createDataFrame([(i, f"{word} {run} {word}") for i, run in enumerate(runs)] + [(9, word)], "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.spans] for r in secrets.scan(docs).collect()}
    assert got == {**{i: [run] for i, run in enumerate(runs)}, 9: []}
