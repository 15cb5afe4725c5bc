import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from feedloom.llm import trie
from pyspark.sql import functions as F

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return own, out


def brute_trie(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, out = defaultdict(list), []
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(sums[k][0] for k in children[node]) or 1
        sums[node] = (leaves, (len(members[node]) - 1) * words + sum(sums[k][1] for k in children[node]))
    for node, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


def make(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("small", [7, trie.SMALL])
def test_uneven_shapes(spark, small):
    rng = random.Random(5)
    rows = [(0, t, "user", f"word {t % 3}") for t in range(60)]  # one long chain
    for c in range(1, 50):
        start = ["hello there"] if c % 3 else []  # a first turn that most share
        rows += [(c, t, "user", x) for t, x in enumerate(start + [rng.choice("abc") for _ in range(rng.randrange(1, 6))])]
    own, rebuilt = brute_rebuilt(rows)
    assert found(trie.conversation_trie(make(spark, rows), True, small)) == brute_trie(rebuilt)
    if small == 7:
        assert found(trie.conversation_trie(make(spark, rows), False, small)) == brute_trie(own)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody"), (5, None, None, None), (5, 2, "user", ""), (5, 2, "assistant", "b c"), (6, 1, "user", "x"),
        (6, 1, "user", "x"), (-7, 1, "user", "x"), (40, 3, "user", "a  b\tc"), (41, 1, "u", "é 𝔘"), (47, 9, "", "long " * 50_000),
    ]
    docs = make(spark, rows).withColumn("depth", F.lit("clash")).withColumn("pos", F.lit(3)).withColumn("n", F.lit(None).cast("int"))
    _, rebuilt = brute_rebuilt(rows)
    assert any(not ts for ts in rebuilt.values())  # a conversation that loses all its turns is still a member of the top
    assert found(trie.conversation_trie(docs, True)) == brute_trie(rebuilt)
    assert found(trie.conversation_trie(docs.filter("false"), True)) == []


def test_many_endings_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 3)
    rows = [(c, 0, "user", "same") for c in range(1000, 1100)]
    assert found(trie.conversation_trie(make(spark, rows))) == brute_trie({c: [("user", "same")] for c in range(1000, 1100)})


def test_local_rounds_agree_with_plain_sums():
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        parent = [-1] + [rng.randrange(max(0, i - 3), i) for i in range(1, n)]
        values = [rng.randrange(100) for _ in range(n)]
        plain, weight = values[:], [rng.randrange(1, 4) for _ in range(n)]
        for i in range(n - 1, 0, -1):
            plain[parent[i]] += plain[i]
            weight[parent[i]] += weight[i]
        sums = [[0] * n]
        trie.decompose(parent, weight, sums, [values])
        assert sums[0] == plain
