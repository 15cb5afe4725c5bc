import numpy as np
import pandas as pd
from feedloom.llm.hash_forest import nearest
from pyspark.sql import functions as F


def brute(ids, x, asks, k=10):
    out = {}
    for i in np.flatnonzero(asks):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], d[others]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in best]
    return out


def grouped(frame):
    got = {}
    for r in frame.sort_values(["query_id", "rank"]).itertuples():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    return got


def test_recall_on_the_whole_table(spark, sf):
    from feedloom.llm.registry import load

    got = grouped(load()[0]["op8_hash_prefix_forest"](spark, sf).toPandas())
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x = np.stack(e.embedding.to_numpy()).astype("float64")
    want = brute(e.vec_id.to_numpy(), x, e.vec_id.to_numpy() % 100 == 0)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hit) >= 0.9
    true = {(q, i): d for q in want for i, d in want[q]}
    assert all(abs(d - true[q, i]) < 1e-12 for q in got for i, d in got[q] if (q, i) in true)


def test_many_blocks_clusters_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.05 * rng.normal(size=(100, 8)) for c in rng.normal(size=(8, 8))] + [np.repeat(rng.normal(size=(1, 8)), 400, 0)])
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    odd = [(9000, None, "z"), (9100, [0.0] * 8, "z"), (9200, [1.0] * 7 + [float("nan")], "z"), (9300, [1.0] * 7 + [None], "z"),
           (9400, [1.0, 2.0], "z"), (None, [1.0] * 8, "z"), (9500, [float("inf")] * 8, "z"), (9600, [], "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, block string")
    got = grouped(nearest(df, F.col("vec_id") % 50 == 0, block_rows=150).toPandas())
    want = brute(np.arange(len(x)), x, np.arange(len(x)) % 50 == 0)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.95
    assert [i for i, _ in got[850]] == list(range(800, 810))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = grouped(nearest(df, F.col("vec_id") == 0).toPandas())
    assert got == {0: [(2, 1.0), (1, np.sqrt(2.0))]}
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df.limit(1), F.lit(True)).count() == 0
