import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import retrieval, sampling
from feedloom.plans import knn, layout, lsh
from feedloom.plans.knn import knn_join


def vectors(spark, n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 3, size=(n, 1))
    x[: copies] = x[0]
    rows = [(i, [float(v) for v in x[i]], i % 4) for i in range(n)]
    return x, spark.createDataFrame(rows, "id bigint, embedding array<double>, fold int")


@pytest.mark.parametrize("block_rows,copies", [(20000, 0), (7, 0), (7, 40)])
def test_neighbour_join_is_exact(spark, block_rows, copies):
    """Also with small blocks and with a third of all rows equal."""
    x, df = vectors(spark, 120, 3, 5, copies)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    fold = np.arange(120) % 4
    d[fold[:, None] == fold[None]] = np.inf
    got = knn_join(df, df, 3, exclude="fold", block_rows=block_rows).toPandas().sort_values(["qid", "rank"])
    want = [(i, j) for i in range(120) for j in sorted(range(120), key=lambda j: (d[i, j], j))[:3]]
    assert np.allclose(got.distance.to_numpy().reshape(-1, 3), np.sort(d, axis=1)[:, :3], atol=1e-12)
    assert list(zip(got.qid, got.pid)) == want


def test_rows_meet_few_blocks_however_small_these_are(spark, monkeypatch):
    """In many dimensions nearly every cell is visited, so many small cells would move the square of the pool."""
    x, df = vectors(spark, 400, 16, 6)
    routed, route = [], knn._route
    monkeypatch.setattr(knn, "_route", lambda *args: routed.append(route(*args)) or routed[-1])
    got = knn_join(df, df, 3, exclude="id", block_rows=5).toPandas().sort_values(["qid", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert list(zip(got.qid, got.pid)) == [(i, j) for i in range(400) for j in np.argsort(d[i], kind="stable")[:3]]
    assert routed[0].count() <= 2 * 8 * 400


def test_groups_never_mix(spark):
    x, df = vectors(spark, 60, 2, 8)
    got = knn_join(df, df, 2, group="fold", exclude="id", block_rows=5).toPandas()
    assert len(got) == 120 and (got.qid % 4 == got.pid % 4).all() and (got.qid != got.pid).all()


def test_fewer_rows_than_k_and_empty_pool(spark):
    _, df = vectors(spark, 3, 2, 1)
    assert knn_join(df, df, 5, exclude="id").count() == 6
    assert knn_join(df, df.filter(F.lit(False)), 3).count() == 0


def labelled(spark, n=40):
    rows = [(i, f"word{i % 7} text number {i} about thing{i % 3}", f"theme{i % 3}", "negative") for i in range(n)]
    return spark.createDataFrame(rows, "review_id bigint, text string, theme string, sentiment string")


def test_kfold_retrieval_never_leaks(spark):
    folded = sampling.kfold_assign(retrieval.embed_texts(labelled(spark), dim=16))
    near = retrieval.kfold_retrieve(folded)
    row = retrieval.leakage_check(near, folded).first()
    assert (row.retrieved, row.leaks) == (120, 0)


def test_one_row_has_no_pool(spark):
    folded = sampling.kfold_assign(retrieval.embed_texts(labelled(spark, 1), dim=16))
    near = retrieval.kfold_retrieve(folded)
    assert retrieval.examples_per_query(near, folded, folded).first().examples == []


def test_holdout_of_the_whole_pool_is_empty(spark):
    rows = retrieval.embed_texts(labelled(spark), dim=16)
    assert retrieval.holdout_retrieve(rows, rows).count() == 0


def test_user_embedder_runs_in_chunks(spark):
    def embed(texts):
        assert len(texts) <= 3
        return [[float(len(t)), 1.0] for t in texts]

    got = retrieval.embed_with(labelled(spark, 10), embed, batch=3).collect()
    assert all(r.embedding == [float(len(r.text)), 1.0] for r in got)


def test_rows_without_an_exclusion_label_pair_with_all(spark):
    rows = [(i, [float(i), 0.0], None if i % 2 else 7) for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, part bigint")
    for block in (100, 4):
        got = {}
        for r in knn.knn_join(df, df, 2, exclude="part", block_rows=block).collect():
            got.setdefault(r.qid, []).append((r.rank, r.pid, r.px))
        # Even rows never see even ones; odd rows have no label and see all, themselves first.
        assert [p for _, p, _ in sorted(got[4])] == [3, 5] and all(x is None for _, _, x in got[4])
        assert [p for _, p, _ in sorted(got[5])] == [5, 4]


def test_one_block_pool_needs_no_cross_product(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "id bigint, embedding array<double>")
    plan = knn.knn_join(df, df, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_index_finds_most_of_the_exact_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 2
    vectors = centres[rng.integers(0, 30, 1_500)] + rng.normal(size=(1_500, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(9_000, None)]
    pool = spark.createDataFrame(rows, "review_id long, embedding array<double>")
    index = lsh.fit(pool, bucket_rows=40)
    assert index.planes.shape[1] == 6 and index.rows.count() == 1_500 * lsh.TABLES
    queries = pool.filter("review_id % 10 = 0")
    found = retrieval.retrieve_approximate(queries, index, 5)
    exact = retrieval.retrieve_top_k(queries.withColumn("own", F.col("review_id")), pool.withColumn("own", F.col("review_id")), 5, exclude="own")
    told = lsh.recall(found, exact).first()
    assert told.exact == 750 and told.recall >= 0.9
    # What is found has its true distance; cutting buckets into blocks changes nothing.
    true = {(r.query_id, r.neighbor_id): r.distance for r in exact.collect()}
    got = {(r.query_id, r.neighbor_id): r.distance for r in found.collect()}
    assert all(abs(d - true[p]) < 1e-9 for p, d in got.items() if p in true)
    cut = retrieval.retrieve_approximate(queries, index, 5, block_rows=7).collect()
    assert {(r.query_id, r.neighbor_id) for r in cut} == set(got)
    assert retrieval.retrieve_approximate(queries, lsh.fit(pool.filter("false")), 5).count() == 0


def test_tfidf_weighs_rare_words_more(spark):
    pool = spark.createDataFrame([(1, "common word"), (2, "common thing"), (3, "common rare"), (4, None)], "id long, text string")
    idf = retrieval.fit_idf(pool)
    assert idf.count() == 5
    ask = spark.createDataFrame([(1, "common rare"), (2, "unseen"), (3, ""), (4, None), (5, "rare common rare")], "id long, text string")
    got = {r.id: r.embedding for r in retrieval.embed_tfidf(ask, idf, "id", dim=4096).collect()}
    assert set(got) == {1, 2, 5} and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())
    weights = sorted(abs(x) for x in got[1] if x)
    assert len(weights) == 2 and weights[1] / weights[0] > 1.5


def test_only_rare_words_meet_a_large_idf_table_by_shuffle(spark, monkeypatch):
    rows = [(i, "common word thing " * 30 + f"rare{i} new{i % 5}") for i in range(40)] + [(40, "unseen1 unseen2"), (40, "rare1"), (None, "rare2")]
    df = spark.createDataFrame(rows, "id long, text string")
    idf = retrieval.fit_idf(df.filter("id < 40"))
    vectors = lambda: {r.id: [round(x, 9) for x in r.embedding] for r in retrieval.embed_tfidf(df, idf, "id", dim=16).collect()}
    want, staged, stage = vectors(), {}, retrieval.stage
    monkeypatch.setattr(retrieval, "small_side", lambda idf: None)
    monkeypatch.setattr(retrieval, "common_part", lambda *args: layout.common_part(*args, rows=10))
    monkeypatch.setattr(retrieval, "stage", lambda part, name: staged.setdefault(name, stage(part, name)))
    assert vectors() == want and set(want) == {None, *range(41)}
    assert 3 <= staged["idf-common"].count() <= 10
    assert staged["tfidf-places"].filter("left_over is not null").count() <= 2 * 43


def test_queries_under_one_code_are_cut_into_blocks(spark, monkeypatch):
    rng, kernel, block = np.random.default_rng(4), lsh._search, 60
    vectors = np.concatenate([np.zeros((300, 8)), rng.normal(size=(60, 8)).astype("float32"), rng.normal(size=(60, 8))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    pool = spark.createDataFrame(rows, "review_id long, embedding array<double>").repartition(3)
    index = lsh.fit(pool, tables=3, bucket_rows=40)
    want = {tuple(r) for r in retrieval.retrieve_approximate(pool, index).collect()}

    def narrow(k, by_edge):
        search = kernel(k, by_edge)

        def checked(queries, rows):
            assert max(len(queries), len(rows)) <= 3 * block
            return search(queries, rows)

        return checked

    monkeypatch.setattr(lsh, "_search", narrow)
    got = {tuple(r) for r in retrieval.retrieve_approximate(pool, index, block_rows=block).collect()}
    assert got == want and len({q for q, *_ in got}) > 300
    monkeypatch.setattr(lsh, "_CODED_AT_ONCE", 50)
    assert {tuple(r) for r in retrieval.retrieve_approximate(pool, index, block_rows=block).collect()} == want
    # The pool's vectors come back exactly, in whatever precision they travel.
    true = {i: v for i, v in enumerate(vectors)}
    assert all(d == ((true[q] - true[p]) ** 2).sum() or abs(d - ((true[q] - true[p]) ** 2).sum()) < 1e-12 for q, p, d, _ in want)
