import numpy as np
import oracle
import pandas as pd
from feedloom.llm import quality_rules, ranking
from feedloom.llm.registry import load
from pyspark.sql import functions as F


def test_rules_against_sql(spark, sf):
    queries, oracles = load()
    name = "op2_language_divergence"
    assert oracle.difference(spark, oracle.connect(sf), name, queries[name], oracles[name], sf) is None


def test_rules_keep_good_and_reject_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    labelled = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    judged = labelled[~labelled.base_failed]
    assert judged[judged.quality == 1].kept.mean() >= 0.99
    assert labelled[labelled.quality == 0].kept.mean() <= 0.1


def test_rules_on_odd_rows(spark):
    plain = " ".join(["the", "river", "of", "stone", "and", "a", "field", "is", "to", "go"][i * i % 10] + str(i) for i in range(120))
    docs = spark.createDataFrame(
        [(1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, "one two", None), (4, "one two", None), (5, plain, "en"), (None, plain, "en"),
         (6, "a b c " * 200, "en"), (7, "x\nx\n\n y\n y\nx", "xx"), (8, "ü#" * 20_000, "en")],
        "doc_id long, text string, lang string",
    ).withColumn("words", F.lit(1))
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs).collect()}
    assert rows[1, 0].kept is False and rows[2, 0].base_failed and rows[3, 0].word_chars == 0
    assert rows[6, 600].n_repeat_words == 600 and rows[6, 600].base_failed
    assert rows[7, 5].n_dup_lines == 3 and rows[7, 5].word_chars == 5
    assert rows[8, 1].n_symbols == 20_000 and rows[8, 1].word_chars == 40_000
    assert rows[5, 120].base_failed is False
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 5} - ({5} if not rows[5, 120].kept else set())
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0 and quality_rules.keep_good(docs.limit(0)).count() == 0


def test_ranking_on_held_out_documents(spark):
    got = load()[0]["op1_bradley_terry"](spark, "/root/testdata/sf0.01").toPandas()
    labelled = got.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    fresh = labelled[labelled.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (fresh.predicted == fresh.quality).mean() >= 0.95
    good, bad = fresh[fresh.quality == 1].score.to_numpy(), fresh[fresh.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() >= 0.97
    assert 0.1 < got.held_out.mean() < 0.3


def test_ranking_on_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "fine words in a row"), (2, "###"), (3, None), (4, ""), (None, "fine"), (1, "fine words in a row")], "doc_id long, text string"
    ).withColumn("label", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    fitted = ranking.fit(docs, labels)
    rows = ranking.score(docs, fitted).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.predicted for r in rows if r.doc_id in (1, 2)} == {1: 1, 2: 0}
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    alone = ranking.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in ranking.score(docs, alone).collect()} == {0.5}
    assert ranking.score(docs.limit(0), fitted).count() == 0
    assert np.isfinite(ranking.features("")).all() and len(ranking.features("a")) == len(ranking.FEATURES)
