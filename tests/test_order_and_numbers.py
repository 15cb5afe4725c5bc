"""Which row counts as first or last, and numbers as files write them."""

import json
import os

from pyspark.sql import functions as F

from feedloom.operators import classify, reporting, retrieval
from feedloom.sources import readers
from feedloom.streaming.ingest import ingest_stream


def dump_line(key, text):
    return json.dumps({"reviewId": key, "userName": "u", "score": 3, "thumbsUpCount": 1, "content": text, "at": "2025-01-01 10:00:00"})


def test_the_older_file_of_a_batch_wins(spark, tmp_path):
    dump = tmp_path / "dump"
    dump.mkdir()
    # The newer file is larger and has the earlier name, so neither size nor name decides.
    (dump / "b.json").write_text("\n".join([dump_line("r1", "from the older file"), dump_line("r1", "its repeat")]))
    (dump / "a.json").write_text("\n".join([dump_line("r1", "from the newer file " * 50), dump_line("r2", "only here")]))
    os.utime(dump / "b.json", (1_700_000_000, 1_700_000_000))
    os.utime(dump / "a.json", (1_700_000_100, 1_700_000_100))
    ingest_stream(spark, str(dump), str(tmp_path / "out"), str(tmp_path / "progress"), "app", "App").awaitTermination()
    stored = {r.review_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stored == {"r1": "from the older file", "r2": "only here"}


def test_csv_numbers(spark, tmp_path):
    (tmp_path / "in.csv").write_text("stars,body,up\n4.0,fine,3.0\nfive,odd,many\n2,plain,7\n,none,\n1e30,huge,2.9\n")
    got = readers.read_mapped_csv(spark, str(tmp_path / "in.csv"), {"rating": "stars", "text": "body", "thumbs_up": "up"}, "app", "App")
    assert {r.text: (r.rating, r.thumbs_up) for r in got.collect()} == {
        "fine": (4, 3), "odd": (None, 0), "plain": (2, 7), "none": (None, 0), "huge": (None, 2),
    }


def test_the_later_row_wins_whatever_it_holds(spark):
    scored = spark.createDataFrame(
        [(1, "UI/UX", "positive", 1, "z", 1), (1, "Pricing", "neutral", 2, "a", 2)],
        "review_id bigint, theme string, sentiment string, severity int, reasoning string, turn int",
    )
    old = classify.classification_rows(scored.limit(0), "v1")
    assert [r.theme for r in classify.store_classifications(old, scored, "v1", "turn").collect()] == ["Pricing"]
    log = spark.createDataFrame([(1, "v3", ["z"], 1), (1, "v3", ["a"], 2)], "review_id bigint, prompt_version string, examples array<string>, turn int")
    assert [r.examples for r in retrieval.store_retrievals(log.drop("turn").limit(0), log, "turn").collect()] == [["a"]]


def test_null_theme_and_subtotal_stay_apart(spark):
    df = spark.createDataFrame([("a", None, "positive"), ("a", None, None), ("a", "Pricing", "positive")], "app_id string, theme string, sentiment string")
    rows = reporting.theme_sentiment_breakdown(df).filter("app_id = 'a' and theme is null and sentiment is null")
    assert sorted((r.level, r.n) for r in rows.collect()) == [(0, 1), (1, 2), (2, 3)]
    total = reporting.theme_sentiment_breakdown(df).filter(F.col("level") == 3).first()
    assert total.n == 3
