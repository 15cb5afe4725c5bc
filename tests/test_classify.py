import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from feedloom.functions.text import cache_key
from feedloom.operators import classify, retrieval
from feedloom.plans.staging import stage_counting
from feedloom.schemas import MODEL_CACHE


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reviews(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "id bigint, cleaned_text string")


def empty_cache(spark):
    return spark.createDataFrame([], MODEL_CACHE).drop("created_at")


def test_cache_key_is_the_documented_hash(spark):
    got = spark.range(1).select(cache_key(F.lit("v1"), F.lit("hello"))).first()[0]
    assert got == hashlib.sha256(b"v1:hello").hexdigest()


def answer_all(prompt):
    """Every review of the batch is about pricing, the more severe the further down it stands."""
    n = sum(line.startswith("[") for line in prompt.rsplit("\nBATCH\n", 1)[1].split("\n"))
    answers = [dict(review_index=i, theme="Pricing", sentiment="neutral", severity=1 + i % 5, reasoning=f"line {i}") for i in range(n)]
    return json.dumps({"classifications": answers})


def never(prompt):
    raise AssertionError("no request expected")


def test_second_run_is_served_from_the_cache(spark):
    df = reviews(spark, ["costs too much now", "was cheaper in spring", "fair price", "costs too much now"])
    first = classify.classify_reviews(df, empty_cache(spark), "v1", classify.prompted_scorer(answer_all, "v1"))
    assert first["results"].count() == 4 and first["rejected"].count() == 0
    cache = first["new_cache"]
    assert cache.count() == 3
    counts = {}
    second = classify.classify_reviews(df, cache, "v1", classify.prompted_scorer(never, "v1"), progress=counts.update)
    rows = {r.review_id: (r.theme, r.severity, r.reasoning) for r in second["results"].collect()}
    assert rows == {r.review_id: (r.theme, r.severity, r.reasoning) for r in first["results"].collect()}
    assert rows[1] == rows[4] and len({r[2] for r in rows.values()}) == 3
    assert counts == {"total": 4, "hits": 4, "misses": 0}


def test_requests_hold_twenty_texts_in_order(spark):
    df = reviews(spark, [f"text {i}" for i in range(45)])
    split = classify.cache_split(classify.with_cache_key(df, "v1"), empty_cache(spark))
    sizes = [len(r["items"]) for r in classify.score_batches(classify.distinct_misses(split)).orderBy("batch_id").collect()]
    assert sizes == [20, 20, 5]


def test_an_invalid_answer_rejects_its_batch_only(spark):
    def answer(prompt):
        return "not json" if "text 3\n" in prompt else answer_all(prompt)

    out = classify.classify_reviews(
        reviews(spark, [f"text {i}" for i in range(6)]), empty_cache(spark), "v1", classify.prompted_scorer(answer, "v1", size=2)
    )
    assert sorted(r.review_id for r in out["results"].collect()) == [1, 2, 5, 6]
    assert sorted(r.review_id for r in out["rejected"].collect()) == [3, 4]


@pytest.mark.parametrize(
    "change,valid",
    [
        ({}, True), ({"severity": 5}, True), ({"severity": 0}, False), ({"severity": 6}, False), ({"severity": -1}, False),
        ({"theme": "Weather"}, False), ({"sentiment": "ecstatic"}, False), ({"reasoning": None}, False), ({"review_index": None}, False),
    ],
)
def test_validation(spark, change, valid):
    record = {"review_index": 0, "theme": "Notifications", "sentiment": "neutral", "severity": 3, "reasoning": "because", **change}
    record = {k: v for k, v in record.items() if v is not None}
    df = spark.createDataFrame([(0, json.dumps({"classifications": [record]}))], "batch_id bigint, response string")
    assert [r.row_valid for r in classify.parse_response(df).collect()] == [valid]


def test_coverage_and_repeated_index(spark):
    def item(i, theme):
        return {"review_index": i, "theme": theme, "sentiment": "neutral", "severity": 2, "reasoning": "r"}

    answers = [(0, [item(0, "Other"), item(1, "Pricing"), item(0, "UI/UX")]), (1, [item(0, "Other")]), (2, [item(0, "Other"), item(2, "Other")])]
    df = spark.createDataFrame([(b, json.dumps({"classifications": a})) for b, a in answers], "batch_id bigint, response string")
    sizes = spark.createDataFrame([(0, 2), (1, 2), (2, 2)], "batch_id bigint, n int")
    checked = classify.check_coverage(classify.parse_response(df), sizes)
    assert {r.batch_id: r.batch_valid for r in checked.collect()} == {0: True, 1: False, 2: False}
    last = {r.review_index: r.theme for r in classify.last_answers(checked.filter("batch_valid")).collect()}
    assert last == {0: "UI/UX", 1: "Pricing"}


def test_v3_needs_a_retriever_and_versions_are_known(spark):
    scorer = classify.lexicon_scorer(classify.lexicon_table(spark))
    with pytest.raises(ValueError, match="retriever"):
        classify.classify_reviews(reviews(spark, ["x"]), empty_cache(spark), "v3", scorer)
    with pytest.raises(ValueError, match="v9"):
        classify.classify_reviews(reviews(spark, ["x"]), empty_cache(spark), "v9", scorer)


def test_v3_shows_retrieved_examples_and_logs_them(spark):
    pool = spark.createDataFrame(
        [(101, "app crashes on start", "Performance & Crashes", "negative"), (102, "price is too high", "Pricing", "negative")],
        "review_id bigint, text string, theme string, sentiment string",
    )
    def answer(prompt):
        assert "\n    Performance & Crashes / negative <= app crashes on start\n" in prompt
        return answer_all(prompt)

    out = classify.classify_reviews(
        reviews(spark, ["it crashes on start"]), empty_cache(spark), "v3", classify.prompted_scorer(answer, "v3"),
        retriever=retrieval.text_retriever(pool, k=1),
    )
    assert out["results"].count() == 1
    assert out["retrievals"].first().examples[0].text == "app crashes on start"


def test_lexicon_scorer(spark):
    out = classify.classify_reviews(
        reviews(spark, ["The app crashes and freezes", "love it, great", "nothing known here"]),
        empty_cache(spark), "v1", classify.lexicon_scorer(classify.lexicon_table(spark)),
    )
    got = {r.review_id: (r.theme, r.sentiment, r.severity) for r in out["results"].collect()}
    assert got == {1: ("Performance & Crashes", "negative", 5), 2: ("Other", "positive", 1), 3: ("Other", "neutral", 1)}


def test_texts_are_scored_once_for_all_outputs(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def theme(text):
        calls.add(1)
        return "Other"

    def scorer(misses):
        return misses.select("cache_key", theme("text").alias("theme"), F.lit("neutral").alias("sentiment"), F.lit(1).alias("severity"), F.lit("r").alias("reasoning"))

    out = classify.classify_reviews(reviews(spark, ["a", "b", "a"]), empty_cache(spark), "v1", scorer)
    assert (out["results"].count(), out["rejected"].count(), out["new_cache"].count()) == (3, 0, 2)
    out["results"].collect(), out["new_cache"].collect()
    assert calls.value == 2


@pytest.mark.parametrize("sent_out", [True, False])
def test_cached_answers_with_repeated_and_null_texts(spark, monkeypatch, sent_out):
    if not sent_out:
        monkeypatch.setattr(classify, "small_side", lambda df: None)
    df = reviews(spark, ["a", "b", "a", None, "c"])
    key = lambda t: hashlib.sha256(f"v1:{t}".encode()).hexdigest()
    answer = ("Other", "neutral", 1, "known")
    answers = "struct<theme:string,sentiment:string,severity:int,reasoning:string>"
    cache = spark.createDataFrame([(key("a"), answer), (None, answer), (key("z"), answer)], f"cache_key string, response {answers}")
    counts = {}
    out = classify.classify_reviews(df, cache, "v1", classify.lexicon_scorer(classify.lexicon_table(spark)), progress=counts.update)
    assert counts == {"total": 5, "hits": 2, "misses": 3}
    got = sorted((r.review_id, r.reasoning) for r in out["results"].collect())
    assert got == [(1, "known"), (2, "0 known terms in the text"), (3, "known"), (5, "0 known terms in the text")]


def test_words_of_a_large_lexicon_travel_with_a_short_key(spark, monkeypatch):
    texts = spark.createDataFrame(
        [("k1", "The app crashes and freezes"), ("k2", "love it, great"), ("k3", ""), ("k4", None), (None, "slow")], "cache_key string, text string"
    )
    lexicon = classify.lexicon_table(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    small = rows(classify.classify_lexicon(texts, lexicon))
    monkeypatch.setattr(classify, "MAX_BROADCAST_TERMS", 1)
    found = classify.classify_lexicon(texts, lexicon)
    assert rows(found) == small
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    words = next(line for line in plan.split("\n") if "Generate explode" in line)
    assert "cache_key" not in words.rsplit("[", 1)[0] and "_key_a" in plan


def test_raw_response_is_json_of_the_four_fields(spark):
    scored = spark.createDataFrame([(1, "UI/UX", "positive", 1)], "review_id bigint, theme string, sentiment string, severity int")
    raw = json.loads(classify.classification_rows(scored, "v1").first().raw_response)
    assert raw == {"theme": "UI/UX", "sentiment": "positive", "severity": 1, "reasoning": None}


def test_model_runs_in_a_session_that_has_observed_something(spark):
    labelled = spark.createDataFrame([("slow and slow", "Other"), ("nice design", "UI/UX"), ("slow app", "Other"), ("design", "UI/UX")], "text string, label string")
    assert stage_counting(labelled, "seen")[1] == 4
    texts = spark.createDataFrame([(1, "a nice design"), (2, "so slow"), (3, "")], "id int, text string")
    found = classify.classify_model(texts, classify.train_theme_model(labelled, features=64), "id").collect()
    assert {r.id: r.predicted for r in found if r.id < 3} == {1: "UI/UX", 2: "Other"} and len(found) == 3
