import pytest
from pyspark.sql import functions as F

from feedloom.operators import painpoints, prioritize

SCHEMA = "theme string, review_count int, weighted_severity double, last_30_count int, prev_30_count int, reach_sum int"
# Spread by hand so that every scaled value is a round one: counts 2 to 42, severities 1.5 to 4.5, reach 10 to 210.
ROWS = [("calm", 2, 1.5, 1, 3, 10), ("steady", 12, 4.5, 6, 6, 60), ("loud", 42, 3.0, 30, 12, 210), ("new", 22, 2.25, 4, 0, 110)]


def scored(spark, rows=ROWS, **params):
    return {r.theme: r for r in prioritize.score_pain_points(spark.createDataFrame(rows, SCHEMA), scope=(), **params).collect()}


def test_component_scores(spark):
    got = scored(spark)
    assert {t: r.frequency_score for t, r in got.items()} == {"calm": 0.0, "steady": 25.0, "loud": 100.0, "new": 50.0}
    assert {t: r.reach_score for t, r in got.items()} == {"calm": 0.0, "steady": 25.0, "loud": 100.0, "new": 50.0}
    # Severity has fixed ends, 1 and 5.
    assert [got[t].severity_score for t in ("calm", "steady", "loud", "new")] == [12.5, 87.5, 50.0, 31.25]
    assert got["steady"].trend_score == 50.0 and got["calm"].trend_score < 50.0 < got["new"].trend_score
    w = prioritize.DEFAULT_WEIGHTS
    for r in got.values():
        assert r.priority_score == pytest.approx(sum(w[k] * r[f"{k}_score"] for k in w))


def test_alone_or_none(spark):
    (only,) = scored(spark, [("calm", 7, 2.0, 0, 0, 3)]).values()
    assert only.frequency_score == only.reach_score == 100.0 and only.severity_score == 25.0
    nothing = prioritize.score_pain_points(spark.createDataFrame([], SCHEMA), scope=())
    assert nothing.count() == 0 and {f"{k}_score" for k in ("frequency", "severity", "trend", "reach", "priority")} <= set(nothing.columns)


def test_weights(spark):
    reach = {"frequency": 0, "severity": 0, "trend": 0, "reach": 1}
    df = prioritize.score_pain_points(spark.createDataFrame(ROWS, SCHEMA), reach, ())
    ranked = prioritize.rank_backlog(df, (), ("theme",)).orderBy("backlog_rank")
    assert [r.theme for r in ranked.collect()] == ["loud", "new", "steady", "calm"]
    assert {r.priority_score for r in scored(spark, weights=dict.fromkeys(reach, 0)).values()} == {0.0}


def test_ranks_are_distributed_and_per_scope(spark):
    rows = [(f"app{i % 3}", "v1", f"t{i}", 0, float((i * 37) % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "app_id string, prompt_version string, theme string, cluster_label int, priority_score double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prioritize.rank_backlog(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for app in ("app0", "app1", "app2"):
        mine = sorted((r for r in got if r.app_id == app), key=lambda r: r.backlog_rank)
        assert [r.backlog_rank for r in mine] == list(range(1, 101))
        assert [(-r.priority_score, r.theme) for r in mine] == sorted((-r.priority_score, r.theme) for r in mine)


@pytest.mark.parametrize("rows,expected", [([(5, 1), (1, 5)], 26 / 6), ([(4, 6), (2, 6)], 3.0), ([(4, None), (2, None)], 3.0), ([(5, 1), (1, None)], 5.0)])
def test_weighted_severity(spark, rows, expected):
    df = spark.createDataFrame(rows, "severity int, rating int")
    assert df.agg(painpoints.weighted_severity(F.col("severity"), F.col("rating"))).first()[0] == pytest.approx(expected)


def test_window_edges(spark):
    days = ["2026-01-31", "2026-02-01", "2026-01-02", "2026-01-01", "2025-12-03", "2025-12-02", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    counts = painpoints.window_counts(F.col("d"), F.lit("2026-01-31").cast("date"))
    row = df.agg(*[c.alias(n) for n, c in counts.items()]).first()
    # (Jan 1, Jan 31] and (Dec 2, Jan 1]
    assert (row.last_30_count, row.prev_30_count) == (2, 2)


def test_texts_of_clusters_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        calls.add(1)
        return text

    rows = [(i, "app", "v1", "Other", i % 2, f"word{i % 2} text{i}", 1, 3, 1, "2024-01-01") for i in range(6)]
    labelled = spark.createDataFrame(
        rows, "review_id bigint, app_id string, prompt_version string, theme string, cluster_label int, raw string, severity int, rating int, thumbs_up int, day string"
    ).select("*", clean("raw").alias("cleaned_text"), F.col("day").cast("date").alias("review_date"))
    built = painpoints.assemble(labelled, F.lit("2024-01-31").cast("date"))
    assert sorted((r.cluster_label, r.review_count, len(r.example_review_ids)) for r in built.collect()) == [(0, 3, 3), (1, 3, 3)]
    assert calls.value == 6
    summaries = painpoints.summarize_clusters(labelled)
    assert sorted(r.summary for r in summaries.collect()) == ["word0 text0", "word1 text1"]
    assert calls.value == 12
