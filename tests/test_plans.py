"""Plan shapes on uneven data: one group holds most rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import cleaning, painpoints
from feedloom.plans.links import follow, topmost
from feedloom.plans.ordering import grouped_position, grouped_running, seeded_position
from feedloom.plans.skew import attach


@pytest.fixture(params=["coalesced", "many blocks"])
def layout(spark, request):
    """Also with as many blocks as there are shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, str(request.param == "coalesced").lower())
    yield request.param
    spark.conf.set(key, "true")


def uneven(spark, n=400):
    rows = [("hot" if i % 4 else f"g{i % 12}", i, (i * 7919) % 1009, float((i * 31) % 17)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id bigint, o int, x double").repartition(5)


def test_positions_and_running_values(spark, layout):
    rows, df = uneven(spark)
    placed = {r.id: r.position for r in grouped_position(df, ["g"], [F.col("o"), F.col("id")]).collect()}
    running = grouped_running(df, ["g"], [F.col("o"), F.col("id")], {"s": F.col("x")}, {"m": F.col("x")}).collect()
    got = {r.id: (r.s, r.m) for r in running}
    for g in {r[0] for r in rows}:
        total, peak = 0.0, float("-inf")
        for place, (_, i, _, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1):
            total, peak = total + x, max(peak, x)
            assert placed[i] == place and got[i] == (total, peak)


def test_seeded_positions_are_exact_with_and_without_a_limit(spark, layout):
    rows, df = uneven(spark)
    want = {}
    for g in {r[0] for r in rows}:
        order = sorted((hashlib.md5(f"42:{r[1]}".encode()).hexdigest(), r[1]) for r in rows if r[0] == g)
        want.update({i: n for n, (_, i) in enumerate(order, 1)})
    assert {r.id: r.position for r in seeded_position(df, ["g"], ["id"]).collect()} == want
    few = {r.id: r.position for r in seeded_position(df, ["g"], ["id"], limit=5).collect()}
    assert few == {i: n for i, n in want.items() if n <= 5}


def test_attach_keeps_every_row_once(spark):
    rows, df = uneven(spark)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("g <> 'g4'")
    inner, left = attach(df, sizes, ["g"], ["id"]), attach(df, sizes, ["g"], ["id"], "left")
    assert left.count() == len(rows) and inner.count() == sum(r[0] != "g4" for r in rows)
    assert left.filter("n is null").select("g").distinct().collect()[0].g == "g4"


def test_pointers(spark):
    # A long path, and a star on node 500.
    links = [(0, 0)] + [(i, i - 1) for i in range(1, 100)] + [(i, 500) for i in range(500, 600)]
    roots = follow(spark.createDataFrame(links, "node bigint, parent bigint"))
    assert {r.node: r.root for r in roots.collect()} == {n: 0 if n < 100 else 500 for n, _ in links}
    chain = [("a", None, None), ("b", "a", None), ("c", "b", "on b"), ("d", "c", "on c"), ("e", "d", None)]
    labels = topmost(spark.createDataFrame(chain, "node string, parent string, label string"))
    assert {r.node: r.label for r in labels.collect()} == {"a": None, "b": None, "c": "on b", "d": "on b", "e": "on b"}


def test_a_hot_text_is_folded_before_the_shuffle(spark):
    rows = [("a", "the app is great" if i % 3 else f"the app is great {i}", "2026-01-01", i) for i in range(300)]
    df = spark.createDataFrame(rows, "app_id string, text string, review_date string, n int").repartition(6)
    kept = cleaning.clean_and_filter(df, ["n"])
    assert sorted(r.n for r in kept.collect()) == sorted([1] + [i for i in range(300) if i % 3 == 0])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_user_summaries(spark):
    rows = [("a", "v1", "Pricing", c, i, f"text {i}") for i in range(30) for c in [i % 2]]
    df = spark.createDataFrame(rows, "app_id string, prompt_version string, theme string, cluster_label int, review_id bigint, cleaned_text string")

    def answer(prompt):
        shown = prompt.count("\n- ")
        if "- text 1\n" in prompt:
            return "no json"
        return json.dumps({"title": f"{shown} texts", "summary": "s", "next_step": "n"})

    got = painpoints.summarize_with(df, answer).collect()
    assert [(r.cluster_label, r.title) for r in got] == [(0, "10 texts")]
