from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.functions.stats import spearman_pvalue
from feedloom.operators import agreement, evaluation, labels, sampling
from feedloom.schemas import LABELS, PM_RANKINGS


def judged(spark):
    """Seven reviews, two themes apart from the truth and three sentiments; one of them has no prediction."""
    truth = ["Pricing", "Pricing", "Login & Account", "Notifications", "Notifications", "Notifications", "Other"]
    guess = ["Pricing", "Notifications", "Login & Account", "Notifications", "Pricing", "Notifications", None]
    mood = ["negative", "neutral", "positive", "neutral", "negative", "neutral", "positive"]
    felt = ["negative", "negative", "positive", "positive", "negative", "positive", None]
    evaluated = spark.createDataFrame(
        [(10 + i, f"review {i}", t, m) for i, (t, m) in enumerate(zip(truth, mood, strict=True))],
        "id bigint, cleaned_text string, true_theme string, true_sentiment string",
    )
    predictions = spark.createDataFrame(
        [(10 + i, "v1", t, m, 3, "why") for i, (t, m) in enumerate(zip(guess, felt, strict=True)) if t],
        "review_id bigint, prompt_version string, theme string, sentiment string, severity int, reasoning string",
    )
    return evaluation.judged(evaluated, predictions)


def test_accuracy_and_errors(spark):
    rows = judged(spark)
    cells = evaluation.confusion_cells(rows)
    acc = {r.field: (r.n, r.accuracy) for r in evaluation.accuracy(cells).collect()}
    assert acc["theme"] == (6, pytest.approx(4 / 6)) and acc["sentiment"] == (6, pytest.approx(3 / 6))
    assert sorted(r.id for r in evaluation.misclassified(rows).collect()) == [11, 13, 14, 15]
    report = {r.label: (r.precision, r.recall, r.support) for r in evaluation.class_report(cells).filter("field = 'theme'").collect()}
    assert report == {
        "Pricing": (0.5, 0.5, 2), "Login & Account": (1.0, 1.0, 1), "Notifications": (pytest.approx(2 / 3), pytest.approx(2 / 3), 3),
    }
    assert evaluation.confusion_matrix(cells).filter("field = 'theme'").count() == 9
    best = evaluation.compare_versions(rows).filter("best").collect()
    assert [(r.field, r.prompt_version) for r in best] == [("theme", "v1")]


def test_empty_evaluation_gives_no_rows(spark):
    assert evaluation.accuracy(evaluation.confusion_cells(judged(spark).filter(F.lit(False)))).count() == 0


def rankings(spark, rows):
    return spark.createDataFrame([(r, "app1", p, k, 5, None) for r, p, k in rows], PM_RANKINGS)


def test_agreement(spark):
    assert agreement.agreement(rankings(spark, [])).count() == 0
    assert agreement.agreement(rankings(spark, [("ines", f"p{i}", i) for i in range(4)])).count() == 0
    opposed = [("ines", f"p{i}", i) for i in range(7)] + [("juro", f"p{i}", 6 - i) for i in range(7)]
    row = agreement.agreement(rankings(spark, opposed)).first()
    assert row.spearman_rho == pytest.approx(-1.0) and row.n_reviewers == 2
    # The upper fives of seven share three.
    assert row.top5_jaccard_overlap == pytest.approx(3 / 7)


def test_spearman_with_ties_matches_pandas(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 6, 30), rng.integers(1, 6, 30)
    rows = [("a", f"p{i:02}", int(v)) for i, v in enumerate(a)] + [("b", f"p{i:02}", int(v)) for i, v in enumerate(b)]
    want = np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    assert agreement.spearman(rankings(spark, rows)).first().spearman_rho == pytest.approx(want, abs=1e-9)


def test_constant_ranks_have_no_correlation(spark):
    rows = [("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "y", 2)]
    assert agreement.spearman(rankings(spark, rows)).first().spearman_rho is None


@pytest.mark.parametrize("n", [3, 4, 5, 6, 9, 12])
def test_pvalue_matches_integration(spark, n):
    rho, dof = 0.43, n - 2
    t = rho * np.sqrt(dof / (1 - rho * rho))
    x = np.linspace(0, 1, 400001)[1:]
    # 2 * integral of the density from t to infinity, substituting s = t / x.
    s = t / x
    weight = (1 + s * s / dof) ** (-(dof + 1) / 2) * t / x**2
    import math
    const = math.gamma((dof + 1) / 2) / (math.sqrt(dof * math.pi) * math.gamma(dof / 2))
    want = 2 * const * np.trapezoid(weight, x)
    got = spark.range(1).select(spearman_pvalue(F.lit(rho), F.lit(n))).first()[0]
    assert got == pytest.approx(want, abs=2e-4)


def test_labels_upsert_and_delete(spark):
    def row(i, theme, at):
        return spark.createDataFrame([(i, theme, "positive", "tester", datetime.fromisoformat(at))], LABELS)

    table = labels.save_labels(spark.createDataFrame([], LABELS), row(1, "UI/UX", "2026-01-01"))
    table = labels.save_labels(table, row(1, "Pricing", "2026-01-02"))
    assert [r.theme for r in table.collect()] == ["Pricing"]
    assert labels.delete_labels(table, row(1, "x", "2026-01-01")).count() == 0


def test_stratified_sample_quota_and_repeatability(spark):
    rows = [(i, f"app{i % 2}", "A", (i % 5 + 1) if i % 11 else None, "t") for i in range(500)] + [(1000, "rare", "R", 1, "t")]
    df = spark.createDataFrame(rows, "id bigint, app_id string, app_name string, rating int, cleaned_text string")
    one = sampling.label_queue(df, 55)
    got = one.groupBy("app_id", "rating").count().collect()
    # 11 strata: 5 each, the rare one only has 1.
    assert sorted(r["count"] for r in got) == [1] + [5] * 10
    assert {r.id for r in one.collect()} == {r.id for r in sampling.label_queue(df.repartition(5), 55).collect()}


def test_folds_are_even_and_bounded_by_rows(spark):
    many = sampling.kfold_assign(spark.range(103).withColumnRenamed("id", "review_id"))
    assert sorted(r["count"] for r in many.groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]
    few = sampling.kfold_assign(spark.range(2).withColumnRenamed("id", "review_id"))
    assert sorted(r.fold for r in few.collect()) == [0, 1]
