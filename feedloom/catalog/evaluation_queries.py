"""Evaluation and reviewer-agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import query
from feedloom.catalog.inputs import judgements, rankings, table, with_tables
from feedloom.operators import agreement, evaluation

CELLS = """, long as (select prompt_version, 'theme' as field, true_theme as true_label, theme as pred_label from judged
    union all select prompt_version, 'sentiment', true_sentiment, sentiment from judged),
cells as (select prompt_version, field, true_label, pred_label, count(*) as n from long group by all)"""
JUDGED = with_tables("signals", "judged") + CELLS
REPORT = JUDGED + """, bt as (select prompt_version, field, true_label as label, sum(n) as support from cells group by all),
bp as (select prompt_version, field, pred_label as label, sum(n) as predicted from cells group by all),
hit as (select prompt_version, field, true_label as label, n as hits from cells where true_label = pred_label),
j as (select prompt_version, field, label, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted, coalesce(hits, 0) as hits
    from bt full join bp using (prompt_version, field, label) left join hit using (prompt_version, field, label)),
report as (select prompt_version, field, label, coalesce(hits / nullif(cast(predicted as double), 0), 0) as "precision",
    coalesce(hits / nullif(cast(support as double), 0), 0) as recall,
    coalesce(2.0 * hits / nullif(cast(predicted + support as double), 0), 0) as f1, cast(support as bigint) as support from j)"""


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def cells(spark, sf_dir):
    return evaluation.confusion_cells(judgements(spark, sf_dir))


@query(
    "eval_set",
    """select d.doc_id as id, d.text as cleaned_text, case l.quality when 1 then 'UI/UX' else 'Other' end as true_theme,
        case l.toxic when 1 then 'negative' else 'positive' end as true_sentiment
        from labels as l join documents as d on l.doc_id = d.doc_id""",
)
def _eval_set(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("review_id"),
        F.when(F.col("quality") == 1, "UI/UX").otherwise("Other").alias("theme"),
        F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("sentiment"),
    )
    reviews = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("cleaned_text"))
    return evaluation.eval_set(labels, reviews)


@query(
    "accuracy",
    JUDGED
    + """ select prompt_version, field, cast(sum(n) as bigint) as n, round(sum(case when true_label = pred_label then n else 0 end)
        / cast(sum(n) as double), 6) as accuracy from cells group by prompt_version, field""",
)
def _accuracy(spark, sf_dir):
    return rounded(evaluation.accuracy(cells(spark, sf_dir)), "accuracy")


@query(
    "class_report",
    REPORT + ' select prompt_version, field, label, round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6) as f1, support from report',
)
def _report(spark, sf_dir):
    return rounded(evaluation.class_report(cells(spark, sf_dir)), "precision", "recall", "f1")


@query(
    "report_averages",
    REPORT
    + """ select prompt_version, field, 'macro' as average, round(avg("precision"), 6) as "precision", round(avg(recall), 6) as recall,
        round(avg(f1), 6) as f1, cast(sum(support) as bigint) as support from report group by prompt_version, field
    union all select prompt_version, field, 'weighted', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
        round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from report group by prompt_version, field""",
)
def _averages(spark, sf_dir):
    return rounded(evaluation.report_averages(evaluation.class_report(cells(spark, sf_dir))), "precision", "recall", "f1")


@query(
    "confusion_matrix",
    JUDGED
    + """, lab as (select distinct prompt_version, field, true_label as label from cells union select prompt_version, field, pred_label from cells)
    select a.prompt_version, a.field, a.label as true_label, b.label as pred_label, coalesce(n, 0) as n
    from lab as a join lab as b on a.prompt_version = b.prompt_version and a.field = b.field
    left join cells as c on c.prompt_version = a.prompt_version and c.field = a.field and c.true_label = a.label and c.pred_label = b.label""",
)
def _matrix(spark, sf_dir):
    return evaluation.confusion_matrix(cells(spark, sf_dir))


@query(
    "misclassified",
    with_tables("signals", "judged")
    + """ select prompt_version, id, concat('review ', cast(id as varchar)) as cleaned_text, true_theme, theme, true_sentiment, sentiment,
        'by rule' as reasoning from judged where theme <> true_theme or sentiment <> true_sentiment""",
)
def _misclassified(spark, sf_dir):
    judged = judgements(spark, sf_dir).withColumn(
        "cleaned_text", F.concat_ws(" ", F.lit("review"), F.col("id").cast("string"))
    )
    return evaluation.misclassified(judged.withColumn("reasoning", F.lit("by rule")))


@query(
    "compare_versions",
    REPORT
    + """, acc as (select prompt_version, field, cast(sum(n) as bigint) as n, sum(case when true_label = pred_label then n else 0 end)
        / cast(sum(n) as double) as accuracy from cells group by prompt_version, field),
    mac as (select prompt_version, field, avg(f1) as macro_f1 from report group by prompt_version, field)
    select prompt_version, field, n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1,
        field = 'theme' and accuracy = (select max(accuracy) from acc where field = 'theme') as best
    from acc join mac using (prompt_version, field)""",
)
def _compare(spark, sf_dir):
    return rounded(evaluation.compare_versions(judgements(spark, sf_dir)), "accuracy", "macro_f1")


# Ranks halved so that reviewers give ties.
TIED = with_tables("rankings") + """, tied as (select reviewer, app_id, pain_point, cast(floor("rank" / 2) as int) as "rank" from rankings),
pairs as (select a.app_id, a.reviewer as reviewer_a, b.reviewer as reviewer_b, a.pain_point, a."rank" as rank_a, b."rank" as rank_b
    from tied as a join tied as b on a.app_id = b.app_id and a.pain_point = b.pain_point and a.reviewer < b.reviewer),
ranked as (select *, rank() over (partition by app_id, reviewer_a, reviewer_b order by rank_a)
        + (count(*) over (partition by app_id, reviewer_a, reviewer_b, rank_a) - 1) / 2.0 as ra,
    rank() over (partition by app_id, reviewer_a, reviewer_b order by rank_b)
        + (count(*) over (partition by app_id, reviewer_a, reviewer_b, rank_b) - 1) / 2.0 as rb from pairs),
rho as (select app_id, reviewer_a, reviewer_b, count(*) as n_common_pain_points,
    covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) as spearman_rho from ranked group by all having count(*) >= 2),
topn as (select app_id, reviewer, pain_point from (select *, row_number() over (partition by app_id, reviewer order by "rank", pain_point) as rn
    from tied) as t where rn <= 5),
sz as (select app_id, reviewer, count(*) as n from topn group by all),
ov as (select a.app_id, a.reviewer as reviewer_a, b.reviewer as reviewer_b, count(*) as common from topn as a
    join topn as b on a.app_id = b.app_id and a.pain_point = b.pain_point and a.reviewer < b.reviewer group by all),
jac as (select a.app_id, a.reviewer as reviewer_a, b.reviewer as reviewer_b,
    coalesce(common, 0) / cast(a.n + b.n - coalesce(common, 0) as double) as top5_jaccard_overlap
    from sz as a join sz as b on a.app_id = b.app_id and a.reviewer < b.reviewer
    left join ov on ov.app_id = a.app_id and ov.reviewer_a = a.reviewer and ov.reviewer_b = b.reviewer)"""


def tied(spark, sf_dir):
    return rankings(spark, sf_dir).withColumn("rank", F.floor(F.col("rank") / 2).cast("int"))


@query("pm_spearman", TIED + " select app_id, reviewer_a, reviewer_b, n_common_pain_points, round(spearman_rho, 6) as spearman_rho from rho")
def _spearman(spark, sf_dir):
    return rounded(agreement.spearman(tied(spark, sf_dir)), "spearman_rho")


# Six common pain points: four degrees of freedom, where the p value has the closed form below.
@query(
    "pm_spearman_pvalue",
    TIED
    + """ select app_id, reviewer_a, reviewer_b, n_common_pain_points,
        round(greatest(0.0, 1.0 - abs(spearman_rho) * (1.0 + 0.5 * greatest(0.0, 1.0 - spearman_rho * spearman_rho))), 6) as spearman_pvalue
        from rho""",
)
def _pvalue(spark, sf_dir):
    with_p = agreement.with_pvalue(agreement.spearman(tied(spark, sf_dir)))
    return rounded(with_p.drop("spearman_rho"), "spearman_pvalue")


@query("pm_top5_jaccard", TIED + " select app_id, reviewer_a, reviewer_b, round(top5_jaccard_overlap, 6) as top5_jaccard_overlap from jac")
def _jaccard(spark, sf_dir):
    return rounded(agreement.top_overlap(tied(spark, sf_dir)), "top5_jaccard_overlap")


@query(
    "pm_agreement",
    TIED
    + """ select app_id, reviewer_a, reviewer_b, n_common_pain_points, round(spearman_rho, 6) as spearman_rho,
        round(greatest(0.0, 1.0 - abs(spearman_rho) * (1.0 + 0.5 * greatest(0.0, 1.0 - spearman_rho * spearman_rho))), 6) as spearman_pvalue,
        round(top5_jaccard_overlap, 6) as top5_jaccard_overlap, (select count(distinct reviewer) from tied) as n_reviewers
        from rho join jac using (app_id, reviewer_a, reviewer_b)""",
)
def _agreement(spark, sf_dir):
    return rounded(agreement.agreement(tied(spark, sf_dir)), "spearman_rho", "spearman_pvalue", "top5_jaccard_overlap")
