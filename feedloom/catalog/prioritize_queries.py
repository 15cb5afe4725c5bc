"""Pain-point signals, priority scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import query
from feedloom.catalog.evaluation_queries import CELLS
from feedloom.catalog.inputs import AS_OF, DAYS, judgements, raw_reviews, signals, with_tables
from feedloom.operators import evaluation, painpoints, prioritize, reporting
from feedloom.sources.exports import backlog_markdown

PAIN = with_tables("signals", "pain")

SCORED = PAIN + """, lim as (select app_id, prompt_version, min(review_count) as lo_n, max(review_count) as hi_n,
        min(reach_sum) as lo_r, max(reach_sum) as hi_r from pain group by app_id, prompt_version),
parts as (select pain.*, case when hi_n = lo_n then 100.0 else 100.0 * (review_count - lo_n) / cast(hi_n - lo_n as double) end as frequency_score,
        (weighted_severity - 1.0) / 4.0 * 100.0 as severity_score,
        (greatest(-100.0, least(100.0, cast(last_30_count - prev_30_count as double)
            / cast(greatest(prev_30_count, 1) as double) * 100.0)) + 100.0) / 2.0 as trend_score,
        case when hi_r = lo_r then 100.0 else 100.0 * (reach_sum - lo_r) / cast(hi_r - lo_r as double) end as reach_score
    from pain join lim using (app_id, prompt_version)),
scored as (select *, (0.3 * frequency_score + 0.3 * severity_score + 0.2 * trend_score + 0.2 * reach_score) / 1.0 as priority_score
    from parts)"""

KEYS = ["app_id", "prompt_version", "theme", "cluster_label"]


def pain_points(spark, sf_dir):
    pool = signals(spark, sf_dir).filter(F.col("sentiment").isin(*painpoints.COMPLAINTS))
    return painpoints.pain_point_aggregate(pool, F.lit(AS_OF).cast("date"), DAYS)


def rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def columns(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


@query(
    "complaint_pool",
    with_tables("signals")
    + """, texts as (select doc_id, text from documents)
    select s.review_id, prompt_version, theme, sentiment, severity, app_id, cleaned_text, rating, thumbs_up, review_date
    from signals as s join (select doc_id as id, text as cleaned_text from texts) as t on s.review_id = t.id
    where sentiment in ('negative', 'neutral')""",
)
def _pool(spark, sf_dir):
    s = signals(spark, sf_dir)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("cleaned_text"))
    reviews = s.select(F.col("review_id").alias("id"), "app_id", "rating", "thumbs_up", "review_date").join(texts, "id")
    return painpoints.complaint_pool(s, reviews)


@query(
    "pain_point_aggregate",
    PAIN + f" select app_id, prompt_version, theme, cluster_label, review_count, {columns('weighted_severity')},"
    " last_30_count, prev_30_count, reach_sum from pain",
)
def _aggregate(spark, sf_dir):
    return rounded(pain_points(spark, sf_dir), "weighted_severity")


@query(
    "pain_point_members",
    with_tables("signals")
    + " select app_id, prompt_version, theme, cluster_label, review_id from signals where sentiment in ('negative', 'neutral')",
)
def _members(spark, sf_dir):
    pool = signals(spark, sf_dir).filter(F.col("sentiment").isin(*painpoints.COMPLAINTS))
    return painpoints.pain_point_members(pool)


@query(
    "weighted_severity",
    with_tables("signals")
    + """ select app_id, round(coalesce(cast(sum(severity * (6 - rating)) as double)
        / nullif(cast(coalesce(sum(6 - rating), 0) as double), 0), avg(cast(severity as double))), 6) as weighted_severity
        from (select app_id, severity, case when app_id = 'app0' then null else rating end as rating from signals) as s
        group by app_id""",
)
def _weighted_severity(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("rating", F.when(F.col("app_id") != "app0", F.col("rating")))
    return s.groupBy("app_id").agg(
        F.round(painpoints.weighted_severity(F.col("severity"), F.col("rating")), 6).alias("weighted_severity")
    )


@query(
    "window_counts",
    with_tables("signals")
    + f""" select app_id, theme, count(*) filter (where review_date > date '{AS_OF}' - 30 and review_date <= date '{AS_OF}') as last_30_count,
        count(*) filter (where review_date > date '{AS_OF}' - 60 and review_date <= date '{AS_OF}' - 30) as prev_30_count
        from signals group by app_id, theme""",
)
def _windows(spark, sf_dir):
    counts = painpoints.window_counts(F.col("review_date"), F.lit(AS_OF).cast("date"), 30)
    return signals(spark, sf_dir).groupBy("app_id", "theme").agg(*[c.alias(n) for n, c in counts.items()])


@query(
    "example_quotes",
    with_tables("signals")
    + """, q as (select *, concat(theme, ' ', cast(review_id as varchar)) as cleaned_text, md5(concat_ws(':', '42', cast(review_id as varchar))) as h
        from signals where sentiment in ('negative', 'neutral')),
    r as (select *, row_number() over (partition by app_id, prompt_version, theme, cluster_label order by h, review_id) as quote_rank from q)
    select app_id, prompt_version, theme, cluster_label, quote_rank, cleaned_text as quote, review_id from r where quote_rank <= 3""",
)
def _quotes(spark, sf_dir):
    pool = signals(spark, sf_dir).filter(F.col("sentiment").isin(*painpoints.COMPLAINTS))
    pool = pool.withColumn("cleaned_text", F.concat_ws(" ", "theme", F.col("review_id").cast("string")))
    quotes = painpoints.example_quotes(pool)
    return quotes.select(*KEYS, F.posexplode(F.arrays_zip("example_quotes", "example_review_ids")).alias("pos", "q")).select(
        *KEYS, (F.col("pos") + 1).alias("quote_rank"), F.col("q.example_quotes").alias("quote"), F.col("q.example_review_ids").alias("review_id")
    )


@query("min_max_scale", SCORED + f" select app_id, theme, cluster_label, {columns('frequency_score', 'reach_score')} from scored")
def _min_max(spark, sf_dir):
    scaled = prioritize.min_max_scale(
        pain_points(spark, sf_dir), {"review_count": "frequency_score", "reach_sum": "reach_score"}
    )
    return rounded(scaled.select("app_id", "theme", "cluster_label", "frequency_score", "reach_score"), "frequency_score", "reach_score")


def _component(name):
    @query(name, SCORED + f" select app_id, theme, cluster_label, {columns(name)} from scored")
    def run(spark, sf_dir):
        scored = prioritize.score_pain_points(pain_points(spark, sf_dir))
        return rounded(scored.select("app_id", "theme", "cluster_label", name), name)

    return run


for _name in ("frequency_score", "severity_score", "trend_score", "reach_score", "priority_score"):
    _component(_name)


@query(
    "rank_backlog",
    SCORED
    + """ select app_id, prompt_version, theme, cluster_label, round(priority_score, 6) as priority_score,
        row_number() over (partition by app_id, prompt_version order by round(priority_score, 9) desc, theme, cluster_label) as backlog_rank
        from scored""",
)
def _rank(spark, sf_dir):
    ranked = prioritize.rank_backlog(prioritize.score_pain_points(pain_points(spark, sf_dir)))
    return rounded(ranked.select(*KEYS, "priority_score", "backlog_rank"), "priority_score")


SCENARIOS = {
    "default": prioritize.DEFAULT_WEIGHTS,
    "trend": {"frequency": 0.0, "severity": 0.0, "trend": 1.0, "reach": 0.0},
    "zero": {"frequency": 0.0, "severity": 0.0, "trend": 0.0, "reach": 0.0},
}


@query(
    "weight_scenarios",
    SCORED
    + """, w as (select * from (values ('default', 0.3, 0.3, 0.2, 0.2, 1.0), ('trend', 0.0, 0.0, 1.0, 0.0, 1.0), ('zero', 0.0, 0.0, 0.0, 0.0, 1.0))
        as v(scenario, wf, ws, wt, wr, total)),
    s as (select scenario, app_id, theme, cluster_label, (cast(wf as double) * frequency_score + cast(ws as double) * severity_score
        + cast(wt as double) * trend_score + cast(wr as double) * reach_score) / cast(total as double) as p from parts cross join w)
    select scenario, app_id, theme, cluster_label, round(p, 6) as priority_score,
        row_number() over (partition by scenario, app_id order by round(p, 9) desc, theme, cluster_label) as backlog_rank from s""",
)
def _scenarios(spark, sf_dir):
    ranked = prioritize.weight_scenarios(pain_points(spark, sf_dir), SCENARIOS)
    return rounded(ranked.select("scenario", "app_id", "theme", "cluster_label", "priority_score", "backlog_rank"), "priority_score")


VIEW = ["theme", "cluster_label", "review_count", "frequency_score", "severity_score", "trend_score", "reach_score", "priority_score"]


@query(
    "backlog_view",
    SCORED + f" select app_id, {', '.join(VIEW[:3])}, {columns(*VIEW[3:])} from scored where app_id = 'app1' and prompt_version = 'v1'",
)
def backlog(spark, sf_dir):
    view = reporting.backlog_view(pain_points(spark, sf_dir), "app1")
    return rounded(view.select("app_id", *VIEW), *VIEW[3:])


@query(
    "export_backlog",
    SCORED
    + """ select app_id, line_no, line from (
        select app_id, row_number() over (partition by app_id order by round(priority_score, 9) desc, theme, cluster_label) as line_no,
        concat('| ', cast(row_number() over (partition by app_id order by round(priority_score, 9) desc, theme, cluster_label) as varchar),
            ' | ', theme, ' | ', theme, '-', cast(cluster_label as varchar), ' | ', printf('%.1f', round(priority_score, 1)), ' | ', cast(review_count as varchar), ' |') as line
        from scored) as t""",
)
def _export(spark, sf_dir):
    titled = pain_points(spark, sf_dir).withColumn("title", F.concat_ws("-", "theme", F.col("cluster_label").cast("string")))
    ranked = prioritize.rank_backlog(prioritize.score_pain_points(titled))
    return backlog_markdown(ranked).select("app_id", F.col("backlog_rank").alias("line_no"), "line")


@query(
    "review_counts_by_app",
    with_tables("raw_reviews") + " select app_id, app_name, count(*) as review_count from raw_reviews group by app_id, app_name",
)
def _counts(spark, sf_dir):
    return reporting.review_counts_by_app(raw_reviews(spark, sf_dir))


@query(
    "app_summary",
    with_tables("raw_reviews")
    + " select app_id, app_name, count(id) as reviews, round(avg(cast(rating as double)), 6) as avg_rating from raw_reviews group by app_id, app_name",
)
def _summary(spark, sf_dir):
    return rounded(reporting.app_summary(raw_reviews(spark, sf_dir)), "avg_rating")


@query(
    "headline_metrics",
    with_tables("signals", "raw_reviews", "judged", "pain") + CELLS
    + """, acc as (select prompt_version, sum(case when true_label = pred_label then n else 0 end) / cast(sum(n) as double) as a
        from cells where field = 'theme' group by prompt_version)
    select 'reviews' as metric, cast(count(*) as double) as value from raw_reviews
    union all select 'pain_points', cast(count(*) as double) from pain
    union all select 'best_theme_accuracy', round(max(a) * 100.0, 1) from acc""",
)
def _headline(spark, sf_dir):
    accuracies = evaluation.accuracy(evaluation.confusion_cells(judgements(spark, sf_dir)))
    return reporting.headline_metrics(raw_reviews(spark, sf_dir), pain_points(spark, sf_dir), accuracies)


@query(
    "theme_sentiment_breakdown",
    with_tables("signals") + " select app_id, theme, sentiment, count(*) as n, cast(bit_count(grouping_id(app_id, theme, sentiment)) as int) as level from signals group by rollup (app_id, theme, sentiment)",
)
def _breakdown(spark, sf_dir):
    return reporting.theme_sentiment_breakdown(signals(spark, sf_dir))


@query(
    "class_distribution",
    with_tables("signals")
    + """ select field, value, count(*) as n from (select 'theme' as field, theme as value from signals
        union all select 'sentiment', sentiment from signals) as t group by field, value""",
)
def _distribution(spark, sf_dir):
    return reporting.class_distribution(signals(spark, sf_dir))
