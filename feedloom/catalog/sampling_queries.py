"""Sampling and labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import query
from feedloom.catalog.inputs import raw_reviews, rankings, table, with_tables
from feedloom.operators import labels, sampling
from feedloom.operators.cleaning import add_cleaned_text


def seeded(key: str) -> str:
    return f"md5(concat_ws(':', '42', cast({key} as varchar)))"


SAMPLE = """, strata as (select count(*) as s from (select distinct app_id, rating from raw_reviews where rating is not null) as d),
quota as (select *, row_number() over (partition by app_id, rating order by {h}, id) as rn from raw_reviews where rating is not null),
sample as (select * from quota, strata where rn <= greatest(1, {size} // s) qualify row_number() over (order by {h}, id) <= {size})"""


@query(
    "stratified_sample",
    with_tables("raw_reviews") + SAMPLE.format(h=seeded("id"), size=300) + " select id, app_id, rating, review_date from sample",
)
def _sample(spark, sf_dir):
    return (
        sampling.stratified_sample(raw_reviews(spark, sf_dir))
        .select("id", "app_id", "rating", "review_date")
        .orderBy("app_id", "review_date")
    )


@query(
    "label_queue",
    with_tables("raw_reviews", "cleaned") + SAMPLE.format(h=seeded("id"), size=500)
    + " select c.id, c.app_id, c.app_name, c.rating, c.cleaned_text from cleaned as c join sample as s on c.id = s.id",
)
def _queue(spark, sf_dir):
    return sampling.label_queue(raw_reviews(spark, sf_dir).transform(add_cleaned_text))


@query("random_rows")
def _random(spark, sf_dir):
    return sampling.random_rows(raw_reviews(spark, sf_dir).select("id", "app_id", "rating"), 5, seed=1)


@query(
    "stratum_sizes",
    with_tables("raw_reviews") + " select app_id, rating, count(*) as n from raw_reviews group by app_id, rating",
)
def _strata(spark, sf_dir):
    return sampling.stratum_sizes(raw_reviews(spark, sf_dir))


@query(
    "kfold_assign",
    f"select doc_id as review_id, cast((row_number() over (order by {seeded('doc_id')}, doc_id) - 1) % 5 as int) as fold from labels",
)
def _folds(spark, sf_dir):
    return sampling.kfold_assign(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"))).select(
        "review_id", "fold"
    )


# Stored labels are the given ones; the batch labels the German documents, some of its sources twice.
STORED = """select doc_id as review_id, case quality when 1 then 'UI/UX' else 'Other' end as theme,
    case toxic when 1 then 'negative' else 'positive' end as sentiment, 'first' as labeler, timestamp '2024-01-01 00:00:00' as labeled_at from labels"""
BATCH = """select doc_id as review_id, 'Pricing' as theme, 'neutral' as sentiment, 'second' as labeler, timestamp '2024-02-01 00:00:00' as labeled_at
    from documents where lang = 'de'
    union all select doc_id, 'Notifications', 'negative', 'third', timestamp '2024-03-01 00:00:00' from documents where lang = 'de' and source in ('src2', 'src4')"""


def stored_labels(spark, sf_dir):
    return spark.sql(STORED.replace("from labels", "from {labels}"), labels=table(spark, sf_dir, "labels"))


def label_batch(spark, sf_dir):
    return spark.sql(BATCH.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))


@query(
    "save_label",
    f"""with stored as ({STORED}), batch as ({BATCH}),
    every as (select *, 0 as seq from stored union all select *, 1 as seq from batch)
    select review_id, theme, sentiment, labeler from every qualify row_number() over (partition by review_id order by seq desc, labeled_at desc) = 1""",
)
def _save(spark, sf_dir):
    saved = labels.save_labels(stored_labels(spark, sf_dir), label_batch(spark, sf_dir))
    return saved.select("review_id", "theme", "sentiment", "labeler")


@query(
    "delete_label",
    f"with stored as ({STORED}) select review_id, theme from stored where review_id not in (select doc_id from documents where lang = 'en')",
)
def _delete(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("review_id"))
    return labels.delete_labels(stored_labels(spark, sf_dir), gone).select("review_id", "theme")


@query(
    "save_ranking",
    with_tables("rankings")
    + """ select reviewer, app_id, pain_point, case when "rank" % 2 = 0 then 7 - "rank" else "rank" end as "rank" from rankings""",
)
def _save_ranking(spark, sf_dir):
    stored = rankings(spark, sf_dir).withColumn("ranked_at", F.lit("2024-01-01").cast("timestamp"))
    changed = stored.filter(F.col("rank") % 2 == 0).select(
        "reviewer", "app_id", "pain_point", (7 - F.col("rank")).alias("rank"), F.lit("2024-02-01").cast("timestamp").alias("ranked_at")
    )
    return labels.save_rankings(stored, changed).drop("ranked_at")


@query(
    "label_progress",
    """select count(*) filter (where l.doc_id is not null) as labelled, count(*) as queued
    from documents as d left join labels as l on d.doc_id = l.doc_id""",
)
def _progress(spark, sf_dir):
    queue = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return labels.label_progress(queue, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id")))
