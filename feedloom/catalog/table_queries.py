"""Scans, ingest and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.catalog import query
from feedloom.catalog.classify_queries import SCORED, labelled_ids, lexicon
from feedloom.catalog.cleaning_queries import CLEANED, DEDUPED, PROFILE, judged_language, learned_profile
from feedloom.catalog.inputs import AS_OF, DAYS, raw_reviews, signals, table, with_tables
from feedloom.catalog.prioritize_queries import pain_points
from feedloom.operators import classify, upsert
from feedloom.operators.cleaning import add_cleaned_text, clean_and_filter, drop_bad_dates
from feedloom.plans.staging import staging_root
from feedloom.schemas import CLASSIFICATIONS, PAIN_POINT_MEMBERS, PAIN_POINTS, PM_RANKINGS, REVIEWS
from feedloom.sources import flows, readers
from feedloom.sources.store import Store
from feedloom.streaming.ingest import ingest_stream


def fresh_path(spark, name: str) -> str:
    import uuid

    return f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# All rows under one app: the first of equal texts, in English, with a date.
ONE_APP = (
    CLEANED + DEDUPED.replace("partition by app_id, cleaned_text", "partition by cleaned_text") + "," + PROFILE + ","
    + judged_language("first_rows", "id")
    + """, placed as (select id, row_number() over (order by id) - 1 as place from raw_reviews),
    kept as (select f.*, language, place, cast(review_date as date) as day from first_rows as f join judged_lang as j on f.id = j.id
        join placed as p on p.id = f.id where language = 'en' and try_cast(review_date as date) is not null)"""
)


@query(
    "csv_mapped_ingest",
    ONE_APP
    + """ select row_number() over (order by cast(place as varchar)) as id, cast(place as varchar) as review_id, 'app9' as app_id,
        'App Nine' as app_name, text, cleaned_text, language, rating, coalesce(thumbs_up, 0) as thumbs_up, day as review_date, 'csv' as source
        from kept""",
)
def _csv(spark, sf_dir):
    path = fresh_path(spark, "upload")
    upload = raw_reviews(spark, sf_dir).select(
        F.col("text").alias("Review Text"), F.col("rating").alias("Stars"), F.col("thumbs_up").alias("Likes"),
        F.col("review_date").alias("Day"), "id",
    )
    (
        upload.repartitionByRange("id").sortWithinPartitions("id").drop("id")
        .write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    mapping = {"text": "Review Text", "rating": "Stars", "thumbs_up": "Likes", "review_date": "Day"}
    root, profile = fresh_path(spark, "store"), learned_profile(spark, sf_dir)
    # Two uploads of one file: the second finds nothing new.
    for _ in range(2):
        flows.ingest_csv(Store(spark, root), path, mapping, "app9", "App Nine", profile)
    return Store(spark, root).read("reviews", REVIEWS).select(
        "id", "review_id", "app_id", "app_name", "text", "cleaned_text", "language", "rating", "thumbs_up", "review_date", "source"
    )


def write_dump(spark, sf_dir, path: str) -> None:
    raw_reviews(spark, sf_dir).select(
        F.col("review_id").alias("reviewId"), F.concat(F.lit("user"), F.col("id")).alias("userName"),
        F.col("rating").alias("score"), F.col("thumbs_up").alias("thumbsUpCount"), F.col("text").alias("content"),
        F.col("review_date").alias("at"),
    ).write.json(path)


@query(
    "scrape_dump_normalize",
    with_tables("raw_reviews")
    + """ select 'app9' as app_id, 'App Nine' as app_name, review_id, concat('user', cast(id as varchar)) as user_name, rating,
        coalesce(thumbs_up, 0) as thumbs_up, coalesce(text, '') as text, review_date, cast(null as varchar) as app_version, 'scrape' as source
        from (select * replace (substr(review_date, 1, 10) as review_date) from raw_reviews) as r""",
)
def _dump(spark, sf_dir):
    path = fresh_path(spark, "dump")
    write_dump(spark, sf_dir, path)
    return readers.read_dump(spark, path, "app9", "App Nine")


@query(
    "scan_reviews",
    "select doc_id, text, lang, source, n_chars from documents",
)
def _scan(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# Stored: the labelled reviews under changed text. Incoming: all reviews, every id twice; a null text breaks NOT NULL.
@query(
    "upsert_ignore",
    with_tables("raw_reviews")
    + """ select app_id, review_id, case when id in (select doc_id from labels) then 'stored' else text end as text from raw_reviews
        where id in (select doc_id from labels) or true_lang <> 'fr'""",
)
def _ignore(spark, sf_dir):
    r = raw_reviews(spark, sf_dir)
    stored = r.join(labelled_ids(spark, sf_dir), "id", "left_semi").select("app_id", "review_id", F.lit("stored").alias("text"))
    first = r.select("app_id", "review_id", F.when(F.col("true_lang") != "fr", F.col("text")).alias("text"), F.lit(0).alias("seq"))
    again = first.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("again"))).withColumn("seq", F.lit(1))
    incoming = first.unionByName(again)
    return upsert.upsert_ignore(stored, incoming, ["app_id", "review_id"], ["seq"], ["app_id", "review_id", "text"])


# The same rows through a store of keyed segments.
@query(
    "insert_stored",
    with_tables("raw_reviews")
    + """ select app_id, review_id, case when id in (select doc_id from labels) then 'stored' else text end as text from raw_reviews
        where id in (select doc_id from labels) or true_lang <> 'fr'""",
)
def _insert_stored(spark, sf_dir):
    r = raw_reviews(spark, sf_dir)
    keys, schema = ["app_id", "review_id"], T.StructType([T.StructField(c, T.StringType(), False) for c in ("app_id", "review_id", "text")])
    stored = r.join(labelled_ids(spark, sf_dir), "id", "left_semi").select(*keys, F.lit("stored").alias("text"), F.lit(0).alias("seq"))
    first = r.select(*keys, F.when(F.col("true_lang") != "fr", F.col("text")).alias("text"), F.lit(0).alias("seq"))
    again = first.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("again"))).withColumn("seq", F.lit(1))
    root = fresh_path(spark, "store")
    for batch in (stored, first.unionByName(again)):
        store = Store(spark, root)
        store.insert("reviews", batch, schema, keys, ["seq"])
        store.commit()
    return Store(spark, root).read("reviews", schema)


@query(
    "incremental_ingest",
    ONE_APP
    + """ select row_number() over (order by cast(id as varchar)) as id, 'app9' as app_id, cast(id as varchar) as review_id, cleaned_text,
        language, day as review_date from kept""",
)
def _incremental(spark, sf_dir):
    path, root, progress = fresh_path(spark, "dump"), fresh_path(spark, "store"), fresh_path(spark, "progress")
    write_dump(spark, sf_dir, path)
    profile = learned_profile(spark, sf_dir)

    def clean(batch):
        # Files of a dump are as old as each other; the first of equal texts is the one with the smallest number.
        return clean_and_filter(batch.withColumn("_n", F.col("review_id").cast("long")), ["_n"], profile=profile)

    # The second run finds no new file.
    for _ in range(2):
        ingest_stream(spark, path, root, progress, "app9", "App Nine", clean, into_store=True).awaitTermination()
    return Store(spark, root).read("reviews", REVIEWS).select("id", "app_id", "review_id", "cleaned_text", "language", "review_date")


def stored_pain_points(spark, sf_dir) -> Store:
    """A store with the pain points of the signals and their members."""
    store = Store(spark, fresh_path(spark, "store"))
    points = pain_points(spark, sf_dir)
    members = signals(spark, sf_dir).filter(F.col("sentiment").isin("negative", "neutral"))
    flows.store_pain_points(store, points, members, points.select("app_id", "prompt_version"))
    return Store(spark, store.root)


@query(
    "replace_partition",
    with_tables("signals", "pain")
    + """ select app_id, prompt_version, theme, cluster_label, review_count from pain where app_id not in ('app1', 'app2')
    union all select 'app1', 'v1', theme, cluster_label, review_count + 1 from pain where app_id = 'app3'""",
)
def _replace_partition(spark, sf_dir):
    store = stored_pain_points(spark, sf_dir)
    new = flows.load_pain_points(store, "app3", "v1").withColumn("app_id", F.lit("app1"))
    new = new.withColumn("review_count", F.col("review_count") + 1)
    # No rows are given for app2, which clears it.
    slices = spark.createDataFrame([("app1", "v1"), ("app2", "v1")], "app_id string, prompt_version string")
    members = store.read("pain_point_members", PAIN_POINT_MEMBERS).filter("app_id = 'app3'").withColumn("app_id", F.lit("app1"))
    flows.store_pain_points(store, new, members, slices)
    stored = Store(spark, store.root).read("pain_points", PAIN_POINTS)
    return stored.select("app_id", "prompt_version", "theme", "cluster_label", "review_count")


@query(
    "load_pain_points",
    with_tables("signals", "pain")
    + """ select app_id, theme, cluster_label, review_count, reach_sum, n_members from pain as p join (select app_id, theme, cluster_label,
        count(*) as n_members from signals where sentiment in ('negative', 'neutral') group by all) as m using (app_id, theme, cluster_label)
        where app_id = 'app2' and prompt_version = 'v1'""",
)
def _load_pain_points(spark, sf_dir):
    store = stored_pain_points(spark, sf_dir)
    points = flows.load_pain_points(store, "app2", "v1")
    keys = ["app_id", "prompt_version", "theme", "cluster_label"]
    members = store.read("pain_point_members", PAIN_POINT_MEMBERS).groupBy(keys).agg(F.count(F.lit(1)).alias("n_members"))
    return points.join(members, keys).select("app_id", "theme", "cluster_label", "review_count", "reach_sum", "n_members")


@query(
    "classify_and_store",
    SCORED
    + """ select id as review_id, 'v1' as prompt_version, theme, sentiment, severity, reasoning, true as dated, 0 as asked_again from scored""",
)
def _classify_and_store(spark, sf_dir):
    reviews = raw_reviews(spark, sf_dir).transform(add_cleaned_text).select("id", "cleaned_text")
    scorer, root = classify.lexicon_scorer(lexicon(spark, sf_dir)), fresh_path(spark, "store")
    flows.classify_and_store(Store(spark, root), reviews, "v1", scorer)
    again = flows.classify_and_store(Store(spark, root), reviews, "v1", scorer)
    return Store(spark, root).read("classifications", CLASSIFICATIONS).select(
        "review_id", "prompt_version", "theme", "sentiment", "severity", "reasoning",
        F.col("created_at").isNotNull().alias("dated"), F.lit(again["misses"]).cast("int").alias("asked_again"),
    )


# Groups are left whole, so that SQL can follow the flow from classification to stored pain points and their members.
@query(
    "stored_pain_points",
    SCORED
    + f""", labelled as (select s.id as review_id, r.app_id, s.theme, s.severity, coalesce(r.rating, 3) as rating, r.thumbs_up,
        cast(r.review_date as date) as review_date from scored as s join raw_reviews as r on s.id = r.id
        where s.sentiment in ('negative', 'neutral') and try_cast(r.review_date as date) is not null)
    select app_id, 'v1' as prompt_version, theme, 0 as cluster_label, count(*) as review_count, count(*) as n_members,
        sum(review_id) as member_sum, cast(coalesce(sum(thumbs_up), 0) as bigint) as reach_sum,
        count(*) filter (where review_date > date '{AS_OF}' - {DAYS} and review_date <= date '{AS_OF}') as last_30_count,
        count(*) filter (where review_date > date '{AS_OF}' - {2 * DAYS} and review_date <= date '{AS_OF}' - {DAYS}) as prev_30_count
    from labelled group by app_id, theme""",
)
def _stored_pain_points(spark, sf_dir):
    reviews = raw_reviews(spark, sf_dir).transform(add_cleaned_text).transform(drop_bad_dates)
    store = Store(spark, fresh_path(spark, "store"))
    flows.classify_and_store(store, reviews.select("id", "cleaned_text"), "v1", classify.lexicon_scorer(lexicon(spark, sf_dir)))
    # No group reaches this size.
    flows.build_and_store(store, reviews, min_cluster_size=1 << 30, as_of=F.lit(AS_OF).cast("date"), days=DAYS)
    stored = Store(spark, store.root)
    keys = ["app_id", "prompt_version", "theme", "cluster_label"]
    members = stored.read("pain_point_members", PAIN_POINT_MEMBERS).groupBy(keys).agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("review_id").alias("member_sum")
    )
    counts = ["review_count", "n_members", "member_sum", "reach_sum", "last_30_count", "prev_30_count"]
    return stored.read("pain_points", PAIN_POINTS).join(members, keys).select(*keys, *counts)


@query(
    "schema_evolve",
    with_tables("signals")
    + """ select review_id, prompt_version, theme, sentiment, severity, cast(null as varchar) as reasoning,
        cast(null as varchar) as raw_response, cast(null as timestamp) as created_at from signals""",
)
def _evolve(spark, sf_dir):
    old = signals(spark, sf_dir).select("review_id", "prompt_version", "theme", "sentiment", "severity")
    return upsert.evolve(old, CLASSIFICATIONS)


@query(
    "snapshot_subset",
    with_tables("signals", "raw_reviews", "pain")
    + """, sample as (select id, app_id from raw_reviews where id in (select doc_id from labels) and app_id <> 'app0')
    select 'reviews' as part, count(*) as n, sum(id) as checksum from raw_reviews where id in (select id from sample)
    union all select 'classifications', count(*), sum(review_id) from signals where review_id in (select id from sample)
    union all select 'pain_points', count(*), cast(sum(review_count) as hugeint) from pain where app_id in (select app_id from sample)""",
)
def _subset(spark, sf_dir):
    reviews = raw_reviews(spark, sf_dir)
    sample = reviews.join(labelled_ids(spark, sf_dir), "id", "left_semi").filter(F.col("app_id") != "app0")
    parts = upsert.snapshot_subset(reviews, signals(spark, sf_dir), pain_points(spark, sf_dir), sample)
    keys = {"reviews": "id", "classifications": "review_id", "pain_points": "review_count"}
    counted = None
    for part, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(keys[part]).alias("checksum")).select(F.lit(part).alias("part"), "n", "checksum")
        counted = one if counted is None else counted.unionByName(one)
    return counted


@query(
    "read_or_empty",
    with_tables("rankings") + """ select reviewer, app_id, pain_point, "rank" from rankings""",
)
def _read_or_empty(spark, sf_dir):
    from feedloom.catalog.inputs import rankings

    path = fresh_path(spark, "rankings")
    absent = readers.read_or_empty(spark, path, PM_RANKINGS)
    upsert.evolve(rankings(spark, sf_dir), PM_RANKINGS).write.option("header", True).csv(path)
    return absent.unionByName(readers.read_or_empty(spark, path, PM_RANKINGS)).select("reviewer", "app_id", "pain_point", "rank")


@query("export_results")
def _results(spark, sf_dir):
    from feedloom.catalog.inputs import judgements
    from feedloom.operators import evaluation
    from feedloom.sources.exports import evaluation_results, write_results

    judged = judgements(spark, sf_dir)
    cells = evaluation.confusion_cells(judged)
    results = evaluation_results(
        evaluation.compare_versions(judged), evaluation.class_report(cells), evaluation.confusion_matrix(cells)
    )
    path = fresh_path(spark, "results")
    write_results(results, path)
    return spark.read.schema("kind string, record string").json(path)
