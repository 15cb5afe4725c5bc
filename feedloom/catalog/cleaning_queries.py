"""Ingest and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import query
from feedloom.catalog.inputs import documents, raw_reviews, with_tables
from feedloom.functions.dates import parse_date
from feedloom.functions.text import clean_whitespace, demojize
from feedloom.operators import cleaning, language

CLEANED = with_tables("raw_reviews", "cleaned")

# Words of the whole text, and the edges of each of three characters or more.
SPLIT = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}'']+'), lambda x: x <> '')"
GRAMS = """flatten(list_transform({w}, lambda x: case when length(x) >= 3
    then [x, concat('^', left(x, 3)), concat(right(x, 3), '$')] else [x] end))"""


def words(text: str) -> str:
    return SPLIT.format(t=text)


def grams(text: str) -> str:
    return GRAMS.format(w=words(text))


PROFILE = f"""
counts as (select lang, g, count(*) as n from (select lang, unnest({grams('text')}) as g from documents where lang is not null) as tg
    group by lang, g),
totals as (select lang, sum(n) as total from counts group by lang),
vocabulary as (select count(distinct g) as known from counts)"""


def judged_language(source: str, keys: str, text: str = "cleaned_text") -> str:
    """CTEs scoring every key of ``source`` and keeping its best language."""
    on = " and ".join(f"s.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""
tok as (select {keys}, unnest({grams(text)}) as g from {source} where length({text}) >= 3),
sizes as (select {keys}, count(*) as size from tok group by {keys}),
hits as (select {keys}, lang, sum(ln(n + 1.0)) as gain from tok join counts using (g) group by {keys}, lang),
part as (select p.*, gain - size * ln(cast(total + known as double)) as score
    from hits as p join sizes as s on {on} join totals using (lang) cross join vocabulary),
judged_lang as (select p.*, lang as language from part as p
    qualify row_number() over (partition by {keys} order by round(score, 6) desc, lang) = 1)"""


def learned_profile(spark, sf_dir):
    return language.learn_profile(documents(spark, sf_dir))


@query("clean_whitespace", CLEANED + " select id, cleaned_text from cleaned")
def _whitespace(spark, sf_dir):
    return raw_reviews(spark, sf_dir).select("id", clean_whitespace(F.col("text")).alias("cleaned_text"))


# Emoji put into the given texts by rule, so that the replacement runs over whole documents.
@query(
    "demojize",
    with_tables("raw_reviews")
    + """, marked as (select id, case id % 4 when 0 then concat(text, '😀👍') when 1 then concat('crashes 😡', text)
                               when 2 then concat('👍🏽 ', text, '❤️') else text end as text from raw_reviews)
    select id, trim(regexp_replace(replace(replace(replace(replace(replace(text, '👍🏽', ' :thumbs_up_medium_skin_tone: '),
        '😀', ' :grinning_face: '), '👍', ' :thumbs_up: '), '😡', ' :enraged_face: '), '❤️', ' :red_heart: '),
        '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))
        as cleaned_text from marked""",
)
def _demojize(spark, sf_dir):
    text = F.col("text")
    marked = (
        F.when(F.col("id") % 4 == 0, F.concat(text, F.lit("😀👍")))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("crashes 😡"), text))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("👍🏽 "), text, F.lit("❤️")))
        .otherwise(text)
    )
    return raw_reviews(spark, sf_dir).select("id", clean_whitespace(demojize(marked)).alias("cleaned_text"))


@query("drop_empty", CLEANED + " select id, app_id from cleaned where length(cleaned_text) > 0")
def _drop_empty(spark, sf_dir):
    return raw_reviews(spark, sf_dir).transform(cleaning.add_cleaned_text).transform(cleaning.drop_empty).select("id", "app_id")


DEDUPED = """, first_rows as (select * from (select *, row_number() over (partition by app_id, cleaned_text order by id) as rn
    from cleaned where length(cleaned_text) > 0) as ranked where rn = 1)"""


@query("dedupe_first", CLEANED + DEDUPED + " select id, app_id, cleaned_text from first_rows")
def _dedupe(spark, sf_dir):
    return (
        raw_reviews(spark, sf_dir)
        .transform(cleaning.add_cleaned_text)
        .transform(cleaning.drop_empty)
        .transform(cleaning.dedupe_first, ["id"])
        .select("id", "app_id", "cleaned_text")
    )


@query(
    "detect_language",
    "with " + PROFILE.strip() + "," + judged_language("documents", "doc_id", "text")
    + " select d.doc_id, language from documents as d left join judged_lang as j on d.doc_id = j.doc_id",
)
def _language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return language.detect_language(docs, learned_profile(spark, sf_dir), keys=("doc_id",), text="text").select(
        "doc_id", "language"
    )


CLEAN_AND_FILTER = (
    CLEANED + DEDUPED + "," + PROFILE + "," + judged_language("first_rows", "id")
    + """, kept as (select f.*, language, try_cast(review_date as date) as day from first_rows as f
        join judged_lang as j on f.id = j.id where language = 'en' and try_cast(review_date as date) is not null)"""
)


@query(
    "filter_language",
    CLEANED + DEDUPED + "," + PROFILE + "," + judged_language("first_rows", "id")
    + " select f.id, language from first_rows as f join judged_lang as j on f.id = j.id where language in ('en', 'de')",
)
def _filter_language(spark, sf_dir):
    deduped = (
        raw_reviews(spark, sf_dir)
        .transform(cleaning.add_cleaned_text)
        .transform(cleaning.drop_empty)
        .transform(cleaning.dedupe_first, ["id"])
    )
    judged = language.detect_language(deduped, learned_profile(spark, sf_dir))
    return cleaning.filter_language(judged, ("en", "de")).select("id", "language")


@query(
    "parse_date_drop_bad",
    with_tables("raw_reviews")
    + " select id, cast(review_date as date) as review_date from raw_reviews where try_cast(review_date as date) is not null",
)
def _dates(spark, sf_dir):
    return raw_reviews(spark, sf_dir).transform(cleaning.drop_bad_dates).select("id", "review_date")


@query(
    "clean_and_filter",
    CLEAN_AND_FILTER + " select id, app_id, cleaned_text, language, day as review_date from kept",
)
def _clean_and_filter(spark, sf_dir):
    return cleaning.clean_and_filter(
        raw_reviews(spark, sf_dir), ["id"], profile=learned_profile(spark, sf_dir)
    ).select("id", "app_id", "cleaned_text", "language", "review_date")


@query(
    "drop_reasons",
    CLEANED + DEDUPED + "," + PROFILE + "," + judged_language("first_rows", "id")
    + """, steps as (select 'input' as step from cleaned
        union all select 'empty' from cleaned where coalesce(length(cleaned_text), 0) = 0
        union all select case when coalesce(language, '') <> 'en' then 'language'
            when try_cast(review_date as date) is null then 'date' else 'kept' end
        from first_rows as f left join judged_lang as j on f.id = j.id)
    select step, count(*) as "rows" from steps group by step""",
)
def _drop_reasons(spark, sf_dir):
    return cleaning.drop_reasons(raw_reviews(spark, sf_dir), ["id"], learned_profile(spark, sf_dir))


@query(
    "fill_defaults",
    with_tables("raw_reviews")
    + """ select id, coalesce(thumbs_up, 0) as thumbs_up, cast(null as varchar) as user_name,
        cast(null as varchar) as app_version from raw_reviews""",
)
def _defaults(spark, sf_dir):
    return cleaning.fill_defaults(raw_reviews(spark, sf_dir)).select("id", "thumbs_up", "user_name", "app_version")


@query(
    "positional_id",
    with_tables("raw_reviews")
    + " select id, cast(row_number() over (order by id) - 1 as varchar) as review_id from raw_reviews",
)
def _positional(spark, sf_dir):
    return cleaning.positional_id(raw_reviews(spark, sf_dir).drop("review_id"), ["id"]).select("id", "review_id")


@query(
    "select_app_limit",
    with_tables("raw_reviews") + " select id, app_id, rating from raw_reviews where app_id = 'app1' order by id limit 50",
)
def _select_app(spark, sf_dir):
    return cleaning.select_app(raw_reviews(spark, sf_dir), "app1", 50).select("id", "app_id", "rating")


@query(
    "explore_reviews",
    CLEANED
    + """ select id, app_id, rating, cleaned_text from cleaned where contains(lower(cleaned_text), 'the')
        and regexp_matches(cleaned_text, '[Oo]n') and app_id in ('app0', 'app2') and rating in (1, 2, 3)
        and try_cast(review_date as date) >= date '2024-01-10' and try_cast(review_date as date) <= date '2024-03-01'""",
)
def _explore(spark, sf_dir):
    reviews = raw_reviews(spark, sf_dir).transform(cleaning.add_cleaned_text)
    reviews = reviews.withColumn("review_date", parse_date(F.col("review_date")))
    return cleaning.explore(
        reviews, contains="the", pattern="[Oo]n", app_ids=["app0", "app2"], ratings=[1, 2, 3],
        since="2024-01-10", until="2024-03-01",
    ).select("id", "app_id", "rating", "cleaned_text")
