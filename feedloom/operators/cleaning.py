"""Cleaning: text, empties, repeats, language, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import ISO, parse_date
from feedloom.functions.text import clean_text, has_text
from feedloom.operators.language import detect_language, in_languages, seed_profile
from feedloom.plans.ordering import grouped_position
from feedloom.plans.winners import KEY, one_per_key

# Fixed value: languages kept by default.
KEEP_LANGUAGES = ("en",)


def add_cleaned_text(df: DataFrame, extra_emoji: dict[str, str] | None = None) -> DataFrame:
    return df.withColumn("cleaned_text", clean_text(F.col("text"), extra_emoji))


def drop_empty(df: DataFrame) -> DataFrame:
    """Keep rows with some cleaned text; a null text is dropped too.

    Cleaning leaves text exactly where there is a character that is not blank, so the raw text
    decides, at its first such character and before any cleaning.
    """
    return df.filter(has_text(F.col("text")) if "text" in df.columns else F.length("cleaned_text") > 0)


def dedupe_first(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Drop repeats of (app_id, cleaned_text), first wins."""
    return _dedupe_keyed(df, order).select(df.columns)


def _dedupe_keyed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first rows with the digest of their key, which names a row from here on."""
    return one_per_key(df, [F.col("app_id"), F.col("cleaned_text")], order)


def filter_language(df: DataFrame, keep: Sequence[str] = KEEP_LANGUAGES) -> DataFrame:
    return df.filter(F.col("language").isin(*keep))


def drop_bad_dates(df: DataFrame, formats: Sequence[str] = ISO) -> DataFrame:
    """review_date as DATE; rows whose date does not parse are dropped."""
    return df.withColumn("review_date", parse_date(F.col("review_date").cast("string"), formats)).filter(
        F.col("review_date").isNotNull()
    )


def clean_and_filter(
    df: DataFrame,
    order: Sequence[str],
    keep_languages: Sequence[str] = KEEP_LANGUAGES,
    profile: DataFrame | None = None,
    formats: Sequence[str] = ISO,
) -> DataFrame:
    """Clean, drop empties, first-wins dedupe, language filter, date filter: in this order.

    The last two look at one row each, so the cheaper one is done first.
    """
    deduped = df.transform(add_cleaned_text).transform(drop_empty).transform(_dedupe_keyed, order)
    profile = profile if profile is not None else seed_profile(df.sparkSession)
    return in_languages(drop_bad_dates(deduped, formats), profile, keep_languages, keys=KEY).drop(*KEY)


def drop_reasons(df: DataFrame, order: Sequence[str], profile: DataFrame, keep_languages: Sequence[str] = KEEP_LANGUAGES) -> DataFrame:
    """Rows in, and rows lost at each cleaning step, so a silent zero-row import shows its cause."""
    cleaned = df.transform(add_cleaned_text).withColumn("_empty", ~F.coalesce(has_text(F.col("text")), F.lit(False)))
    judged = detect_language(_dedupe_keyed(cleaned.filter(~F.col("_empty")), order), profile, keys=KEY)
    kept_lang = F.coalesce(F.col("language").isin(*keep_languages), F.lit(False))
    dated = parse_date(F.col("review_date").cast("string")).isNotNull()
    tallies = cleaned.select(F.lit("input").alias("step")).unionByName(
        cleaned.filter("_empty").select(F.lit("empty").alias("step"))
    ).unionByName(
        judged.select(
            F.when(~kept_lang, "language").when(~dated, "date").otherwise("kept").alias("step")
        )
    )
    return tallies.groupBy("step").agg(F.count(F.lit(1)).alias("rows"))


def fill_defaults(df: DataFrame) -> DataFrame:
    """thumbs_up null to 0; optional columns that are absent become typed nulls."""
    # Optional review columns and their types.
    optional = {
        "user_name": "string",
        "thumbs_up": "int",
        "review_date": "string",
        "app_version": "string",
    }
    for name, kind in optional.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("thumbs_up", F.coalesce(whole_number(F.col("thumbs_up")), F.lit(0)))


def whole_number(column: Column) -> Column:
    """An int from a number or its text, ``4.0`` included; null for anything that is no number of an int's size."""
    return column.try_cast("double").try_cast("int")


def positional_id(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """review_id = 0-based place in the input, as text; given before any row is filtered."""
    placed = grouped_position(df, [], [F.col(c) for c in order], name="_place")
    return placed.withColumn("review_id", (F.col("_place") - 1).cast("string")).drop("_place")


def content_id(df: DataFrame) -> DataFrame:
    """review_id from the content: no ordering step, and two uploads never collide by position."""
    return df.withColumn("review_id", F.sha2(F.concat_ws("\u0001", "app_id", "text", "review_date"), 256))


def select_app(df: DataFrame, app_id: str, limit: int | None = None) -> DataFrame:
    """One app's reviews, or its first ``limit`` by id."""
    chosen = df.filter(F.col("app_id") == app_id)
    return chosen.orderBy("id").limit(limit) if limit else chosen


def explore(
    df: DataFrame,
    contains: str | None = None,
    pattern: str | None = None,
    app_ids: Sequence[str] | None = None,
    ratings: Sequence[int] | None = None,
    themes: Sequence[str] | None = None,
    sentiments: Sequence[str] | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Search and filter reviews; every given condition must hold."""
    conditions = []
    if contains is not None:
        conditions.append(F.contains(F.lower("cleaned_text"), F.lit(contains.lower())))
    if pattern is not None:
        conditions.append(F.col("cleaned_text").rlike(pattern))
    for name, values in (("app_id", app_ids), ("rating", ratings), ("theme", themes), ("sentiment", sentiments)):
        if values is not None:
            conditions.append(F.col(name).isin(*values))
    if since is not None:
        conditions.append(F.col("review_date") >= F.lit(since).cast("date"))
    if until is not None:
        conditions.append(F.col("review_date") <= F.lit(until).cast("date"))
    for condition in conditions:
        df = df.filter(condition)
    return df
