"""Language identification from a learned profile of words and word edges, as a join and an aggregate.

A text's features are its words and the first and last three characters of each. The profile has a row per feature
and language it was seen in, keyed by a 64-bit hash, and one row per language for what every feature costs; it has no
bound on words or languages. The score of a language is a sum over the joined rows: add-one smoothed log frequencies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import tokens
from feedloom.plans.layout import common_part, small_side
from feedloom.plans.staging import stage

# Shorter texts have no language; characters of a word edge; the key of the rows per language.
MIN_LENGTH, EDGE, EVERY = 3, 3, 0

# Rows (the digest of a key and a language) up to which what was found is sent to every executor.
FOUND_ROWS = 2_000_000

# Frequent function words per language, for use without labelled text.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ich ein eine mit für auf sehr aber wie auch sie wir man zu den dem von im es",
    "en": "the and is it to of this that for with my you not but on have are was app great every me works so in",
    "es": "el la los las y es no que en una un con para por muy pero como está mi lo se al del esta más",
    "fr": "le la les et est pas je un une avec pour sur très mais comme aussi cette mon des du ce que qui dans ne",
    "it": "il lo gli e non che di una un con per molto ma come questa mio della sono si al nel anche più ho",
    "pt": "o os as e não que em uma um com para por muito mas como está meu do da no na se mais eu foi",
}


def features(text: Column) -> Column:
    """The words of a text and their edges, as 64-bit keys."""
    word = lambda w: F.array(w)
    edges = lambda w: F.array(w, F.concat(F.lit("^"), F.left(w, F.lit(EDGE))), F.concat(F.right(w, F.lit(EDGE)), F.lit("$")))
    grams = F.flatten(F.transform(tokens(text), lambda w: F.when(F.length(w) >= EDGE, edges(w)).otherwise(word(w))))
    return F.transform(grams, lambda g: F.xxhash64(g))


def learn_profile(labelled: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """(gram, lang, gain) from labelled text, written: what an occurrence of the feature adds to the language's score.

    The row of a language under EVERY is what every feature of a text, known or not, adds to it.
    """
    rows = labelled.filter(F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.explode(features(F.col(text))).alias("gram"))
    return _profile(rows.groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n")))


def seed_profile(spark: SparkSession) -> DataFrame:
    """A small profile from the fixed function words, one count each."""
    rows = [(" ".join(words.split()), lang) for lang, words in FUNCTION_WORDS.items()]
    return learn_profile(spark.createDataFrame(rows, "text string, lang string"))


def _profile(counts: DataFrame) -> DataFrame:
    counts = stage(counts, "language-counts")
    known = counts.agg(F.count_distinct("gram")).first()[0]
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    every = totals.select(F.lit(EVERY).cast("long").alias("gram"), "lang", (-F.log(F.col("n") + F.lit(float(known)))).alias("gain"))
    return stage(counts.select("gram", "lang", F.log(F.col("n") + 1.0).alias("gain")).unionByName(every), "language-profile")


def language_scores(df: DataFrame, profile: DataFrame, keys: Sequence[str], text: str = "cleaned_text") -> DataFrame:
    """(keys, lang, score, known): a row per key and language that shares a feature with the whole text."""
    grams = df.filter(F.length(text) >= MIN_LENGTH).select(*keys, features(F.col(text)).alias("_grams"))
    # How often each feature counts; the row per language counts once for every feature.
    times = F.concat(
        F.transform("_grams", lambda g: F.struct(g.alias("gram"), F.lit(1).alias("times"))),
        F.array(F.struct(F.lit(EVERY).cast("long").alias("gram"), F.size("_grams").alias("times"))),
    )
    rows = grams.select(*keys, F.inline(times))
    side = small_side(profile)
    score, known = F.sum(F.col("times") * F.col("gain")).alias("score"), F.sum(F.when(F.col("gram") != EVERY, F.col("times")).otherwise(0)).alias("known")
    if side is not None:
        return rows.join(side, "gram").groupBy(*keys, "lang").agg(score, known).filter("known > 0")
    # Beyond what can be sent out the frequent features are, and only the others of a text meet the profile by shuffle.
    common, rare = _frequent(profile)
    met = rows.join(F.broadcast(common), "gram", "left")
    folded = stage(
        met.groupBy(*keys, "lang", F.when(F.col("lang").isNull(), F.col("gram")).alias("left_over")).agg(score, known, F.sum("times").alias("times")),
        "language-scores",
    )
    late = folded.filter("lang is null").select(*keys, F.col("left_over").alias("gram"), "times").join(rare, "gram")
    parts = folded.filter("lang is not null").select(*keys, "lang", "score", "known").unionByName(
        late.groupBy(*keys, "lang").agg(score, known)
    )
    return parts.groupBy(*keys, "lang").agg(F.sum("score").alias("score"), F.sum("known").alias("known")).filter("known > 0")


def _frequent(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profile's rows of the features seen most often, as many as can be sent out, and all others."""
    seen = F.when(F.col("gram") == EVERY, F.lit(1e18)).otherwise(F.sum(F.exp("gain") - 1.0))
    seen = profile.groupBy("gram").agg(seen.alias("seen"), F.count(F.lit(1)).alias("langs"))
    # Whole counts, whatever their logarithms lost.
    seen = stage(seen.withColumn("level", F.floor(4 * F.log2(F.round("seen") + 1.0))), "language-features")
    frequent = seen.filter(common_part(seen, F.col("level"), F.col("langs"))).select("gram")
    side = small_side(frequent)
    frequent = frequent if side is None else side
    return stage(profile.join(frequent, "gram", "left_semi"), "language-common"), stage(profile.join(frequent, "gram", "left_anti"), "language-rare")


def detect_language(
    df: DataFrame, profile: DataFrame, keys: Sequence[str] = ("id",), text: str = "cleaned_text"
) -> DataFrame:
    """Add ``language``: the best-scoring one; null below three characters or without a known feature."""
    return df.drop("language").join(_best_language(language_scores(df, profile, keys, text), keys), list(keys), "left")


def in_languages(
    df: DataFrame, profile: DataFrame, keep: Sequence[str], keys: Sequence[str] = ("id",), text: str = "cleaned_text"
) -> DataFrame:
    """The rows whose ``language``, as ``detect_language`` adds it, is one of ``keep``.

    Only the keys of these are joined back, so no text is shuffled while they are few enough to be sent out.
    """
    scores = stage(language_scores(df, profile, keys, text).select(*keys, "lang", "score"), "languages")
    found = _best_language(scores, keys).filter(F.col("language").isin(*keep))
    side = small_side(found, FOUND_ROWS)
    return df.drop("language").join(found if side is None else side, list(keys))


def _best_language(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.min_by("lang", F.struct(-F.round("score", 6), F.col("lang"))).alias("language")
    return scores.groupBy(*keys).agg(best)
