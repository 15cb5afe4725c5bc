"""Classification as batch scoring: cache split, batches, scorers, validation, storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedloom.functions.text import cache_key, tokens
from feedloom.operators.prompts import prompt_for
from feedloom.operators.upsert import first_per_key, upsert_replace
from feedloom.plans.layout import small_side
from feedloom.plans.ordering import grouped_position
from feedloom.plans.staging import stage, staging_path
from feedloom.plans.winners import KEY, digest
from feedloom.schemas import SENTIMENTS, THEME_NAMES

# Fixed value: reviews per scoring request.
BATCH_SIZE = 20
# Fixed value: layout of one scored response.
RESPONSE_SCHEMA = (
    "classifications array<struct<review_index:int,theme:string,sentiment:string,severity:int,reasoning:string>>"
)
FIELDS = ["theme", "sentiment", "severity", "reasoning"]
# Scorer: distinct uncached texts (cache_key, text[, examples]) -> (cache_key, *FIELDS).
Scorer = Callable[[DataFrame], DataFrame]

# Default lexicon (term, theme, sentiment weight, severity weight).
LEXICON = [
    ("crash", "Performance & Crashes", -2, 2), ("crashes", "Performance & Crashes", -2, 2),
    ("crashing", "Performance & Crashes", -2, 2), ("freeze", "Performance & Crashes", -2, 2),
    ("freezes", "Performance & Crashes", -2, 2), ("slow", "Performance & Crashes", -1, 1),
    ("lag", "Performance & Crashes", -1, 1), ("battery", "Performance & Crashes", -1, 1),
    ("login", "Login & Account", -1, 1), ("password", "Login & Account", -1, 1),
    ("account", "Login & Account", 0, 0), ("locked", "Login & Account", -2, 3), ("verification", "Login & Account", -1, 1),
    ("charged", "Payments & Billing", -2, 2), ("refund", "Payments & Billing", -2, 2),
    ("payment", "Payments & Billing", 0, 1), ("billing", "Payments & Billing", -1, 1), ("card", "Payments & Billing", 0, 0),
    ("design", "UI/UX", 0, 0), ("layout", "UI/UX", 0, 0), ("confusing", "UI/UX", -2, 1), ("navigation", "UI/UX", 0, 0),
    ("wish", "Feature Request", 0, 0), ("feature", "Feature Request", 0, 0), ("missing", "Feature Request", -1, 1),
    ("support", "Customer Support", 0, 0), ("agent", "Customer Support", 0, 0), ("response", "Customer Support", 0, 0),
    ("price", "Pricing", 0, 0), ("expensive", "Pricing", -2, 1), ("subscription", "Pricing", 0, 0), ("overpriced", "Pricing", -2, 1),
    ("notification", "Notifications", 0, 0), ("notifications", "Notifications", 0, 0), ("alerts", "Notifications", 0, 0),
    ("privacy", "Data & Privacy", -1, 1), ("permissions", "Data & Privacy", -1, 1), ("tracking", "Data & Privacy", -1, 1),
    ("love", "Other", 2, 0), ("great", "Other", 2, 0), ("good", "Other", 1, 0), ("easy", "Other", 1, 0),
    ("bad", "Other", -1, 1), ("terrible", "Other", -2, 2), ("worst", "Other", -2, 2), ("useless", "Other", -2, 2),
]
# Fixed value: a lexicon with more rows than this is joined by shuffle instead of broadcast.
MAX_BROADCAST_TERMS = 100_000


def with_cache_key(reviews: DataFrame, prompt_version: str, context: str | None = None) -> DataFrame:
    """Add cache_key; ``context`` names a column hashed into it (for instance the retrieved examples)."""
    extra = F.col(context) if context else None
    return reviews.withColumn("cache_key", cache_key(F.lit(prompt_version), F.col("cleaned_text"), extra))


def cache_split(reviews: DataFrame, cache: DataFrame) -> DataFrame:
    """Reviews with the cached response where there is one; ``hit`` tells which."""
    known = cache.select("cache_key", "response", F.lit(True).alias("_known"))
    return reviews.join(known, "cache_key", "left").withColumn(
        "hit", F.coalesce(F.col("_known"), F.lit(False))
    ).drop("_known")


def written_split(reviews: DataFrame, cache: DataFrame, seen: Observation) -> DataFrame:
    """The split of ``cache_split``, written, with the texts of the misses only; ``seen`` gets total, hits and misses.

    The digests of a cache counted to be small enough are sent out, so that texts are not shuffled to find what is
    cached; responses then meet the hits by key, without a text.
    """
    # A text without a key is never cached.
    digests = cache.filter(F.col("cache_key").isNotNull()).select(*digest(F.col("cache_key")))
    digests = stage(digests, "cached-keys")
    side = small_side(digests.distinct())
    if side is None:
        split = cache_split(reviews, cache)
    else:
        marked = reviews.withColumns(dict(zip(KEY, digest(F.col("cache_key"))))).join(side.withColumn("hit", F.lit(True)), list(KEY), "left")
        split = marked.drop(*KEY).withColumn("hit", F.coalesce("hit", F.lit(False)))
    split = split.withColumn("cleaned_text", F.when(~F.col("hit"), F.col("cleaned_text"))).observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )
    return stage(split, "split")


def progress_metrics(split: DataFrame) -> DataFrame:
    """Reviews in all, served from the cache, and left to score."""
    return split.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )


def distinct_misses(split: DataFrame) -> DataFrame:
    """Uncached texts once each, however many reviews repeat them; the smallest review id gives the order."""
    misses = split.filter(~F.col("hit"))
    extra = ["examples"] if "examples" in misses.columns else []
    return first_per_key(
        misses.select("cache_key", F.col("id").alias("first_id"), F.col("cleaned_text").alias("text"), *extra),
        ["cache_key"],
        ["first_id"],
    )


def number_batches(misses: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Add batch_id and review_index: consecutive texts, ``size`` to a request, over the whole table."""
    placed = grouped_position(misses, [], [F.col("first_id"), F.col("cache_key")], name="_place")
    return placed.select(
        *misses.columns,
        F.floor((F.col("_place") - 1) / size).cast("bigint").alias("batch_id"),
        ((F.col("_place") - 1) % size).cast("int").alias("review_index"),
    )


def score_batches(misses: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """One row per request with its reviews in order."""
    extra = ["examples"] if "examples" in misses.columns else []
    return number_batches(misses, size).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("review_index", "text", "cache_key", *extra))).alias("items")
    )


def render_prompts(batches: DataFrame, prompt_version: str) -> DataFrame:
    return batches.withColumn("prompt", prompt_for(prompt_version)(F.col("items")))


def lexicon_table(spark) -> DataFrame:
    return spark.createDataFrame(LEXICON, "term string, theme string, polarity int, severity int")


def lexicon_weights(lexicon: DataFrame, themes: list[str]) -> DataFrame:
    """One row per term with a weight column per theme."""
    weight = F.col("weight") if "weight" in lexicon.columns else F.lit(1)
    return lexicon.groupBy("term").agg(
        *[F.sum(F.when(F.col("theme") == t, weight).otherwise(0)).alias(f"_w{i}") for i, t in enumerate(themes)],
        F.sum("polarity").alias("_polarity"),
        F.sum("severity").alias("_severity"),
    )


def classify_lexicon(
    texts: DataFrame,
    lexicon: DataFrame,
    key: str = "cache_key",
    text: str = "text",
    themes: list[str] = THEME_NAMES,
    fallback: str = "Other",
) -> DataFrame:
    """theme, sentiment, severity and reasoning from weighted terms over the whole text.

    Best theme by summed weight (earlier theme on ties), sentiment by the sign of the summed
    polarity, severity 1 plus the summed severity, within 1..5. Words beyond a broadcast lexicon are shuffled with a
    short key: a number, or the digest of a longer one, which is joined back to the sums.
    """
    weights = lexicon_weights(lexicon, themes)
    small = lexicon.select("term").distinct().limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
    short = [key] if small or dict(texts.dtypes)[key] in ("int", "bigint") else list(KEY)
    named = texts if short == [key] else texts.select("*", *digest(F.col(key)))
    words = named.select(*short, F.explode_outer(tokens(F.col(text))).alias("term"))
    numbers = [f"_w{i}" for i in range(len(themes))] + ["_polarity", "_severity"]
    sums = (
        words.join(F.broadcast(weights) if small else weights, "term", "left")
        .groupBy(*short)
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in numbers], F.count("_polarity").alias("_found"))
    )
    if short != [key]:
        sums = sums.join(named.select(key, *KEY).distinct(), list(KEY))
    top = F.greatest(*[F.col(f"_w{i}") for i in range(len(themes))]) if len(themes) > 1 else F.col("_w0")
    theme = F.when(top <= 0, F.lit(fallback)).otherwise(
        F.coalesce(*[F.when(F.col(f"_w{i}") == top, F.lit(t)) for i, t in enumerate(themes)])
    )
    sentiment = (
        F.when(F.col("_polarity") > 0, "positive").when(F.col("_polarity") < 0, "negative").otherwise("neutral")
    )
    return sums.select(
        key,
        theme.alias("theme"),
        sentiment.alias("sentiment"),
        F.greatest(F.lit(1), F.least(F.lit(5), 1 + F.col("_severity"))).cast("int").alias("severity"),
        F.concat(F.col("_found").cast("string"), F.lit(" known terms in the text")).alias("reasoning"),
    )


def lexicon_scorer(lexicon: DataFrame, **params) -> Scorer:
    return lambda misses: classify_lexicon(misses, lexicon, **params)


def prompted_scorer(answer: Callable[[str], str], prompt_version: str, size: int = BATCH_SIZE) -> Scorer:
    """Scorer around a user function prompt -> JSON response, called once per request on the executors.

    Responses are written out before validation, so a later pass never repeats the requests.
    Texts of an invalid response are left out of the result; they stay uncached.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["batch_id"]].assign(response=[answer(p) for p in frame["prompt"]])

    def score(misses: DataFrame) -> DataFrame:
        batches = stage(render_prompts(score_batches(misses, size), prompt_version), "requests")
        responses = stage(
            batches.select("batch_id", "prompt").mapInPandas(ask, "batch_id bigint, response string"), "responses"
        )
        valid = check_coverage(parse_response(responses), batches.select("batch_id", F.size("items").alias("n")))
        asked = batches.select("batch_id", F.inline("items"))
        return (
            last_answers(valid.filter("batch_valid"))
            .join(asked.select("batch_id", "review_index", "cache_key"), ["batch_id", "review_index"])
            .select("cache_key", *FIELDS)
        )

    return score


def parse_response(responses: DataFrame) -> DataFrame:
    """JSON responses to typed rows with their place, each flagged ``row_valid``.

    A row is valid when no field is missing, theme and sentiment are known and severity is 1..5.
    A response that is not of the declared form gives one row with null fields.
    """
    parsed = responses.select(
        "batch_id", F.from_json("response", RESPONSE_SCHEMA).getField("classifications").alias("_c")
    )
    rows = parsed.select("batch_id", F.posexplode_outer("_c").alias("answer_pos", "_r")).select(
        "batch_id", "answer_pos", "_r.*"
    )
    return rows.withColumn("row_valid", valid_record() & F.col("review_index").isNotNull())


def valid_record() -> Column:
    ok = (
        F.col("theme").isin(*THEME_NAMES)
        & F.col("sentiment").isin(*SENTIMENTS)
        & F.col("severity").between(1, 5)
        & F.col("reasoning").isNotNull()
    )
    return F.coalesce(ok, F.lit(False))


def check_coverage(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add batch_valid: every row valid and the indices are exactly 0..n-1, repeats allowed."""
    per_batch = rows.groupBy("batch_id").agg(
        F.bool_and("row_valid").alias("_all_valid"),
        F.count_distinct("review_index").alias("_indices"),
        F.min("review_index").alias("_low"),
        F.max("review_index").alias("_high"),
    )
    covered = per_batch.join(sizes, "batch_id").select(
        "batch_id",
        F.coalesce(
            F.col("_all_valid")
            & (F.col("_low") == 0)
            & (F.col("_high") == F.col("n") - 1)
            & (F.col("_indices") == F.col("n")),
            F.lit(False),
        ).alias("batch_valid"),
    )
    return rows.join(covered, "batch_id")


def last_answers(rows: DataFrame) -> DataFrame:
    """One answer per index of a batch; the last one given wins."""
    return rows.groupBy("batch_id", "review_index").agg(
        F.max_by(F.struct(*FIELDS), "answer_pos").alias("_a")
    ).select("batch_id", "review_index", "_a.*")


def classification_rows(scored: DataFrame, prompt_version: str, keep: Sequence[str] = ()) -> DataFrame:
    """Scored reviews in the stored layout; raw_response is the JSON of the four fields."""
    reasoning = F.col("reasoning") if "reasoning" in scored.columns else F.lit(None).cast("string")
    with_reasoning = scored.withColumn("reasoning", reasoning)
    return with_reasoning.select(
        "review_id",
        F.lit(prompt_version).alias("prompt_version"),
        *FIELDS,
        F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("raw_response"),
        *keep,
    )


def store_classifications(
    existing: DataFrame, scored: DataFrame, prompt_version: str, sequence: str | None = None
) -> DataFrame:
    """The classifications table after this run, keyed by review and version.

    Of several answers to one review the one with the greatest ``sequence`` (a column of ``scored``
    that tells which came later) is stored; without it, the greatest response.
    """
    rows = classification_rows(scored, prompt_version, [sequence] if sequence else [])
    return upsert_replace(existing, rows, ["review_id", "prompt_version"], [*([sequence] if sequence else []), "raw_response"])


def classify_reviews(
    reviews: DataFrame,
    cache: DataFrame,
    prompt_version: str,
    scorer: Scorer,
    retriever: Callable[[DataFrame], DataFrame] | None = None,
    progress: Callable[[dict[str, int]], None] | None = None,
) -> dict[str, DataFrame]:
    """Classify reviews (id, cleaned_text): cached answers are reused, the rest is scored once per text.

    ``retriever`` maps reviews to (id, examples) and is required by v3. Returns ``results``
    (review_id and the four fields), ``new_cache`` (entries to store), ``rejected`` (reviews whose
    scoring failed validation) and, for v3, ``retrievals``. The split is written out once, with the
    texts of the misses only, so texts are hashed and the cache is joined once; ``progress`` then
    gets the counts total, hits and misses.
    """
    prompt_for(prompt_version)
    if prompt_version == "v3" and retriever is None:
        raise ValueError("prompt v3 needs a retriever")
    seen = Observation()
    split = written_split(with_cache_key(reviews.select("id", "cleaned_text"), prompt_version), cache, seen)
    if progress is not None:
        progress(seen.get)
    outputs: dict[str, DataFrame] = {}
    if prompt_version == "v3":
        retrieved = retriever(split.filter(~F.col("hit")).select("id", "cleaned_text"))
        split = split.join(retrieved.select("id", "examples"), "id", "left")
        outputs["retrievals"] = retrieved.select(
            F.col("id").alias("review_id"), F.lit(prompt_version).alias("prompt_version"), "examples"
        )
    # Written: every output below is made from one pass over the scorer.
    scored = stage(scorer(distinct_misses(split)), "scored")
    fresh = split.filter(~F.col("hit")).join(scored, "cache_key", "left")
    hits = split.filter("hit")
    if "response" not in hits.columns:
        hits = hits.join(cache.select("cache_key", "response"), "cache_key")
    reused = hits.select(F.col("id").alias("review_id"), "response.*")
    done = F.col("theme").isNotNull()
    outputs["results"] = reused.unionByName(fresh.filter(done).select(F.col("id").alias("review_id"), *FIELDS))
    outputs["rejected"] = fresh.filter(~done).select(F.col("id").alias("review_id"), "cache_key")
    outputs["new_cache"] = scored.select("cache_key", F.struct(*FIELDS).alias("response"))
    return outputs


def train_theme_model(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """A text classifier on labelled reviews: hashed tf-idf words into multinomial logistic regression.

    The fitted regression holds its training summary and with that the session, which cannot be sent to tasks once something
    has been observed in it; so the model is written and read again, which leaves the summary behind.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer

    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(labelled)
    model = Pipeline(
        stages=[
            indexer,
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}']+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01),
            IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels),
        ]
    ).fit(labelled)
    path = staging_path(labelled.sparkSession, "theme-model")
    model.write().save(path)
    return PipelineModel.load(path)


def classify_model(texts: DataFrame, model, *keep: str) -> DataFrame:
    return model.transform(texts).select(*keep, "predicted")
