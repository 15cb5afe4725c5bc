"""Labelled-example retrieval without leakage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import tokens
from feedloom.functions.vectors import hashed_embedding, place_and_sign, word_key
from feedloom.operators.upsert import upsert_replace
from feedloom.plans import lsh
from feedloom.plans.knn import BLOCK_ROWS, knn_join
from feedloom.plans.layout import common_part, small_side
from feedloom.plans.staging import stage

# Examples per review, texts per embedding request, default dimensions.
EXAMPLES = 3
EMBED_BATCH = 100
DIM = 64
# Fixed value: a weighted sum of words below this is none; idf is 1 at least.
SMALLEST_WEIGHT = 1e-9


def embed_texts(df: DataFrame, text: str = "text", dim: int = DIM) -> DataFrame:
    """Add ``embedding``: a hashed word vector of the whole text, each text by itself."""
    return df.withColumn("embedding", hashed_embedding(F.col(text), dim))


def fit_idf(pool: DataFrame, text: str = "text") -> DataFrame:
    """(term, idf) of the pool's words, written: to be stored with the pool and used again for every query.

    The smoothed inverse document frequency ln((1 + n) / (1 + df)) + 1; the row with an empty term holds it for words
    the pool does not have. Words are keyed by their hash.
    """
    terms = pool.select(F.array_distinct(F.transform(tokens(F.col(text)), word_key)).alias("terms"))
    n = terms.filter("terms is not null").count()
    counts = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    unseen = pool.sparkSession.createDataFrame([("", 0)], "term string, df long")
    idf = F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0
    return stage(counts.unionByName(unseen).select("term", idf.alias("idf")), "idf")


def embed_tfidf(df: DataFrame, idf: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, embedding): unit vectors of signed word counts times idf, words hashed into ``dim`` places.

    All in the JVM: words meet the idf table where they lie, and a text's places are put together from at most
    ``dim`` sums. Of a table too large to be sent out the frequent words are, and only a text's other words are
    shuffled. A text without a direction has no row.
    """
    words = df.select(key, F.explode(F.transform(tokens(F.col(text)), word_key)).alias("term"))
    place, sign = place_and_sign(F.col("term"), dim)
    unseen = F.lit(idf.filter("term = ''").first()["idf"])
    side = small_side(idf)
    if side is not None:
        placed = words.join(side, "term", "left").select(key, place.alias("place"), (sign * F.coalesce("idf", unseen)).alias("w"))
    else:
        frequent = common_part(idf, F.floor(-4 * F.col("idf")))
        common, rare = stage(idf.filter(frequent), "idf-common"), idf.filter(~frequent)
        met = words.join(F.broadcast(common), "term", "left")
        folded = met.groupBy(key, place.alias("place"), F.when(F.col("idf").isNull(), F.col("term")).alias("left_over"))
        folded = stage(folded.agg(F.sum(sign * F.col("idf")).alias("w"), F.count(F.lit(1)).alias("tf")), "tfidf-places")
        late = folded.filter("left_over is not null").select(key, "place", F.col("left_over").alias("term"), "tf").join(rare, "term", "left")
        placed = folded.filter("left_over is null").select(key, "place", "w").unionByName(
            late.select(key, "place", (sign * F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
        )
    # Words that cancel out may leave the rounding of their sum.
    sums = placed.groupBy(key, "place").agg(F.sum("w").alias("w")).filter(F.abs("w") > SMALLEST_WEIGHT)
    sparse = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    value = lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)) / F.col("norm")
    return sparse.select(key, F.transform(F.sequence(F.lit(1), F.lit(dim)), value).alias("embedding"))


def embed_with(df: DataFrame, embed: Callable[[list[str]], list], text: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """Add ``embedding`` from a user function texts -> vectors, called on executors, ``batch`` texts at a time."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield part.assign(embedding=[list(v) for v in embed(part[text].tolist())])

    return df.mapInPandas(run, schema)


def build_index(labelled: DataFrame, exclude: DataFrame | None = None, key: str = "review_id") -> DataFrame:
    """The retrievable pool: labelled rows minus the held-out ids; may be empty."""
    return labelled if exclude is None else labelled.join(exclude.select(key).distinct(), key, "left_anti")


def retrieve_top_k(
    queries: DataFrame,
    pool: DataFrame,
    k: int = EXAMPLES,
    query_id: str = "review_id",
    pool_id: str = "review_id",
    vector: str = "embedding",
    exclude: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Up to k nearest pool rows per query by squared Euclidean distance, ties by pool id. Exact."""
    found = knn_join(queries, pool, k, query_id, pool_id, vector, exclude=exclude, block_rows=block_rows)
    return found.select(
        F.col("qid").alias("query_id"),
        F.col("pid").alias("neighbor_id"),
        (F.col("distance") * F.col("distance")).alias("distance"),
        "rank",
    )


def retrieve_approximate(queries: DataFrame, index: lsh.Index, k: int = EXAMPLES, **params) -> DataFrame:
    """As ``retrieve_top_k``, from a fitted index: most of the nearest rows at a fraction of the work. Exact search stays the default.

    ``lsh.fit`` makes the index of a pool, ``lsh.recall`` tells what share of the exact neighbours was found.
    """
    return lsh.search(queries, index, k, **params)


def kfold_retrieve(folded: DataFrame, k: int = EXAMPLES, key: str = "review_id", **params) -> DataFrame:
    """Every labelled row queries the rows of the other folds only; one join for all folds."""
    return retrieve_top_k(folded, folded, k, key, key, exclude="fold", **params)


def holdout_retrieve(evaluated: DataFrame, labelled: DataFrame, k: int = EXAMPLES, key: str = "review_id", **params) -> DataFrame:
    """Retrieval with the whole evaluation set held out of the pool."""
    return retrieve_top_k(evaluated, build_index(labelled, evaluated, key), k, key, key, **params)


def examples_per_query(
    neighbors: DataFrame, queries: DataFrame, pool: DataFrame, key: str = "review_id"
) -> DataFrame:
    """(key, examples): the retrieved texts with their labels in rank order; an empty list when none."""
    described = neighbors.join(
        pool.select(F.col(key).alias("neighbor_id"), "text", "theme", "sentiment"), "neighbor_id"
    )
    packed = described.groupBy("query_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "text", "theme", "sentiment", "distance"))),
            lambda e: F.struct(e["text"], e["theme"], e["sentiment"], e["distance"]).cast(
                "struct<text:string,theme:string,sentiment:string,distance:double>"
            ),
        ).alias("examples")
    )
    nothing = F.array().cast("array<struct<text:string,theme:string,sentiment:string,distance:double>>")
    return (
        queries.select(F.col(key).alias("query_id"))
        .join(packed, "query_id", "left")
        .select(F.col("query_id").alias(key), F.coalesce("examples", nothing).alias("examples"))
    )


def text_retriever(pool: DataFrame, k: int = EXAMPLES, dim: int = DIM) -> Callable[[DataFrame], DataFrame]:
    """A retriever for classification: reviews (id, cleaned_text) -> (id, examples) from the pool."""

    def retrieve(reviews: DataFrame) -> DataFrame:
        queries = embed_texts(reviews.select(F.col("id").alias("review_id"), F.col("cleaned_text").alias("text")), dim=dim)
        embedded = pool if "embedding" in pool.columns else embed_texts(pool, dim=dim)
        neighbors = retrieve_top_k(queries, embedded, k)
        return examples_per_query(neighbors, queries, pool).withColumnRenamed("review_id", "id")

    return retrieve


def leakage_check(neighbors: DataFrame, folded: DataFrame, key: str = "review_id") -> DataFrame:
    """Retrieved rows, and how many share the id or the fold of their query; expected 0."""
    folds = folded.select(key, "fold")
    q = folds.select(F.col(key).alias("query_id"), F.col("fold").alias("_qf"))
    p = folds.select(F.col(key).alias("neighbor_id"), F.col("fold").alias("_pf"))
    return (
        neighbors.join(q, "query_id")
        .join(p, "neighbor_id")
        .agg(
            F.count(F.lit(1)).alias("retrieved"),
            F.count_if((F.col("query_id") == F.col("neighbor_id")) | (F.col("_qf") == F.col("_pf"))).alias("leaks"),
        )
    )


def store_retrievals(existing: DataFrame, new: DataFrame, sequence: str | None = None) -> DataFrame:
    """The retrieval log after this run: one entry per review and prompt version, the new one wins.

    Of several new entries the one with the greatest ``sequence`` (a column of ``new``) is stored.
    """
    order = [*([sequence] if sequence else []), "examples"]
    return upsert_replace(existing, new, ["review_id", "prompt_version"], order)


def inspect_retrievals(retrievals: DataFrame, classifications: DataFrame) -> DataFrame:
    """The examples shown for each stored prediction, one per row."""
    return classifications.select("review_id", "prompt_version", "theme", "sentiment").join(
        retrievals, ["review_id", "prompt_version"]
    ).select(
        "review_id",
        "prompt_version",
        F.col("theme").alias("predicted_theme"),
        F.col("sentiment").alias("predicted_sentiment"),
        F.posexplode("examples").alias("pos", "example"),
    ).select(
        "review_id", "prompt_version", "predicted_theme", "predicted_sentiment",
        (F.col("pos") + 1).alias("example_rank"),
        F.col("example.text").alias("example_text"),
        F.col("example.theme").alias("example_theme"),
        F.col("example.sentiment").alias("example_sentiment"),
        F.col("example.distance").alias("distance"),
    )
