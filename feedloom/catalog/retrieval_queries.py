"""Embedding and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog import query
from feedloom.catalog.cleaning_queries import words
from feedloom.catalog.inputs import documents, table
from feedloom.functions.vectors import l2_normalize
from feedloom.operators import retrieval
from feedloom.plans import lsh

DIM = 16
# Small blocks, so that the given tables span several cells.
BLOCK = 60

FOLDED = "folded as (select vec_id as review_id, embedding, cast(vec_id % 5 as bigint) as fold, label from embeddings)"
DIST = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (cast(a.embedding[i] as double) - cast(b.embedding[i] as double)) * (cast(a.embedding[i] as double) - cast(b.embedding[i] as double))))"
PAIRS = f"""with {FOLDED}, pairs as (select a.review_id as query_id, b.review_id as neighbor_id, a.fold as qf, b.fold as pf, a.label as ql, b.label as pl, {DIST} as d
    from folded as a join folded as b on true)"""


def folded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("review_id"), "embedding", (F.col("vec_id") % 5).alias("fold"), "label"
    )


def neighbors(df):
    return df.select("query_id", "neighbor_id", F.round("distance", 6).alias("distance"), "rank")


def top(condition: str, k: int = 3) -> str:
    return (
        PAIRS
        + f""" select query_id, neighbor_id, round(d, 6) as distance, cast(rn as int) as "rank" from (select *, row_number() over
        (partition by query_id order by d, neighbor_id) as rn from pairs where {condition}) as t where rn <= {k}"""
    )


@query(
    "embed_texts",
    f"""with tok as (select doc_id, md5(w) as h from (select doc_id, unnest({words('text')}) as w from documents) as t),
    b as (select doc_id, cast(('0x' || substr(h, 1, 6)) as int) % {DIM} as bucket,
        sum(case when substr(h, 32, 1) between '0' and '7' then 1 else -1 end) as c from tok group by all),
    n as (select doc_id, sqrt(sum(cast(c * c as double))) as norm from b group by doc_id)
    select doc_id, bucket, round(c / norm, 6) as value from b join n using (doc_id) where c <> 0""",
)
def _embed(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    embedded = retrieval.embed_texts(docs, dim=DIM).filter(F.col("embedding").isNotNull())
    return embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).filter(
        F.col("value") != 0
    ).withColumn("value", F.round("value", 6))


@query(
    "embed_tfidf",
    f"""with tok as (select doc_id, md5(w) as h from (select doc_id, unnest({words('text')}) as w from documents) as t),
    pool as (select * from tok where doc_id in (select doc_id from labels)),
    n as (select count(*) as n from documents where doc_id in (select doc_id from labels) and text is not null),
    idf as (select h, ln((1.0 + n) / (1.0 + count(distinct doc_id))) + 1.0 as idf from pool cross join n group by h, n),
    b as (select doc_id, cast(('0x' || substr(h, 1, 6)) as int) % {DIM} as bucket,
        sum(case when substr(h, 32, 1) between '0' and '7' then 1.0 else -1.0 end * coalesce(idf, ln(1.0 + n) + 1.0)) as c
        from tok left join idf using (h) cross join n group by doc_id, bucket),
    s as (select doc_id, sqrt(sum(c * c)) as norm from b group by doc_id)
    select doc_id, bucket, round(c / norm, 6) as value from b join s using (doc_id) where abs(c) > 1e-9""",
)
def _tfidf(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    pool = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    embedded = retrieval.embed_tfidf(docs, retrieval.fit_idf(pool), "doc_id", dim=DIM)
    values = embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "value"))
    return values.filter(F.abs("value") > 1e-9).withColumn("value", F.round("value", 6))


@query(
    "l2_normalize",
    """with v as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
    n as (select vec_id, sqrt(sum(cast(x as double) * cast(x as double))) as norm from v group by vec_id)
    select v.vec_id, cast(i as int) as pos, round(x / norm, 6) as value from v join n using (vec_id)""",
)
def _normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("unit"))
    return e.select("vec_id", F.posexplode("unit").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).alias("pos"), F.round("x", 6).alias("value")
    )


@query("build_index", f"with {FOLDED} select review_id, label from folded where review_id not in (select doc_id from labels)")
def _index(spark, sf_dir):
    held = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"))
    return retrieval.build_index(folded(spark, sf_dir), held).select("review_id", "label")


@query("retrieve_top_k", top("true"))
def _retrieve(spark, sf_dir):
    rows = folded(spark, sf_dir)
    return neighbors(retrieval.retrieve_top_k(rows, rows, block_rows=BLOCK))


@query("kfold_retrieve", top("qf <> pf"))
def _kfold(spark, sf_dir):
    return neighbors(retrieval.kfold_retrieve(folded(spark, sf_dir), block_rows=BLOCK))


@query("holdout_retrieve", top("ql = 1 and pl <> 1"))
def _holdout(spark, sf_dir):
    rows = folded(spark, sf_dir)
    return neighbors(retrieval.holdout_retrieve(rows.filter("label = 1"), rows, block_rows=BLOCK))


@query("leakage_check", f"with {FOLDED} select count(*) * 3 as retrieved, 0 as leaks from folded")
def _leakage(spark, sf_dir):
    rows = folded(spark, sf_dir)
    return retrieval.leakage_check(retrieval.kfold_retrieve(rows, block_rows=BLOCK), rows)


STORED = f"""{FOLDED}, near as (select a.review_id, b.review_id as other, row_number() over (partition by a.review_id order by {DIST}, b.review_id) as rn
    from folded as a join folded as b on a.fold <> b.fold)"""


def described(spark, sf_dir):
    return folded(spark, sf_dir).select(
        "*",
        F.concat_ws(" ", F.lit("text"), F.col("review_id").cast("string")).alias("text"),
        F.concat_ws(" ", F.lit("theme"), (F.col("review_id") % 7).cast("string")).alias("theme"),
        F.lit("neutral").alias("sentiment"),
    )


# Stored: the examples of another run; the new run replaces them per review and version.
@query(
    "store_retrievals",
    f"""with {STORED} select review_id, 'v3' as prompt_version, string_agg(cast(other as varchar), ',' order by rn) as shown
        from near where rn <= 3 group by review_id
    union all select review_id, 'v2', 'old' from folded""",
)
def _store(spark, sf_dir):
    rows = described(spark, sf_dir)
    near = retrieval.kfold_retrieve(rows, block_rows=BLOCK)
    new = retrieval.examples_per_query(near, rows, rows).withColumn("prompt_version", F.lit("v3"))
    old_example = F.array(
        F.struct(F.lit("old").alias("text"), F.lit("t").alias("theme"), F.lit("s").alias("sentiment"), F.lit(0.0).alias("distance"))
    )
    old = rows.select("review_id", F.explode(F.array(F.lit("v2"), F.lit("v3"))).alias("prompt_version"), old_example.alias("examples"))
    stored = retrieval.store_retrievals(old, new.select(*old.columns))
    shown = F.transform("examples", lambda e: F.regexp_replace(e["text"], "text ", ""))
    return stored.select("review_id", "prompt_version", F.array_join(shown, ",").alias("shown"))


@query(
    "inspect_retrievals",
    f"""with {STORED} select review_id, 'v3' as prompt_version, concat('theme ', cast(review_id % 10 as varchar)) as predicted_theme,
        cast(rn as int) as example_rank, concat('text ', cast(other as varchar)) as example_text, concat('theme ', cast(other % 7 as varchar)) as example_theme
        from near where rn <= 3""",
)
def _inspect(spark, sf_dir):
    rows = described(spark, sf_dir)
    near = retrieval.kfold_retrieve(rows, block_rows=BLOCK)
    stored = retrieval.examples_per_query(near, rows, rows).withColumn("prompt_version", F.lit("v3"))
    predicted = rows.select(
        "review_id",
        F.lit("v3").alias("prompt_version"),
        F.concat_ws(" ", F.lit("theme"), (F.col("review_id") % 10).cast("string")).alias("theme"),
        "sentiment",
    )
    return retrieval.inspect_retrievals(stored, predicted).select(
        "review_id", "prompt_version", "predicted_theme", "example_rank", "example_text", "example_theme"
    )
@query("retrieve_approximate", "select count(*) * 3 as exact, true as recalled from embeddings")
def _approximate(spark, sf_dir):
    """Whether the index finds at least nine in ten of the exact neighbours of every vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")
    found = retrieval.retrieve_approximate(vectors, lsh.fit(vectors))
    exact = retrieval.retrieve_top_k(vectors.withColumn("own", F.col("review_id")), vectors.withColumn("own", F.col("review_id")), exclude="own")
    return lsh.recall(found, exact).select("exact", (F.col("recall") >= 0.9).alias("recalled"))


