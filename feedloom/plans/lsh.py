"""A fitted index for approximate nearest neighbours: sign codes of random projections, several tables of them.

The index is a table to be stored with the pool: a row per vector and hash table with its code. A query looks under its
own code and under those that differ in the bits it is least sure of. How many bits a code has follows the
number of rows, so a bucket holds about ``bucket_rows``; fuller ones are cut into blocks, each searched by itself.
So are the queries that look under one code. What is found are true distances; what may be missing is said by ``recall``
against the exact search.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.knn import _fresh, _search, slim
from feedloom.plans.layout import small_side
from feedloom.plans.staging import stage

# Hash tables, rows of a bucket aimed at, rows of a block, and codes a query looks under in each table.
TABLES, BUCKET_ROWS, BLOCK_ROWS, PROBES = 12, 400, 20_000, 6
# Rows that coding brings forth at once: each holds a vector.
_CODED_AT_ONCE = 20_000


class Index(NamedTuple):
    """The stored rows (g, id, v, x, f, t, code), and what codes are made with: the mean and the planes of every table."""

    rows: DataFrame
    mean: np.ndarray
    planes: np.ndarray


def fit(pool: DataFrame, key: str = "review_id", vector: str = "embedding", exclude: str | None = None, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, seed: int = 11) -> Index:
    """Fit the codes to a pool and write its index. The planes go through the mean of all vectors."""
    p = stage(slim(pool, key, vector, None, exclude, None), "index-pool")
    n = p.count()
    first = p.select(F.size("v")).first()
    dim = first[0] if first else 0
    mean = p.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(dim)]).first() if n else ()
    bits = max(1, math.ceil(math.log2(max(2, n) / bucket_rows)))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))
    index = Index(p, np.array([x or 0.0 for x in mean], float), planes)
    return Index(stage(_coded(p, index, 1), "index"), index.mean, planes)


def _codes(vectors: np.ndarray, index: Index, probes: int) -> np.ndarray:
    """(vectors, tables, probes): a row's own code in every table, then those with its least sure bits turned."""
    planes = index.planes
    side = np.einsum("nd,tbd->ntb", vectors - index.mean, planes)
    own = ((side > 0) << np.arange(planes.shape[1])).sum(axis=2)
    turned = np.argsort(np.abs(side), axis=2)[:, :, : probes - 1]
    return np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << turned)], axis=2)


def _coded(df: DataFrame, index: Index, probes: int, packed: bool = False) -> DataFrame:
    """A row per table and code looked under: the row's own, and those with its least sure bits turned.

    ``packed`` vectors are bytes, of single precision where that holds them exactly.
    """
    index, tables = Index(None, index.mean, index.planes), len(index.planes)
    step = max(1, _CODED_AT_ONCE // (tables * probes))

    def code(frames):
        for frame in frames:
            for start in range(0, len(frame), step):
                part = frame.iloc[start : start + step]
                codes = _codes(np.stack(part["v"].to_numpy()), index, probes)
                if packed:
                    part = part.assign(v=part["v"].map(_pack))
                out = part.loc[part.index.repeat(tables * codes.shape[2])].reset_index(drop=True)
                out["t"] = np.tile(np.repeat(np.arange(tables), codes.shape[2]), len(part)).astype("int32")
                out["code"] = codes.reshape(-1).astype("int64")
                yield out

    return df.mapInPandas(code, f"g string, id bigint, v {'binary' if packed else 'array<double>'}, x bigint, f double, t int, code bigint")


def _pack(vector: np.ndarray) -> bytes:
    single = vector.astype("float32")
    return (single if (single == vector).all() else vector).tobytes()


def _unpack(packed: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(packed, "float32" if len(packed) == 4 * dim else "float64").astype("float64")


def _asked_codes(df: DataFrame, index: Index, probes: int) -> DataFrame:
    """(t, code, asked): how many rows look under a code."""
    index, (tables, _, dim) = Index(None, index.mean, index.planes), index.planes.shape

    def count(frames):
        for frame in frames:
            # An index without rows has no planes.
            if frame.empty or not dim:
                continue
            codes = _codes(np.stack(frame["v"].to_numpy()), index, probes)
            for t in range(tables):
                code, asked = np.unique(codes[:, t], return_counts=True)
                yield pd.DataFrame({"t": np.full(len(code), t, "int32"), "code": code, "asked": asked})

    return df.mapInPandas(count, "t int, code bigint, asked bigint").groupBy("t", "code").agg(F.sum("asked").alias("asked"))


def search(queries: DataFrame, index: Index, k: int, key: str = "review_id", vector: str = "embedding", exclude: str | None = None, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Up to k near rows of the index per query, by true Euclidean distance: query_id, neighbor_id, distance (squared), rank."""
    # Written once: vectors may come from a Python embedder, and they are coded twice.
    slim_queries = stage(slim(queries, key, vector, None, exclude, None), "index-queries")
    sizes = index.rows.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nb"))
    blocks = F.ceil(F.col("asked") / block_rows).cast("int").alias("nq")
    sizes = stage(sizes.join(_asked_codes(slim_queries, index, probes), ["t", "code"]).select("t", "code", "nb", blocks), "index-buckets")
    side = small_side(sizes)
    sizes = sizes if side is None else side
    # A task holds a block of a bucket's rows and a block of the queries that look there.
    pool = index.rows.join(sizes, ["t", "code"]).withColumn("pb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    pool = pool.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    asked = _coded(slim_queries, index, probes, packed=True).join(sizes, ["t", "code"])
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    if not exclude:
        # A row never finds itself.
        pool, asked = pool.withColumn("x", F.col("id")), asked.withColumn("x", F.col("id"))
    keys = ["t", "code", "pb", "qb"]
    asked = asked.withColumn("bound", F.lit(float("inf"))).select(*keys, "g", "id", "v", "x", "f", "bound")
    kernel, dim = _search(k, False), index.planes.shape[2]

    def find(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(ask.assign(v=[_unpack(v, dim) for v in ask["v"]]), rows)

    found = asked.groupBy(*keys).cogroup(_fresh(pool.select(*keys, "g", "id", "v", "x", "f")).groupBy(*keys)).applyInPandas(
        find, "g string, qid bigint, qx bigint, pid bigint, px bigint, distance double"
    )
    best = Window.partitionBy("qid").orderBy("distance", "pid")
    once = found.groupBy("qid", "pid").agg(F.min("distance").alias("distance"))
    ranked = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), F.col("pid").alias("neighbor_id"), (F.col("distance") * F.col("distance")).alias("distance"), "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours that the exact search has, how many of them were found, and their share."""
    hit = exact.select("query_id", "neighbor_id").join(found.select("query_id", "neighbor_id", F.lit(1).alias("hit")), ["query_id", "neighbor_id"], "left")
    counts = hit.agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"))
    return counts.select("exact", "found", F.try_divide("found", "exact").alias("recall"))
