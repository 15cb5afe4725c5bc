"""Approximate nearest neighbours with a forest of hash prefixes.

Every tree gives a vector a long bit string (signs of random projections about the mean). The rows
are dealt into blocks; in a block each tree is one sorted array of these strings, and all vectors
that share a prefix with a query are one range of it. A query first descends to its longest
matches in all trees and takes the distance of its k-th neighbour found over all blocks. Then all
trees ascend together, level by level, to the prefix length at which a vector at that distance
shares the prefix in some tree with the wanted probability; everything in those ranges is measured
exactly. On vectors with structure few rows are measured; on shapeless ones the forest ascends
until the wanted recall is reached, if need be to the root, where the search is exact.

Every row is indexed. Queries travel to the blocks in batches and a block has a bounded number of
rows, however many of them are equal; each block returns k rows per query.

Edge cases: vectors that are null, zero, hold null or non-finite components or differ from the
commonest length take no part; with fewer than k other rows a query gets them all; ties go to the
smaller id; rows repeating an id are separate candidates except the query's own id; rows without an
id take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.staging import stage

# Trees, bits of a hash string, rows looked at on the way down, and the chance wanted to meet each neighbour.
TREES, BITS, FIRST, CHANCE = 32, 24, 256, 0.97
BLOCK_ROWS = 8_192
_MEASURED_AT_ONCE = 4_000_000


class Block:
    """The forest over one block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, planes: np.ndarray):
        self.ids, self.vectors, self.mean, self.planes = ids, vectors, mean, planes
        codes = self.hash(vectors)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)
        self.norm = np.sqrt(((vectors - mean) ** 2).sum(1).mean())

    def hash(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, trees) hash strings as integers, first bit highest."""
        signs = ((vectors - self.mean) @ self.planes > 0).reshape(len(vectors), TREES, BITS)
        return signs @ (1 << np.arange(BITS)[::-1].astype("int64"))

    def ranges(self, codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees): where the rows that share the first ``level`` bits begin and end in each sorted array."""
        drop = (BITS - level)[:, None]
        low = codes >> drop << drop
        first, last = np.empty_like(low), np.empty_like(low)
        for tree in range(TREES):
            first[:, tree] = np.searchsorted(self.sorted[:, tree], low[:, tree])
            last[:, tree] = np.searchsorted(self.sorted[:, tree], low[:, tree] + (1 << drop[:, 0]))
        return first, last

    def descend(self, codes: np.ndarray) -> np.ndarray:
        """The deepest level at which all trees together hold FIRST rows, per query."""
        level = np.zeros(len(codes), "int64")
        for deeper in range(1, BITS + 1):
            first, last = self.ranges(codes, np.full(len(codes), deeper))
            level[(last - first).sum(1) >= min(FIRST, len(self.ids))] = deeper
        return level

    def ascend(self, queries: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The deepest level at which a row at distance ``reach`` is met with the wanted chance; 0 if nothing is known."""
        own = np.sqrt(((queries - self.mean) ** 2).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = (own**2 + self.norm**2 - reach**2) / (2 * own * self.norm)
            same = 1 - np.arccos(np.clip(np.nan_to_num(cos, nan=-1.0), -1, 1)) / np.pi
        level = np.zeros(len(queries), "int64")
        for deeper in range(1, BITS + 1):
            level[1 - (1 - same**deeper) ** TREES >= CHANCE] = deeper
        return level

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, reach: np.ndarray | None, k: int):
        """(query id, id, distance) of the k nearest rows found in this block, per query."""
        codes = self.hash(queries)
        level = self.descend(codes) if reach is None else self.ascend(queries, reach)
        first, last = self.ranges(codes, level)
        for q in range(len(queries)):
            if level[q] == 0:
                rows = np.arange(len(self.ids))
            else:
                rows = np.unique(np.concatenate([self.order[first[q, t] : last[q, t], t] for t in range(TREES)]))
            rows = rows[self.ids[rows] != query_ids[q]]
            distance = np.sqrt(((self.vectors[rows] - queries[q]) ** 2).sum(1))
            best = np.lexsort((self.ids[rows], distance))[:k]
            yield np.full(len(best), query_ids[q]), self.ids[rows[best]], distance[best]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search(k: int, mean: np.ndarray, planes: np.ndarray):
    """Rows sorted by (block, kind): the rows of a block, then the queries to it."""

    def matrix(column) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype("float64")

    def search(batches):
        current, gathered, block = None, [], None
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            turns = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *turns], [*turns, len(numbers)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                ids, vectors = part.column("id").to_numpy(), matrix(part.column("v"))
                if numbers[lo] != current:
                    current, gathered, block = numbers[lo], [], None
                if kinds[lo] == 0:
                    gathered.append((ids, vectors))
                    continue
                if block is None and gathered:
                    block = Block(np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered]), mean, planes)
                    gathered = []
                if block is not None:
                    reach = part.column("reach").to_numpy(zero_copy_only=False).astype("float64")
                    found = list(block.nearest(ids, vectors, None if kinds[lo] == 1 else reach, k))
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return search


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    points: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding",
    block_rows: int = BLOCK_ROWS, seed: int = 8,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest other rows found for each query."""
    spark = points.sparkSession
    v = F.col(vector).cast("array<double>")
    rows = points.select(F.col(ident).cast("long").alias("id"), v.alias("v"), is_query.alias("asks")).filter(
        F.col("id").isNotNull() & usable(F.col("v"))
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, count = sizes["d"], sizes["count"]
    rows = rows.filter(F.size("v") == width)
    mean = np.array(rows.agg(*[F.avg(F.col("v")[i]) for i in range(width)]).first(), dtype="float64")
    planes = np.random.default_rng(seed).normal(size=(width, TREES * BITS))
    blocks = max(1, -(-count // block_rows))
    dealt = stage(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "forest-rows")
    queries = dealt.filter("asks").select("id", "v").dropDuplicates(["id"])
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def visit(asked: DataFrame, kind: int) -> DataFrame:
        own = dealt.select("block", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("reach"))
        asked = asked.select(everywhere, F.lit(kind).alias("kind"), "id", "v", "reach")
        laid = own.union(asked).repartition("block").sortWithinPartitions("block", "kind", "id")
        return laid.mapInArrow(_search(k, mean, planes), "query_id long, vec_id long, score double")

    first = stage(_top(visit(queries.withColumn("reach", F.lit(None).cast("double")), 1), k), "forest-first")
    reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("reach"))
    asked = queries.join(reach, queries.id == reach.query_id, "left").select("id", "v", "reach")
    return _top(visit(asked, 2), k).select("query_id", "rank", "vec_id", "score")
