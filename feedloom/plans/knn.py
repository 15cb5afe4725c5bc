"""Exact k-nearest-neighbour join by Voronoi cells.

The pool is cut into cells around a bounded number of pivot vectors. Every query bounds its
k-th distance from a short summary of the cells and visits only cells that can hold a closer
row (triangle inequality and bisector bounds), so the answer is exact without pairing every
query with every row. Cells and queries are cut into blocks of bounded size, which keeps a hot
cell or a hot group spread over many tasks; each task keeps only its k best rows per query.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.ordering import seeded_hash
from feedloom.plans.skew import attach
from feedloom.plans.staging import stage

# Most rows per block, the most pivots held by a task, and into how many cells a pool is cut at most
# while these stay below BLOCK_ROWS. A row moves once per block it meets, so small blocks of a large pool would move
# its square.
BLOCK_ROWS = 20_000
MAX_PIVOTS = 1024
SHARES = 8
_PAIRS_AT_ONCE = 2_000_000
_EXACT_AT_ONCE = 50_000
# Stand-ins for a missing exclusion label; the two sides differ, so such rows exclude no one.
_NO_POOL_LABEL, _NO_QUERY_LABEL = -(1 << 62), -(1 << 62) + 1
_SLACK = 1e-6
_FINITE = np.finfo(float).max


def choose_pivots(pool: DataFrame, count: int, pool_id: str, vector: str) -> np.ndarray:
    """``count`` (at most MAX_PIVOTS) pool vectors in seeded order, as a small matrix."""
    rows = (
        pool.filter(F.col(vector).isNotNull())
        .select(F.col(vector).cast("array<double>").alias("v"), seeded_hash(7, pool_id).alias("h"), pool_id)
        .orderBy("h", pool_id)
        .limit(min(count, MAX_PIVOTS))
        .collect()
    )
    return np.array([r.v for r in rows], dtype=float)


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest of the group's first ``np`` pivots as ``cell`` and its distance ``r``."""

    @F.pandas_udf("cell int, r double")
    def nearest(vectors: pd.Series, usable: pd.Series) -> pd.DataFrame:
        if len(vectors) == 0:
            return pd.DataFrame({"cell": np.zeros(0, "int32"), "r": np.zeros(0)})
        d = _distances(np.stack(vectors.to_numpy()), pivots)
        d[np.arange(len(pivots))[None, :] >= usable.to_numpy()[:, None]] = np.inf
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "r": d[np.arange(len(d)), cell]})

    # Declared non-deterministic so that it is called once, not again inside a pushed filter.
    return df.withColumn("_n", nearest.asNondeterministic()("v", "np")).select("*", "_n.cell", "_n.r").drop("_n")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


class Cells(NamedTuple):
    """How a pool is cut: the pivots, per group how many of them it uses, its largest group, and rows per block."""

    pivots: np.ndarray
    usable: DataFrame
    largest: int
    rows: int


def slim(df: DataFrame, key: str, vector: str, group: str | None, exclude: str | None, floor: str | None) -> DataFrame:
    """(g, id, v, x, f): group, id, vector, exclusion label and distance floor."""
    return df.filter(F.col(vector).isNotNull()).select(
        (F.col(group).cast("string") if group else F.lit("")).alias("g"),
        F.col(key).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        (F.col(exclude).cast("bigint") if exclude else F.lit(None).cast("bigint")).alias("x"),
        (F.col(floor).cast("double") if floor else F.lit(0.0)).alias("f"),
    )


def plan_cells(pool: DataFrame, block_rows: int = BLOCK_ROWS) -> Cells:
    """One pivot per block of the largest group; smaller groups use fewer.

    A block has ``block_rows`` rows, more in a pool of more than SHARES of them, up to BLOCK_ROWS.
    """
    sizes = pool.groupBy("g").agg(F.count(F.lit(1)).alias("_rows"))
    largest, total = (n or 0 for n in sizes.agg(F.max("_rows"), F.sum("_rows")).first())
    rows = max(block_rows, min(BLOCK_ROWS, math.ceil(total / SHARES)))
    count = min(MAX_PIVOTS, max(1, math.ceil(largest / rows)))
    pivots = choose_pivots(pool, count, "id", "v") if count > 1 else np.zeros((1, 0))
    usable = sizes.select("g", F.least(F.lit(count), F.ceil(F.col("_rows") / rows)).cast("int").alias("np"))
    return Cells(pivots, usable, largest, rows)


def assign_cells(df: DataFrame, cells: Cells) -> DataFrame:
    """Add cell, r (distance to its pivot) and np; rows of groups without a pool row drop out."""
    joined = attach(df, cells.usable, ["g"], by=["id"])
    if len(cells.pivots) == 1:
        return joined.withColumn("cell", F.lit(0)).withColumn("r", F.lit(0.0))
    return _assign(joined, cells.pivots)


def knn_join(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    query_id: str = "id",
    pool_id: str = "id",
    vector: str = "embedding",
    group: str | None = None,
    exclude: str | None = None,
    floor: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest pool rows of every query, by Euclidean distance, ties by pool id.

    ``group``: only rows of the same group pair. ``exclude``: a bigint label; rows with the query's
    own label never pair, and rows without a label pair with all. ``floor``: a double; the distance of a pair is at least the floor of
    either side. Returns g, qid, qx, pid, px, distance, rank; queries without any partner have no row.
    """
    p = slim(pool, pool_id, vector, group, exclude, floor)
    q = slim(queries, query_id, vector, group, exclude, floor)
    if exclude:
        p = p.withColumn("x", F.coalesce("x", F.lit(_NO_POOL_LABEL)))
        q = q.withColumn("x", F.coalesce("x", F.lit(_NO_QUERY_LABEL)))
    # Written once: vectors may come from a Python embedder, and both sides are read several times below.
    p = stage(p, "pool")
    if p.limit(block_rows + 1).count() <= block_rows:
        found = _one_block(q, p, k)
    else:
        cells = plan_cells(p, block_rows)
        q = stage(q, "queries")
        found = search_cells(assign_cells(q, cells), assign_cells(p, cells), cells, k, exclude is not None)
    if not exclude:
        return found
    return found.withColumn("qx", F.when(F.col("qx") != _NO_QUERY_LABEL, F.col("qx"))).withColumn(
        "px", F.when(F.col("px") != _NO_POOL_LABEL, F.col("px"))
    )


def _one_block(q: DataFrame, p: DataFrame, k: int) -> DataFrame:
    """A pool counted to be one block goes to every task; queries are searched where they lie."""
    pool = q.sparkSession.sparkContext.broadcast(p.toPandas())
    kernel = _search(k, False)
    schema = "g string, qid bigint, qx bigint, pid bigint, px bigint, distance double, rank int"

    def search(frames):
        groups = dict(iter(pool.value.groupby("g", sort=False)))
        for frame in frames:
            for g, part in frame.assign(bound=np.inf).groupby("g", sort=False):
                if g in groups:
                    found = kernel(part, groups[g])
                    yield found.assign(rank=found.groupby("qid").cumcount() + 1)

    return q.mapInPandas(search, schema)


def search_cells(
    q: DataFrame, p: DataFrame, cells: Cells, k: int, labelled: bool, by_edge: bool = False
) -> DataFrame:
    """The neighbour join over rows already assigned to cells.

    ``by_edge``: ties break by the unordered id pair, and per label only the best pairs of a block
    are looked for (for spanning trees; k must be 1 unless every row has a label of its own). A column ``limit`` of the queries bounds the
    distances looked for; a query without a partner within its limit has no row.
    """
    if "limit" not in q.columns:
        q = q.withColumn("limit", F.lit(float("inf")))
    homes = q.groupBy("g", F.col("cell").alias("home")).agg(
        F.ceil(F.count(F.lit(1)) / cells.rows).cast("int").alias("nq")
    )
    q = (
        attach(q.withColumnRenamed("cell", "home"), homes, ["g", "home"], by=["id"])
        .withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int"))
    )
    # A group of one block is searched whole.
    routed = q.filter("np = 1").select(
        "g", "home", "qb", "id", "v", "x", "f", F.col("limit").alias("bound"),
        F.lit(0).alias("cell"), F.lit(0).alias("pb"),
    )
    blocked = p.filter("np = 1").select("g", "cell", F.lit(0).alias("pb"), "id", "v", "x", "f")
    if cells.largest > cells.rows:
        large_q, large_p = q.filter("np > 1"), p.filter("np > 1")
        summaries = stage(_cell_summaries(large_p, k, labelled, cells.rows), "cells")
        routed = routed.unionByName(_route(large_q, homes, summaries, cells.pivots, k, by_edge))
        blocked = blocked.unionByName(
            attach(large_p, summaries.select("g", "cell", "nb"), ["g", "cell"], by=["id"]).select(
                "g", "cell", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("pb"), "id", "v", "x", "f"
            )
        )
    # Pool rows go only to the query blocks that visit their cell.
    wanted = routed.select("g", "cell", "home", "qb").distinct()
    keys = ["g", "cell", "pb", "home", "qb"]
    found = (
        routed.groupBy(*keys)
        .cogroup(_fresh(blocked.join(wanted, ["g", "cell"])).groupBy(*keys))
        .applyInPandas(
            _search(k, by_edge), "g string, qid bigint, qx bigint, pid bigint, px bigint, distance double"
        )
    )
    lo, hi = F.least("qid", "pid"), F.greatest("qid", "pid")
    order = [F.col("distance"), lo, hi] if by_edge else [F.col("distance"), F.col("pid")]
    # At most k rows per visited block and query.
    best = Window.partitionBy("g", "qid").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _route(q: DataFrame, homes: DataFrame, summaries: DataFrame, pivots: np.ndarray, k: int, by_edge: bool) -> DataFrame:
    """Queries once per pool block that can hold a closer row; one task per query block reads only cell summaries."""
    q_blocks = homes.select("g", "home", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"))
    visits = stage(
        q.select("g", "home", "qb", "id", "v", "x", "f", "limit")
        .groupBy("g", "home", "qb")
        .cogroup(_fresh(q_blocks.join(summaries, "g")).groupBy("g", "home", "qb"))
        .applyInPandas(
            _visit(pivots, k, by_edge),
            "g string, home int, qb int, id bigint, v array<double>, x bigint, f double, bound double, targets array<int>",
        ),
        "visits",
    )
    visited = visits.select("g", "home", "qb", "id", "v", "x", "f", "bound", F.explode("targets").alias("cell"))
    return attach(visited, summaries.select("g", "cell", "nb"), ["g", "cell"], by=["id"]).select(
        "g", "home", "qb", "id", "v", "x", "f", "bound", "cell",
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pb"),
    )


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new references, so both sides of a co-group may share ancestors."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _cell_summaries(p: DataFrame, k: int, labelled: bool, block_rows: int) -> DataFrame:
    """Per cell: blocks, radius range, and a few real rows close to the pivot for the distance bound."""
    stats = p.groupBy("g", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nb"),
        F.min("r").alias("r_min"),
        F.max("r").alias("r_max"),
    )
    near = Window.partitionBy("g", "cell").orderBy(F.greatest("r", "f"), "id")
    samples = (
        p.select("g", "cell", "id", "r", "x", "f")
        .withColumn("_n", F.row_number().over(near))
        .filter(F.col("_n") <= k + 1)
        .select("g", "cell", "id", "r", "x", "f")
    )
    if labelled:
        # The closest row of each of two labels, so that some row always differs from the query's label.
        per_label = p.groupBy("g", "cell", "x").agg(
            F.min(F.struct(F.greatest("r", "f").alias("w"), "id", "r", "f")).alias("_m")
        )
        near_label = Window.partitionBy("g", "cell").orderBy("_m")
        others = (
            per_label.withColumn("_n", F.row_number().over(near_label))
            .filter(F.col("_n") <= 2)
            .select("g", "cell", "_m.id", "_m.r", "x", "_m.f")
        )
        samples = samples.unionByName(others).distinct()
    packed = samples.groupBy("g", "cell").agg(
        F.collect_list("r").alias("s_r"),
        F.collect_list(F.coalesce("x", F.lit(-(1 << 62)))).alias("s_x"),
        F.collect_list("f").alias("s_f"),
    )
    return stats.join(packed, ["g", "cell"])


def _visit(pivots: np.ndarray, k: int, per_label: bool):
    def visit(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or cells.empty:
            return queries.iloc[:0].assign(bound=np.zeros(0), targets=pd.Series([], dtype=object))[
                ["g", "home", "qb", "id", "v", "x", "f", "bound", "targets"]
            ]
        vectors = np.stack(queries["v"].to_numpy())
        floors = queries["f"].to_numpy(float)
        ids = cells["cell"].to_numpy(int)
        to_pivot = _distances(vectors, pivots[ids])
        lengths = cells["s_r"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(cells)), lengths)
        s_r, s_f = np.concatenate(cells["s_r"].to_numpy()), np.concatenate(cells["s_f"].to_numpy())
        labelled = queries["x"].notna().any()
        s_x = np.concatenate(cells["s_x"].to_numpy()) if labelled else None
        bound = np.full(len(queries), np.inf)
        # Some queries at a time, so that memory follows neither the cells nor the block.
        step = max(1, _PAIRS_AT_ONCE // max(1, len(s_r)))
        for lo in range(0, len(queries) if len(s_r) >= k else 0, step):
            some = slice(lo, lo + step)
            upper = np.maximum(np.maximum(to_pivot[some][:, owner] + s_r[None, :], floors[some, None]), s_f[None, :])
            if labelled:
                upper[queries["x"].iloc[some].to_numpy("int64")[:, None] == s_x[None, :]] = np.inf
            bound[some] = np.partition(upper, k - 1, axis=1)[:, k - 1]
        bound = np.minimum(bound, queries["limit"].to_numpy(float))
        if per_label:
            bound = pd.Series(bound).groupby(queries["x"].to_numpy()).transform("min").to_numpy()
        bound = bound + _SLACK * (1.0 + np.where(np.isfinite(bound), bound, 0.0))
        home = int(queries["home"].iloc[0])
        to_home = _distances(vectors, pivots[[home]])
        apart = _distances(pivots[ids], pivots[[home]])[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            bisector = np.where(apart[None, :] > 0, (to_pivot**2 - to_home**2) / (2.0 * apart[None, :]), 0.0)
        lower = np.maximum.reduce(
            [
                cells["r_min"].to_numpy(float)[None, :] - to_pivot,
                to_pivot - cells["r_max"].to_numpy(float)[None, :],
                np.nan_to_num(bisector, nan=0.0),
                np.broadcast_to(floors[:, None], to_pivot.shape),
            ]
        )
        reach = lower <= bound[:, None]
        plain = queries["g"].astype(object)
        return queries.assign(g=plain, bound=bound, targets=[ids[row].astype("int32") for row in reach])[
            ["g", "home", "qb", "id", "v", "x", "f", "bound", "targets"]
        ]

    return visit


def _search(k: int, by_edge: bool):
    nothing = pd.DataFrame(
        {
            "g": pd.Series([], dtype=object),
            **{c: pd.Series([], dtype="int64") for c in ("qid", "qx", "pid", "px")},
            "distance": pd.Series([], dtype="float64"),
        }
    )

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return nothing
        pv, pf, pid, px = np.stack(rows["v"].to_numpy()), rows["f"].to_numpy(float), rows["id"].to_numpy(), rows["x"]
        labelled = px.notna().any()
        px_values = px.to_numpy("int64") if labelled else np.zeros(len(rows), "int64")
        p_norms, floored = (pv * pv).sum(axis=1), pf.any()
        parts = []
        step = max(1, _PAIRS_AT_ONCE // len(rows))
        for start in range(0, len(queries), step):
            part = queries.iloc[start : start + step]
            qv, qf, qid = np.stack(part["v"].to_numpy()), part["f"].to_numpy(float), part["id"].to_numpy()
            # Squared, and in place: this is where nearly all the time goes.
            rough = (-2.0 * qv) @ pv.T
            rough += (qv * qv).sum(axis=1)[:, None]
            rough += p_norms[None, :]
            if floored or qf.any():
                np.maximum(rough, (qf * qf)[:, None], out=rough)
                np.maximum(rough, (pf * pf)[None, :], out=rough)
            qx = part["x"].to_numpy("int64") if labelled else np.full(len(part), -1)
            if labelled:
                rough[qx[:, None] == px_values[None, :]] = np.inf
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] >= k else np.full(len(part), np.inf)
            cut = np.minimum(np.sqrt(np.maximum(kth, 0.0)), part["bound"].to_numpy(float))
            cut = cut + _SLACK * (1.0 + np.where(np.isfinite(cut), cut, 0.0))
            # Of unbounded queries with fewer than k partners all finite ones.
            i, j = np.nonzero(rough <= np.minimum(cut * cut, _FINITE)[:, None])
            if len(i) == 0:
                continue
            # Distances of the few candidates are recomputed directly, free of cancellation.
            exact = np.empty(len(i))
            for lo in range(0, len(i), _EXACT_AT_ONCE):
                some = slice(lo, lo + _EXACT_AT_ONCE)
                exact[some] = np.sqrt(((qv[i[some]] - pv[j[some]]) ** 2).sum(axis=1))
            weight = np.maximum(np.maximum(exact, qf[i]), pf[j])
            a, b = qid[i], pid[j]
            order = (
                np.lexsort((np.maximum(a, b), np.minimum(a, b), weight, i)) if by_edge else np.lexsort((b, weight, i))
            )
            i, j, weight = i[order], j[order], weight[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            # Beyond the bound not every cell was visited, so such a row could be wrong.
            keep = (place < k) & (weight <= part["bound"].to_numpy(float)[i])
            parts.append(
                pd.DataFrame(
                    {
                        "g": np.full(int(keep.sum()), part["g"].iloc[0], dtype=object),
                        "qid": qid[i[keep]],
                        "qx": qx[i[keep]] if labelled else None,
                        "pid": pid[j[keep]],
                        "px": px_values[j[keep]] if labelled else None,
                        "distance": weight[keep],
                    }
                )
            )
        return pd.concat(parts) if parts else nothing

    return search
