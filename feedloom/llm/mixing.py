"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle, gone through up to ``repeats``
times. A document copy finishes at the virtual time (tokens of its queue up to its end) / target;
all copies are ordered by that time and the order is cut where the total budget is spent.

Large queues are cut into hash buckets of bounded size, so cumulative tokens need no task that
holds a whole source, and the global order is only materialised inside the one time bucket that
the cut falls into.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; an empty
table gives an empty result; a source of size 0 has target 0 and its documents are never taken;
rows that repeat a doc_id are separate entries of their queue; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import WORD, id_hash, sized
from feedloom.plans.staging import stage

# The weights dealt to the sources in order, and how often a source may be repeated.
WEIGHTS = (1, 2, 3)
REPEATS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, size) -> one row per source: source, n_rows, source_size, target (double).

    The budget (all sizes) is shared by weight; a target stops at ``repeats`` times its source's
    size and the excess goes to the others by weight. That is one water level: sources whose limit
    per weight lies below it are full. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_code_point) - 1) % len(weights) + 1)
    everything = Window.partitionBy(F.lit(0))
    weighted = per.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * repeats)
    weighted = weighted.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    filling = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    levels = (
        weighted.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_total") - before) / rest)
        .withColumn("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
        .withColumn("_level", F.min_by("_level", F.when(F.col("_level").isNotNull(), F.col("_ratio"))).over(everything))
    )
    target = F.least(F.col("_limit").cast("double"), F.col("_level") * F.col("_weight"))
    return levels.select("source", "n_rows", "source_size", target.alias("target"))


def fair_queue(
    docs: DataFrame, seed: int = 9, weights=WEIGHTS, repeats: int = REPEATS, bucket_rows: int = 50_000
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (int), taken (long) for every row of ``docs``."""
    sizes = stage(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            id_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h"),
        ),
        "mix-sizes",
    )
    targets = stage(source_targets(sizes, weights, repeats), "mix-targets")
    t = sized(targets).alias("t")
    queued = sizes.alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.*", "t.source_size", "t.target", F.ceil(F.col("t.n_rows") / bucket_rows).alias("buckets")
    )
    # The hash is uniform: a bucket of the queue holds about bucket_rows documents at any scale.
    queued = queued.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << 60)) * F.col("buckets")))
    totals = queued.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        totals.select(
            "source",
            "bucket",
            F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        ),
        "mix-offsets",
    )
    o = sized(offsets).alias("o")
    inside = Window.partitionBy("q.source", "q.bucket").orderBy("q.h", "q.doc_id", "q.size")
    here = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = stage(
        queued.alias("q")
        .join(o, F.col("q.source").eqNullSafe(F.col("o.source")) & (F.col("q.bucket") == F.col("o.bucket")))
        .select(
            "q.doc_id",
            "q.source",
            "q.size",
            "q.source_size",
            "q.target",
            (F.sum("q.size").over(here) + F.col("o.tokens_before")).alias("end"),
            (F.row_number().over(inside) + F.col("o.rows_before")).alias("place"),
        ),
        "mix-placed",
    )
    return _cut(placed, repeats)


def _cut(placed: DataFrame, repeats: int) -> DataFrame:
    """Order all copies by virtual finish time and keep those within the total budget."""
    counted = placed.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("budget")).first()
    budget = counted.budget or 0
    slots = 64 + counted.n * repeats // 50_000

    def finish(turn):
        return (F.lit(turn) * F.col("source_size") + F.col("end")) / F.when(F.col("target") > 0, F.col("target"))

    def slot(turn):
        return F.floor(finish(turn) * slots)

    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), finish(t).alias("finish"), slot(t).alias("slot")) for t in range(repeats)]))
    copies = placed.select("*", turns.alias("c")).select("doc_id", "source", "size", "place", "c.*")
    filled = copies.filter("slot is not null").groupBy("slot").agg(F.sum("size").alias("tokens"))
    upto = filled.select("slot", "tokens", F.sum("tokens").over(Window.orderBy("slot")).alias("upto"))
    crossing = upto.filter(F.col("upto") > budget).orderBy("slot").first()
    last = crossing.slot if crossing else (1 << 62)
    spent = crossing.upto - crossing.tokens if crossing else 0
    # The exact order matters only inside the time slot that the cut falls into.
    order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "place", "turn")
    edge = (
        copies.filter(F.col("slot") == last)
        .withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + spent)
        .filter(F.col("_upto") <= budget)
        .groupBy("source", "place")
        .agg(F.count(F.lit(1)).alias("more"))
    )
    e = sized(stage(edge, "mix-edge")).alias("e")
    whole = sum((F.when(slot(t) < last, 1).otherwise(0) for t in range(repeats)), F.lit(0))
    taken = (
        placed.alias("p")
        .join(e, F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("p.place") == F.col("e.place")), "left")
        .select("p.*", (whole + F.coalesce("e.more", F.lit(0))).cast("int").alias("copies"))
    )
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    Rows that repeat one doc_id all follow the largest number of copies among them.
    """
    plan = fair_queue(docs, **options)
    copies = sized(stage(plan.groupBy("doc_id").agg(F.max("copies").alias("copies")), "mix-copies")).alias("c")
    repeated = docs.alias("d").join(copies, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))).filter(F.col("c.copies") > 0)
    # array_repeat with explode, kept out of the select list so that no column of docs can clash.
    return repeated.select(
        F.explode(F.array_repeat(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]), F.col("c.copies"))).alias("row")
    ).select("row.*")
