"""A prefix trie of conversations and its subtree sums by centroid decomposition.

A node is a distinct sequence of leading turns. Turns are known by a 128-bit digest of role and text,
a sequence by the exclusive or of its turns' digests, each mixed with its place, so prefixes come from
a running aggregate over range partitions and a conversation of any length is spread over many tasks.
A node is named by its smallest member and its depth; every other conversation through it is an
occurrence of it.

Subtree sums (``rollup``) come from a centroid decomposition of the parent edges. The occurrences below a
node are its weight, known from the trie's own grouping. In a component the nodes that carry at least half
of its weight are one path, from the top down to the centroid. What lies below the centroid is totalled
per component and added along that path; then the centroid goes, and the subtrees under its children
and the part above it are components of at most half the weight. Rounds are logarithmic in the number
of turns, whatever the shape: a chain of a third of all turns, or a first turn that a third of all
conversations share. Components of at most ``small`` nodes are split to the end within one task.

Edge cases: null roles and texts count as empty ones; rows without a conv_id are left out; turns that share
a number are ordered by role, then by their digests; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import WORD, sized
from feedloom.plans.ordering import grouped_position, grouped_running
from feedloom.plans.staging import stage, stage_counting

# Conversations that may share a head, and by how many turns at most (exclusive).
FAMILY, HEADS = 20, 4
# Nodes of a component up to which one task decomposes it; conversations listed in one piece of text.
SMALL, LISTED = 20_000, 4_096


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): the turns in order, the text replaced by a digest and its number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")]
    return grouped_position(narrow, ["conv_id"], order, "pos").select("conv_id", "pos", "a", "b", "words")


def with_shared_heads(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with a head of their family's first one -> (rows, conversations).

    Conversation c takes the first h turns of c - c % FAMILY, h being crc32(c) % HEADS, and goes on with its own
    turns after its first h. Rows are (conv_id, depth, a, b, words, length), conversations (conv_id, length).
    """
    placed = stage(placed, "trie-turns")
    own = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    first = own.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    c = F.col("conv_id")
    convs = own.withColumn("head", c - c % FAMILY).withColumn("h", F.crc32(c.cast("string").cast("binary")) % HEADS)
    convs = convs.join(first, "head", "left").withColumn("shared", F.least("h", F.coalesce("n_head", F.lit(0))))
    convs = convs.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stage(convs.select("conv_id", "head", "h", "shared", "length"), "trie-conversations")
    tail = placed.join(sized(convs), "conv_id").filter("pos > h").withColumn("depth", F.expr("pos - h + shared"))
    heads = placed.filter((c % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "head")
    # A head has fewer than HEADS turns and a family at most FAMILY conversations.
    head = heads.join(convs, "head").filter("pos <= shared").withColumnRenamed("pos", "depth")
    columns = ["conv_id", "depth", "a", "b", "words", "length"]
    return tail.select(columns).union(head.select(columns)), convs.select("conv_id", "length")


def whole(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are -> (rows, conversations), as ``with_shared_heads``."""
    placed = stage(placed, "trie-turns")
    convs = stage(placed.groupBy("conv_id").agg(F.max("pos").alias("length")), "trie-conversations")
    rows = placed.join(sized(convs), "conv_id").withColumnRenamed("pos", "depth")
    return rows.select("conv_id", "depth", "a", "b", "words", "length"), convs


def prefix_trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) -> (nodes, occurrences), both written.

    Nodes: conv_id (smallest member), depth, parent (the parent's conv_id), n_convs, n_children, words (of the last
    turn), weight (occurrences in the subtree). Occurrences: conv_id, depth, owner and parent (conv_ids of the
    node there and of the one above), ends (the conversation has no more turns).
    """
    mixed = [F.xxhash64(F.lit(n), "depth", "a", "b").alias(x) for n, x in ((3, "x"), (4, "y"))]
    marked = rows.select("conv_id", "depth", "words", "length", *mixed)
    keyed = grouped_running(marked, ["conv_id"], [F.col("depth")], xors={"k": F.col("x"), "l": F.col("y")})
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "length")
    zero = F.lit(0).cast("long")
    members = stage(
        keyed.select("conv_id", "depth", "words", "length", "k", "l", F.expr("k ^ x").alias("pk"), F.expr("l ^ y").alias("pl")).union(
            top.select("*", zero, zero, F.lit(None).cast("long"), F.lit(None).cast("long"))
        ),
        "trie-members",
    )
    nodes = stage(
        members.groupBy("depth", "k", "l").agg(
            F.min("conv_id").alias("owner"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.expr("length - depth + 1")).alias("weight"),
            F.max("words").alias("words"),
            F.max("pk").alias("pk"),
            F.max("pl").alias("pl"),
        ),
        "trie-groups",
    )
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k").alias("pk"), F.col("l").alias("pl"), F.col("owner").alias("parent"))
    linked = stage(nodes.join(sized(above), ["depth", "pk", "pl"], "left").drop("pk", "pl"), "trie-links")
    names = sized(linked.select("depth", "k", "l", "owner", "parent"))
    occurrences = stage(
        members.join(names, ["depth", "k", "l"]).select("conv_id", "depth", "owner", "parent", F.expr("depth = length").alias("ends")),
        "trie-occurrences",
    )
    children = linked.filter("parent is not null").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth"))
    counted = linked.join(children.agg(F.count(F.lit(1)).alias("n_children")), ["owner", "depth"], "left")
    n_children = F.coalesce("n_children", zero).alias("n_children")
    shape = counted.select(F.col("owner").alias("conv_id"), "depth", "parent", "n_convs", n_children, "words", "weight")
    return stage(shape, "trie-nodes"), occurrences


def rollup(nodes: DataFrame, occurrences: DataFrame, values: dict[str, Column], small: int = SMALL) -> DataFrame:
    """(conv_id, depth, *values): each value summed over the subtree of every node."""
    names = list(values)
    start = nodes.select("conv_id", "depth", "parent", "weight", *[v.cast("long").alias(n) for n, v in values.items()])
    # A trie has one top; an empty one has no nodes to name it on.
    top = nodes.filter("depth = 0").agg(F.min("conv_id")).first()[0]
    zero = F.lit(0).cast("long")
    current = start.select("*", F.lit(top).cast("long").alias("comp"), zero.alias("comp_depth"), *[zero.alias(f"_{n}") for n in names])
    comp, done, rest = ["comp", "comp_depth"], [], []
    while True:
        sizes = current.groupBy(comp).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total"))
        large, open_parts = stage_counting(sizes.filter(F.col("n") > small).drop("n"), "trie-large")
        large = sized(large)
        rest.append(current.join(large, comp, "left_anti"))
        if not open_parts:
            break
        work = current.join(large, comp)
        heaviest = F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("c")
        centroids = stage(work.filter("2 * weight >= total").groupBy(comp).agg(heaviest), "trie-centroids")
        located = work.join(sized(centroids), comp).withColumn("at", F.col("c.depth") + 1)
        under = occurrences.select(
            F.col("conv_id").alias("o_conv"), F.col("depth").alias("o_depth"), F.col("owner").alias("o_owner"), F.col("parent").alias("o_parent")
        )
        deep = (F.col("conv_id") == F.col("o_conv")) & (F.col("at") == F.col("o_depth")) & (F.col("depth") >= F.col("at"))
        split = stage(
            located.join(under, deep, "left").select(
                *current.columns,
                F.col("c.weight").alias("cut"),
                "at",
                F.expr("conv_id = c.conv_id and depth = c.depth").alias("centre"),
                F.expr("2 * weight >= total").alias("on_path"),
                F.coalesce(F.expr("o_parent = c.conv_id"), F.lit(False)).alias("below"),
                "o_owner",
            ),
            "trie-split",
        )
        totals = split.filter("centre or below").groupBy(comp).agg(*[F.sum(n).alias(f"t_{n}") for n in names])
        split = split.join(sized(stage(totals, "trie-totals")), comp)
        done.append(split.filter("centre").select("conv_id", "depth", *[F.expr(f"_{n} + t_{n}").alias(n) for n in names]))
        current = split.filter("not centre").select(
            "conv_id",
            "depth",
            "parent",
            F.expr("if(on_path, weight - cut, weight)").alias("weight"),
            *names,
            F.expr("if(below, o_owner, comp)").alias("comp"),
            F.expr("if(below, at, comp_depth)").alias("comp_depth"),
            *[F.expr(f"if(on_path, _{n} + t_{n}, _{n})").alias(f"_{n}") for n in names],
        )
    parts = reduce(DataFrame.union, rest).repartition(*comp).sortWithinPartitions(*comp, "depth")
    done.append(parts.mapInArrow(_finished(names), "conv_id long, depth long, " + ", ".join(f"{n} long" for n in names)))
    return reduce(DataFrame.union, done)


def decompose(parent: list[int], weight: list[int], sums: list[list[int]], values: list[list[int]]) -> None:
    """Complete ``sums`` in place for one component given top first; ``parent`` holds places, below zero for the top."""
    open_parts = [list(range(len(parent)))]
    while open_parts:
        part = open_parts.pop()
        total = weight[part[0]]
        path = [v for v in part if 2 * weight[v] >= total]
        centre = path.pop()
        top_of, below, above = {}, {}, []
        for v in part:
            if v == centre:
                continue
            top = v if parent[v] == centre else top_of.get(parent[v])
            if top is None:
                above.append(v)
            else:
                top_of[v] = top
                below.setdefault(top, []).append(v)
        for value, known in zip(values, sums, strict=True):
            under = value[centre] + sum(value[v] for v in top_of)
            known[centre] += under
            for v in path:
                known[v] += under
        for v in path:
            weight[v] -= weight[centre]
        open_parts.extend(below.values())
        if above:
            open_parts.append(above)


def _groups(batches, keys):
    """Tables of whole groups out of rows sorted by ``keys``; the last open group is carried on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        columns = [batch.column(k).to_pylist() for k in keys]
        row_keys = list(zip(*columns, strict=True))
        for i, key in enumerate(row_keys):
            before = row_keys[i - 1] if i else (tuple(held[-1].column(k)[-1].as_py() for k in keys) if held else key)
            if key != before:
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, at = [], i
        if batch.num_rows > at:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _finished(names: list[str]):
    """Whole components -> the final sums of their nodes, many components to a batch."""

    def finish(batches):
        out: list[list[int]] = [[] for _ in range(2 + len(names))]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["conv_id", "depth", *names])

        for table in _groups(batches, ("comp", "comp_depth")):
            convs, depths, parents = (table.column(c).to_pylist() for c in ("conv_id", "depth", "parent"))
            place = {node: i for i, node in enumerate(zip(convs, depths, strict=True))}
            parent = [place.get((p, d - 1), -1) for p, d in zip(parents, depths, strict=True)]
            sums = [table.column(f"_{n}").to_pylist() for n in names]
            decompose(parent, table.column("weight").to_pylist(), sums, [table.column(n).to_pylist() for n in names])
            for column, new in zip(out, [convs, depths, *sums], strict=True):
                column.extend(new)
            if len(out[0]) >= SMALL:
                yield flush()
                out = [[] for _ in out]
        yield flush()

    return finish


def _listed(batches):
    """(conv_id, depth, first, ids): the conversations that end at a node, joined by commas in pieces."""
    for batch in batches:
        rows: dict[tuple[int, int, int], list[str]] = {}
        node, first = None, None
        for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
            if (owner, depth) != node or len(rows[node, first]) >= LISTED:
                node, first = (owner, depth), conv
            rows.setdefault((node, first), []).append(str(conv))
        keys = list(rows)
        arrays = [[n[0] for n, _ in keys], [n[1] for n, _ in keys], [f for _, f in keys]]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(a, pa.int64()) for a in arrays), pa.array([",".join(rows[k]) for k in keys], pa.string())],
            ["conv_id", "depth", "first", "ids"],
        )


def _hashed(batches):
    """(conv_id, depth, ends_sha256) of the pieces of each node in turn; only the running hash is held."""
    node, digest, out = None, None, []
    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv, depth) == node:
                digest.update(b",")
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield _hash_batch(out)
        out = []
    if node:
        yield _hash_batch([(*node, digest.hexdigest())])


def _hash_batch(rows):
    columns = [[r[k] for r in rows] for k in range(3)]
    types = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "depth", "ends_sha256"])


def end_digests(occurrences: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the conv_ids that end at a node, ascending, joined by commas.

    The hash of a node has to be taken in order; what reaches its task are pieces of LISTED ids.
    """
    order = ["owner", "depth", "conv_id"]
    ends = occurrences.filter("ends").select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ends.mapInArrow(_listed, "conv_id long, depth long, first long, ids string")
    in_turn = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return in_turn.mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, shared_heads: bool = False, small: int = SMALL) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens are the words that need not be read again when every prefix is kept: in the subtree, each node's
    members but one times the words of its last turn.
    """
    nodes, occurrences = prefix_trie(*(with_shared_heads if shared_heads else whole)(turns(conversations)))
    values = {"n_leaves": F.expr("if(n_children = 0, 1, 0)"), "saved_tokens": F.expr("(n_convs - 1) * words")}
    sums = rollup(nodes, occurrences, values, small)
    out = nodes.join(sums, ["conv_id", "depth"]).join(end_digests(occurrences), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
