"""Readers: mapped CSV, scraped JSON dumps, optional CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.cleaning import content_id, fill_defaults, positional_id, whole_number
from feedloom.plans.staging import stage

# Fields a CSV must map.
REQUIRED_CSV_FIELDS = ("text", "rating")
# Layout of one scraped review.
DUMP_SCHEMA = (
    "reviewId string, userName string, score int, thumbsUpCount int, content string, at string,"
    " reviewCreatedVersion string"
)


# Columns that give the place of a row in its input.
INPUT_ORDER = ("_file", "_start", "_row")


# What a quoted field may hold, what follows its closing quote, and an unquoted field.
_QUOTED, _AFTER, _BARE = r'(?:[^"]++|"")*+', r"[^,]*+", r'(?!")[^,]*+'
# A line that starts between records and ends inside a quoted field; one that starts inside a field and never leaves it.
_OPENS = rf'^(?:(?:"{_QUOTED}"(?!"){_AFTER}|{_BARE}),)*+"{_QUOTED}$'
_STAYS = rf'^{_QUOTED}$'
_CLOSES = rf'^{_QUOTED}"(?!"){_AFTER}(?:,|$)'


def _line_states(batches):
    """The lines of a scan, in its order, with what they are if their split starts outside (0) or inside (1) a quoted field.

    Whether a line starts (_b0, _b1) and ends (_a0, _a1) inside; how many records end (_r0, and what _r1 is more) and how many
    blank records lie (_k0, _k1 likewise) before it in the split.
    """
    split, held = None, None
    for batch in batches:
        files, starts = batch.column("_file").dictionary_encode(), batch.column("_start").to_numpy()
        names, codes = files.dictionary.to_pylist(), files.indices.to_numpy()
        out, inside = (batch.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("_out", "_in"))
        empty = batch.column("_empty").to_numpy(zero_copy_only=False).astype(bool)
        fixed, turns = out == inside, np.cumsum(out > inside)
        made = {c: np.zeros(len(out), "int32") for c in ("_b0", "_b1", "_a0", "_a1", "_r0", "_r1", "_k0", "_k1")}
        new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]))[: len(out)])
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(out)], strict=True):
            if (here := (names[codes[lo]], int(starts[lo]))) != split:
                split, held = here, [(0, 0, 0), (1, 0, 0)]
            # The last line that sets the state whatever it was, and the turns since.
            last = np.maximum.accumulate(np.where(fixed[lo:hi], np.arange(lo, hi), -1))
            turned = turns[lo:hi] - np.where(last >= 0, turns[last], turns[lo] - (out[lo] > inside[lo]))
            for h, (state, ended, blank) in enumerate(held):
                after = np.where(last >= 0, out[last], state) ^ (turned & 1)
                before = np.append(state, after[:-1])
                ends, blanks = 1 - after, (before == 0) & empty[lo:hi]
                made[f"_b{h}"][lo:hi], made[f"_a{h}"][lo:hi] = before, after
                made[f"_r{h}"][lo:hi] = ended + np.cumsum(ends) - ends
                made[f"_k{h}"][lo:hi] = blank + np.cumsum(blanks) - blanks
                held[h] = int(after[-1]), ended + int(ends.sum()), blank + int(blanks.sum())
        for c in ("_r", "_k"):
            made[f"{c}1"] -= made[f"{c}0"]
        kept = [batch.column(c) for c in ("_file", "_start", "_line", "value")]
        yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, made.values())], ["_file", "_start", "_line", "value", *made])


def _split_starts(lines: DataFrame) -> DataFrame:
    """A row per split: whether it starts inside a quoted field, records and blank ones of its file before it, and the place of row 0."""
    empty = F.col("value") == ""
    ended = [F.max(r + 1 - F.col(f"_a{h}")).alias(f"ended{h}") for h, r in enumerate((F.col("_r0"), F.col("_r0") + F.col("_r1")))]
    blank = [
        F.max(k + (empty & (F.col(f"_b{h}") == 0)).cast("int")).alias(f"blank{h}") for h, k in enumerate((F.col("_k0"), F.col("_k0") + F.col("_k1")))
    ]
    # The states after the last line, by the largest number.
    last = F.max(F.shiftleft("_line", 2) + 2 * F.col("_a0") + F.col("_a1")).alias("last")
    no_header = F.max((empty & (F.col("_r0") == 0) & (F.col("_b0") == 0)).cast("int")).alias("no_header")
    found = lines.groupBy("_file", "_start").agg(*ended, *blank, last, no_header).collect()
    rows, place, by_file = [], 0, {}
    for split in sorted(found, key=lambda s: (s._file, s._start)):
        by_file.setdefault(split._file, []).append(split)
    for file, splits in by_file.items():
        state, records, blanks = 0, 0, 0
        # Row 0 is the header, which has no place; nor have blank records.
        first = place - (0 if splits[0].no_header else 1)
        for s in splits:
            rows.append((file, s._start, state, records, blanks, first))
            ended, blank, after = ((s.ended0, s.blank0, s.last >> 1 & 1), (s.ended1, s.blank1, s.last & 1))[state]
            state, records, blanks = after, records + ended, blanks + blank
        place = first + records + state - blanks
    schema = "_file string, _start long, _inside int, _records long, _blanks long, _first long"
    return F.broadcast(lines.sparkSession.createDataFrame(rows, schema))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _row, _place, value): the records of CSV files, read in splits; a quoted field may hold line breaks.

    Whether a line starts inside a quoted field depends on all lines before it. What a line does to that state is one of
    four: keep it, turn it, open, close. So each split is read once and its lines are written with what they are if the split starts
    outside, and if inside; the splits' totals, a row each, then tell in order which it is. A line that starts and ends outside is a
    record; only the lines of the others are moved, to be put together. ``_place`` counts the records of all files that
    are neither a header nor blank.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        F.regexp_replace("value", r"\r$", "").alias("value"),
    )
    from_out = F.col("value").rlike(_OPENS)
    from_in = F.col("value").rlike(_STAYS) | F.regexp_replace("value", _CLOSES, "").rlike(_OPENS)
    marked = lines.select("*", from_out.alias("_out"), from_in.alias("_in"), (F.col("value") == "").alias("_empty"))
    states = ", ".join(f"_{c}{h} int" for c in "bark" for h in (0, 1))
    lines = stage(marked.mapInArrow(_line_states, f"_file string, _start long, _line long, value string, {states}"), "csv-lines", "zstd")
    lines = lines.join(_split_starts(lines), ["_file", "_start"])
    inside = F.col("_inside") == 1
    in_split = lambda c: F.when(inside, F.col(f"{c}0") + F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    row, open_ = F.col("_records") + in_split("_r"), F.when(inside, F.col("_b1") + F.col("_a1")).otherwise(F.col("_b0") + F.col("_a0"))
    place = F.col("_first") + row - F.col("_blanks") - in_split("_k")
    numbered = lines.select("_file", "_start", "_line", "value", row.alias("_row"), place.alias("_place"), open_.alias("_open"))
    whole = numbered.filter("_open = 0").select("_file", "_row", "_place", "value")
    parts = numbered.filter("_open > 0").groupBy("_file", "_row", "_place")
    joined = parts.agg(F.sort_array(F.collect_list(F.struct("_start", "_line", "value"))).alias("_parts"))
    return whole.unionByName(joined.select("_file", "_row", "_place", F.array_join(F.col("_parts.value"), "\n").alias("value")))


def read_mapped_csv(
    spark: SparkSession,
    path: str,
    mapping: dict[str, str],
    app_id: str,
    app_name: str,
    multiline: bool = True,
    id_mode: str = "position",
) -> DataFrame:
    """A CSV with its columns renamed to ours (field -> CSV column), constants and defaults added.

    Rows keep their place in the input (INPUT_ORDER), which first-wins needs. Large files are split, with quoted line
    breaks too (``csv_records``); ``multiline=False`` saves the passes that these cost.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    raw = reader.csv(path)
    columns = {csv: field for field, csv in mapping.items()}
    missing = [f for f in REQUIRED_CSV_FIELDS if f not in [columns.get(c, c) for c in raw.columns]]
    if missing:
        raise ValueError(f"no CSV column is mapped to {', '.join(repr(m) for m in missing)}")
    if multiline:
        names = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns])
        # The first record of every file is its header; blank lines are no records.
        rows = csv_records(spark, path).filter("_row > 0 and value <> ''")
        fields = F.from_csv("value", names.toDDL(), {"escape": '"', "multiLine": "true"})
        raw = rows.select("_file", "_row", "_place", fields.alias("_fields")).select(
            *[F.col("_fields").getField(c).alias(columns.get(c, c)) for c in raw.columns], "_file", F.lit(0).cast("long").alias("_start"), "_row", "_place"
        )
        return map_rows(raw, app_id, app_name, INPUT_ORDER, id_mode, "_place").drop("_place")
    named = raw.select(
        *[F.col(f"`{c}`").alias(columns.get(c, c)) for c in raw.columns],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return map_rows(named, app_id, app_name, INPUT_ORDER, id_mode)


def map_rows(
    named: DataFrame, app_id: str, app_name: str, order: tuple[str, ...], id_mode: str = "position", place: str | None = None
) -> DataFrame:
    """Constants, ids and defaults for rows that already carry our field names; ``place``: the column with the 0-based place, if known."""
    rows = named.withColumn("app_id", F.lit(app_id)).withColumn("app_name", F.lit(app_name))
    had_id = "review_id" in rows.columns
    rows = fill_defaults(rows)
    if not had_id:
        if id_mode != "position":
            rows = content_id(rows)
        else:
            rows = positional_id(rows, order) if place is None else rows.withColumn("review_id", F.col(place).cast("string"))
    return rows.withColumn("rating", whole_number(F.col("rating"))).withColumn("source", F.lit("csv"))


def read_dump(spark: SparkSession, path: str, app_id: str, app_name: str) -> DataFrame:
    """Scraped reviews (JSON lines) in canonical columns."""
    return normalize_dump(spark.read.schema(DUMP_SCHEMA).json(path), app_id, app_name)


def normalize_dump(raw: DataFrame, app_id: str, app_name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Scraped field names to ours, and ``keep`` as it is; absent thumbs become 0 and absent text becomes empty."""
    return raw.select(
        *keep,
        F.lit(app_id).alias("app_id"),
        F.lit(app_name).alias("app_name"),
        F.col("reviewId").alias("review_id"),
        F.col("userName").alias("user_name"),
        F.col("score").cast("int").alias("rating"),
        F.coalesce(F.col("thumbsUpCount").cast("int"), F.lit(0)).alias("thumbs_up"),
        F.coalesce(F.col("content"), F.lit("")).alias("text"),
        F.substring(F.col("at"), 1, 10).alias("review_date"),
        F.col("reviewCreatedVersion").alias("app_version"),
        F.lit("scrape").alias("source"),
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with its declared schema; no file means no rows, not an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)
