import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import upsert
from feedloom.operators.cleaning import clean_and_filter
from feedloom.schemas import CLASSIFICATIONS, LABELS, PAIN_POINTS, REVIEWS
from feedloom.sources import exports, readers, tables
from feedloom.streaming.ingest import ingest_stream

MAPPING = {"text": "Review Text", "rating": "Stars", "review_date": "Day"}


def write_csv(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_csv_needs_mapped_columns(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ["Review Text,Day", "fine,2026-01-01"])
    with pytest.raises(ValueError, match="rating"):
        readers.read_mapped_csv(spark, path, MAPPING, "a", "A")


def test_csv_ingest_end_to_end(spark, tmp_path):
    path = write_csv(
        tmp_path / "a.csv",
        ["Review Text,Stars,Day", '"the app is great, ""really""\nand fast",5,2026-01-01', "the app is bad,1,2026-01-02", "the app is bad,2,2026-01-03"],
    )
    raw = readers.read_mapped_csv(spark, path, MAPPING, "a", "A")
    clean = clean_and_filter(raw, list(readers.INPUT_ORDER))
    store = str(tmp_path / "reviews")
    assert tables.insert_new(spark, store, clean, REVIEWS, ["app_id", "review_id"], list(readers.INPUT_ORDER)) == 2
    assert tables.insert_new(spark, store, clean, REVIEWS, ["app_id", "review_id"], list(readers.INPUT_ORDER)) == 0
    rows = {r.review_id: r for r in tables.read_table(spark, store, REVIEWS).collect()}
    assert rows["0"].cleaned_text == 'the app is great, "really" and fast' and rows["0"].thumbs_up == 0
    assert sorted(r.id for r in rows.values()) == [1, 2]
    assert rows["1"].rating == 1 and rows["1"].source == "csv" and set(rows) == {"0", "1"}


def test_csv_records_across_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(4)
    pieces = ["plain", 'say "hi"', "two\nlines", 'a "b\n""c" d', "comma, here", "", '"', "\n\n", 'x"y']
    rows = [["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))), str(rng.randrange(1, 6)), f"n{i}"] for i in range(400)]
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(2):
        with open(folder / f"{part}.csv", "w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f, lineterminator="\r\n" if part else "\n")
            writer.writerow(["Review Text", "Stars", "note"])
            writer.writerows(rows[part * 200 : part * 200 + 200])
            # A quote inside a bare field opens nothing.
            f.write('5" wide,3,bare\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lines = spark.read.text(str(folder))
        assert lines.rdd.getNumPartitions() > 4
        got = readers.read_mapped_csv(spark, str(folder), {"text": "Review Text", "rating": "Stars"}, "a", "A")
        found = sorted((r.text or "", r.rating, r.note) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == sorted([(t, int(s), n) for t, s, n in rows] + [('5" wide', 3, "bare")] * 2)


def test_insert_skips_rows_without_required_values(spark, tmp_path):
    rows = [("a", "A", "1", "t", "t", "csv", 0), ("a", None, "2", "t", "t", "csv", 1), ("a", "A", "1", "later", "t", "csv", 2)]
    batch = spark.createDataFrame(rows, "app_id string, app_name string, review_id string, text string, cleaned_text string, source string, n int")
    store = str(tmp_path / "r")
    assert tables.insert_new(spark, store, batch, REVIEWS, ["app_id", "review_id"], ["n"]) == 1
    assert tables.read_table(spark, store, REVIEWS).first().text == "t"


def test_dump_normalization_defaults(spark, tmp_path):
    dump = tmp_path / "dump"
    dump.mkdir()
    (dump / "1.json").write_text(json.dumps({"reviewId": "r1", "score": 4, "at": "2026-01-05 10:11:12"}) + "\n")
    row = readers.read_dump(spark, str(dump), "a", "A").first()
    assert (row.thumbs_up, row.text, row.review_date, row.source, row.app_version) == (0, "", "2026-01-05", "scrape", None)


def test_stream_adds_only_new_reviews_and_a_repeat_adds_nothing(spark, tmp_path):
    dump, out, progress = tmp_path / "dump", str(tmp_path / "out"), str(tmp_path / "progress")
    dump.mkdir()
    record = lambda i: json.dumps({"reviewId": f"r{i}", "score": 1, "content": f"the app is {i}", "at": "2026-01-01"})
    (dump / "1.json").write_text("\n".join(record(i) for i in (1, 2, 2)) + "\n")

    def run(progress_dir):
        ingest_stream(spark, str(dump), out, progress_dir, "a", "A", clean=lambda b: clean_and_filter(b, ["_row"])).awaitTermination()
        return sorted(r.review_id for r in spark.read.parquet(out).collect())

    assert run(progress) == ["r1", "r2"]
    (dump / "2.json").write_text("\n".join(record(i) for i in (2, 3)) + "\n")
    assert run(progress) == ["r1", "r2", "r3"]
    # A fresh progress folder replays everything: the key join keeps the table as it is.
    assert run(str(tmp_path / "other")) == ["r1", "r2", "r3"]


def test_upsert_replace_last_wins(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    got = {r.k: r.v for r in upsert.upsert_replace(old, new, ["k"], ["n"]).collect()}
    assert got == {1: "a", 2: "d", 3: "e"}


def pain(spark, rows):
    full = [(a, v, t, 0, "t", "s", "n", 1, 1.0, 1, 0, 1, ["q"], [1]) for a, v, t in rows]
    return spark.createDataFrame(full, PAIN_POINTS)


def test_pain_point_slices_replace_and_clear(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS pain_points_test")
    tables.create_pain_point_table(spark, "pain_points_test", str(tmp_path / "pp"))
    store = lambda df, app: tables.store_pain_points(spark, "pain_points_test", df, app, "v1")
    store(pain(spark, [("a", "v1", "x"), ("a", "v1", "y")]), "a")
    store(pain(spark, [("it's", "v1", "z")]), "it's")
    assert tables.load_pain_points(spark, "pain_points_test", "a", "v1").count() == 2
    store(pain(spark, [("a", "v1", "w")]), "a")
    assert [r.theme for r in tables.load_pain_points(spark, "pain_points_test", "a", "v1").collect()] == ["w"]
    store(pain(spark, [("a", "v1", "w")]).filter(F.lit(False)), "a")
    assert tables.load_pain_points(spark, "pain_points_test", "a", "v1").count() == 0
    assert tables.load_pain_points(spark, "pain_points_test", "it's", "v1").count() == 1
    plan = tables.load_pain_points(spark, "pain_points_test", "it's", "v1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(app_id" in plan
    spark.sql("DROP TABLE pain_points_test")


def test_read_or_empty(spark, tmp_path):
    empty = readers.read_or_empty(spark, str(tmp_path / "none.csv"), LABELS)
    assert empty.count() == 0 and empty.columns == LABELS.names


def test_old_records_read_without_reasoning(spark):
    old = spark.createDataFrame([(1, "v1", "UI/UX")], "review_id bigint, prompt_version string, theme string")
    row = upsert.evolve(old, CLASSIFICATIONS).first()
    assert row.reasoning is None and row.theme == "UI/UX"


def test_exports(spark, tmp_path):
    ranked = spark.createDataFrame(
        [("a", 1, "UI/UX", "Hard | to read", 71.25, 4, ["q1"]), ("a", 2, "Other", "Slow", 10.0, 1, ["q2"])],
        "app_id string, backlog_rank int, theme string, title string, priority_score double, review_count int, quotes array<string>",
    )
    exports.write_backlog_markdown(ranked, str(tmp_path / "md"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines[:2] == exports.MARKDOWN_HEADER and lines[2] == "| 1 | UI/UX | Hard   to read | 71.3 | 4 |"
    exports.write_backlog_csv(ranked, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("backlog_rank").first()
    assert back.quotes == '["q1"]'


def test_snapshot_subset(spark):
    reviews = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, app_id string")
    cls = spark.createDataFrame([(1, "v1"), (1, "v2"), (3, "v1")], "review_id bigint, prompt_version string")
    pp = spark.createDataFrame([("a", 1), ("c", 2)], "app_id string, n int")
    parts = upsert.snapshot_subset(reviews, cls, pp, reviews.filter("id < 3"))
    assert {k: v.count() for k, v in parts.items()} == {"reviews": 2, "classifications": 2, "pain_points": 1}


@pytest.mark.parametrize("split", ["40", "900", "1000000"])
def test_csv_lines_are_written_once_and_numbered_where_they_lie(spark, tmp_path, monkeypatch, split):
    import random

    from feedloom.plans import ordering

    rng = random.Random(int(split))
    folder, want = tmp_path / "placed", []
    folder.mkdir()
    for part in range(4):
        records = ["" if rng.random() < 0.2 else f'"{rng.choice(["a", "", "a" + chr(10) * 3 + "b", "c" + chr(34) * 2 + chr(10)])}",{rng.randrange(1, 6)},{part}-{n}' for n in range(60)]
        # A blank first line, no record but the header, and a field that is never closed.
        lines = [[""], [], [], []][part] + ["text,rating,note"] + ([] if part == 1 else records) + (['"open', ""] if part == 3 else [])
        with open(folder / f"{part}.csv", "w", newline="", encoding="utf-8") as f:
            f.write(("\r\n" if part == 2 else "\n").join(lines) + "\n")
        want += [r.rsplit(",", 1)[1] for r in (["x,text,note"] if part == 0 else []) + (records if part != 1 else []) if r] + ([None] if part == 3 else [])
    written, stage = [], readers.stage

    def noting(df, name, codec=None):
        written.append(df.columns)
        return stage(df, name, codec)

    monkeypatch.setattr(readers, "stage", noting)
    monkeypatch.setattr(ordering, "stage", noting)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = readers.read_mapped_csv(spark, str(folder), {"text": "text", "rating": "rating"}, "a", "A")
        found = sorted((int(r.review_id), r.note) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == list(enumerate(want))
    assert sum("value" in c or "text" in c for c in written) == 1 and set(got.columns) >= {"_file", "_start", "_row"} and "_place" not in got.columns
