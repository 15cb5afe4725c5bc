import pytest
from feedloom.catalog.inputs import raw_reviews
from feedloom.operators import classify
from feedloom.operators.cleaning import clean_and_filter
from feedloom.plans.staging import stage
from feedloom.schemas import CLASSIFICATIONS, MODEL_CACHE, PAIN_POINT_MEMBERS, PAIN_POINTS, REVIEWS
from feedloom.sources import flows
from feedloom.sources import store as store_module
from feedloom.sources.store import Store
from feedloom.streaming.ingest import ingest_stream, store_batch
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTES = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("v", T.StringType())])


def notes(spark, rows):
    return spark.createDataFrame(rows, "k string, v string, n int")


def content(store):
    return {r.k: r.v for r in store.read("notes", NOTES).collect()}


def test_first_wins_and_stored_keys_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert content(store) == {}
    assert store.insert("notes", notes(spark, [("a", "1", 1), ("a", "0", 0), (None, "x", 0), ("b", None, 0)]), NOTES, ["k"], ["n"]) == 2
    store.commit()
    later = Store(spark, str(tmp_path))
    assert later.insert("notes", notes(spark, [("a", "2", 0), ("c", "3", 0)]), NOTES, ["k"], ["n"]) == 1
    later.commit()
    assert content(Store(spark, str(tmp_path))) == {"a": "0", "b": None, "c": "3"}
    assert Store(spark, str(tmp_path)).insert("notes", notes(spark, [("a", "9", 0)]), NOTES, ["k"], ["n"]) == 0


def test_replace_writes_only_the_buckets_it_meets(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.insert("notes", notes(spark, [(str(i), "old", 0) for i in range(300)]), NOTES, ["k"], ["n"])
    store.commit()
    before = {b: list(s) for b, s in store.state["tables"]["notes"].items()}
    later = Store(spark, str(tmp_path))
    assert later.replace("notes", notes(spark, [("7", "first", 1), ("7", "last", 2)]), NOTES, ["k"], ["n"]) == 1
    later.commit()
    now = later.state["tables"]["notes"]
    assert sum(before[b] != now[b] for b in before) == 1
    assert content(later) == {str(i): "last" if i == 7 else "old" for i in range(300)}


def scanned(df):
    """Rows that the one scan of a plan handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_files_that_cannot_hold_the_keys_are_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.insert("notes", notes(spark, [(f"key {i}", "v", 0) for i in range(6_000)]), NOTES, ["k"], ["n"])
    store.commit()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def asked(keys):
            batch = stage(store._keyed(notes(spark, [(k, "w", 0) for k in keys]), ["k"]), "asked")
            return scanned(store.stored_keys("notes", batch, NOTES, ["k"], len(keys)))

        # Absent keys: their buckets have files, but no row group is opened. Present ones: one bucket each.
        assert asked([f"other {i}" for i in range(40)]) < 1_000
        assert 0 < asked(["key 5"]) < 400
        assert scanned(store.read("notes", NOTES)) == 6_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_death_before_the_commit_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.insert("notes", notes(spark, [("a", "1", 0)]), NOTES, ["k"], ["n"])
    store.commit()
    dying = Store(spark, str(tmp_path))
    dying.replace("notes", notes(spark, [("a", "2", 0)]), NOTES, ["k"], ["n"])
    dying.insert("more", notes(spark, [("b", "2", 0)]), NOTES, ["k"], ["n"])
    (tmp_path / "manifest" / "_half").write_text("{")
    fresh = Store(spark, str(tmp_path))
    assert content(fresh) == {"a": "1"} and "more" not in fresh.state["tables"]
    fresh.commit()
    with pytest.raises(RuntimeError, match="someone else"):
        dying.commit()


def test_classify_and_store_asks_once(spark, tmp_path):
    asked = []
    texts = ["the app crashes", "love it", "the app crashes", ""]
    reviews = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, cleaned_text string")
    lexicon = classify.lexicon_table(spark)

    def scorer(misses):
        asked.append(misses.count())
        return classify.classify_lexicon(misses, lexicon)

    def failing(misses):
        raise RuntimeError("the scorer is away")

    with pytest.raises(RuntimeError, match="away"):
        flows.classify_and_store(Store(spark, str(tmp_path)), reviews, "v1", failing)
    assert Store(spark, str(tmp_path)).state["version"] == 0
    first = flows.classify_and_store(Store(spark, str(tmp_path)), reviews, "v1", scorer)
    second = flows.classify_and_store(Store(spark, str(tmp_path)), reviews, "v1", scorer)
    assert asked == [3, 0]
    assert (first["misses"], first["cached"], first["stored"], first["invalid"]) == (4, 3, 4, 0)
    assert (second["hits"], second["misses"], second["cached"], second["stored"]) == (4, 0, 0, 4)
    store = Store(spark, str(tmp_path))
    rows = store.read("classifications", CLASSIFICATIONS).collect()
    assert len(rows) == 4 and all(r.created_at for r in rows) and store.state["version"] == 2
    assert all(r.created_at for r in store.read("cache", MODEL_CACHE).collect())


def test_v3_stores_its_retrievals_with_the_results(spark, tmp_path):
    reviews = spark.createDataFrame([(1, "slow and slow")], "id long, cleaned_text string")
    example = "array<struct<text: string, theme: string, sentiment: string, distance: double>>"
    retriever = lambda df: df.select("id", F.from_json(F.lit('[{"text": "slow", "theme": "Other", "sentiment": "negative", "distance": 0.5}]'), example).alias("examples"))
    flows.classify_and_store(Store(spark, str(tmp_path)), reviews, "v3", classify.lexicon_scorer(classify.lexicon_table(spark)), retriever)
    from feedloom.schemas import RETRIEVALS

    row = Store(spark, str(tmp_path)).read("retrievals", RETRIEVALS).first()
    assert row.review_id == 1 and row.examples[0].distance == 0.5


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    rows = [("a", "A", "r1", "the app is fine and it works", "2026-01-01", "scrape", 0), ("a", "A", "r2", "the app is not for me", "2026-01-02", "scrape", 1)]
    batch = spark.createDataFrame(rows, "app_id string, app_name string, review_id string, text string, review_date string, source string, _row int")
    clean = lambda b: clean_and_filter(b, ["_row"])
    assert store_batch(batch, 0, str(tmp_path), "dump", clean) == 2
    assert store_batch(batch, 0, str(tmp_path), "dump", lambda b: 1 / 0) == 0
    assert store_batch(batch, 0, str(tmp_path), "another stream", clean) == 0
    assert Store(spark, str(tmp_path)).read("reviews", REVIEWS).count() == 2


def test_stream_into_store(spark, sf, tmp_path):
    dump, root = str(tmp_path / "dump"), str(tmp_path / "store")
    r = raw_reviews(spark, sf).limit(60)
    columns = [F.col("review_id").alias("reviewId"), F.col("rating").alias("score"), F.col("text").alias("content"), F.lit("2026-01-01").alias("at")]
    r.select(*columns).write.json(dump)
    run = lambda progress: ingest_stream(spark, dump, root, str(tmp_path / progress), "a", "A", into_store=True, max_files=1).awaitTermination()
    run("p")
    n = Store(spark, root).read("reviews", REVIEWS).count()
    run("p")
    run("q")
    stored = Store(spark, root).read("reviews", REVIEWS)
    assert stored.count() == n == 60 and stored.filter("created_at is null").count() == 0
    assert sorted(x.id for x in stored.select("id").collect()) == list(range(1, 61))


def test_slices_are_replaced_and_cleared_with_their_members(spark, tmp_path):
    points = [(a, "v1", t, 0, "t", "s", "n", 1, 1.0, 1, 0, 1, ["q"], [1]) for a, t in (("a", "x"), ("a", "y"), ("b", "z"))]
    frame = spark.createDataFrame(points, PAIN_POINTS)
    members = spark.createDataFrame([("a", "v1", "x", 0, 1), ("a", "v1", "y", 0, 2), ("b", "v1", "z", 0, 3)], PAIN_POINT_MEMBERS)
    flows.store_pain_points(Store(spark, str(tmp_path)), frame, members, frame.select("app_id", "prompt_version"))
    only_a = frame.filter("app_id = 'a'").select("app_id", "prompt_version")
    flows.store_pain_points(Store(spark, str(tmp_path)), frame.filter("theme = 'y'"), members.filter("theme = 'y'"), only_a)
    store = Store(spark, str(tmp_path))
    assert sorted(r.theme for r in store.read("pain_points", PAIN_POINTS).collect()) == ["y", "z"]
    assert sorted(r.review_id for r in store.read("pain_point_members", PAIN_POINT_MEMBERS).collect()) == [2, 3]
    flows.store_pain_points(store, frame.filter("false"), members.filter("false"), frame.select("app_id", "prompt_version"))
    assert flows.load_pain_points(Store(spark, str(tmp_path)), "b", "v1").count() == 0


def test_an_insert_writes_the_payload_once_and_numbers_only_keys(spark, tmp_path, monkeypatch):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("k", "v")] + [T.StructField("id", T.LongType())])
    staged, counting, position = [], store_module.stage_counting, store_module.grouped_position
    monkeypatch.setattr(store_module, "stage_counting", lambda df, name: staged.append(df.columns) or counting(df, name))
    monkeypatch.setattr(store_module, "grouped_position", lambda df, *a, **o: staged.append(df.columns) or position(df, *a, **o))
    rows = spark.createDataFrame([(None if i == 5 else f"{i:02d}", f"v{i}", i) for i in range(20)] * 2, "k string, v string, n int")
    # Also with more rows than are sent out.
    for root, most in ((tmp_path / "a", 1_000_000), (tmp_path / "b", 0)):
        monkeypatch.setattr(store_module, "BROADCAST_ROWS", most)
        store = Store(spark, str(root))
        assert store.insert("notes", rows.filter("n < 10"), schema, ["k"], ["n"]) == 10
        assert store.insert("notes", rows.filter("n > 5"), schema, ["k"], ["n"]) == 10
        found = store.read("notes", schema).orderBy("id").collect()
        assert [r.id for r in found] == list(range(1, 21)) and {r.v for r in found} == {f"v{i}" for i in range(20)}
        assert [r.k for r in found if r.k] == [f"{i:02d}" for i in range(20) if i != 5]
    assert staged and not any("v" in columns for columns in staged)
