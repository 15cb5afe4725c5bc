import pytest
from pyspark.sql import functions as F

from feedloom.functions.text import clean_text, clean_whitespace
from feedloom.operators import cleaning, language
from feedloom.plans import layout


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("\tlate   again\r\n\nrefund ", "late again refund"),
        ("no 😡 sync", "no :enraged_face: sync"),
        ("😀🦖😀", ":grinning_face: :t-rex: :grinning_face:"),
        ("so good👍🏽!", "so good :thumbs_up_medium_skin_tone: !"),
        ("love it ❤️", "love it :red_heart:"),
        ("👩‍💻 works", ":woman_technologist: works"),
        ("plain text: no change", "plain text: no change"),
        ("🦖", ":t-rex:"),
    ],
)
def test_clean_text(spark, text, expected):
    assert one(spark, clean_text, text) == expected


def test_whitespace_matches_python_split(spark):
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p <= 0xDFFF]
    rows = [(p, f"a{chr(p)}b") for p in points]
    got = spark.createDataFrame(rows, "p int, text string").select("p", clean_whitespace(F.col("text")).alias("c")).collect()
    wrong = [r.p for r in got if r.c != " ".join(f"a{chr(r.p)}b".split())]
    assert wrong == []


def test_clean_and_filter(spark):
    raw = spark.createDataFrame(
        [
            (0, "shop", "ich kann die Karte nicht mehr auf und zu machen", "2025-03-02"),
            (1, "shop", "the map is the best and it was free for me", "02.03.2025"),
            (2, "shop", "we can  not find the button to stop it", "2025-03-04"),
            (3, "shop", " \n ", "2025-03-05"),
            (4, "shop", "we can not find the button to stop it ", "2025-03-01"),
            (5, "bank", "we can not find the button to stop it", "2025-03-06"),
            (6, "bank", None, "2025-03-07"),
        ],
        "n int, app_id string, text string, review_date string",
    )
    rows = cleaning.clean_and_filter(raw, ["n"]).collect()
    assert sorted((r.n, r.app_id, r.language, str(r.review_date)) for r in rows) == [
        (2, "shop", "en", "2025-03-04"), (5, "bank", "en", "2025-03-06"),
    ]


def test_first_repeat_wins_even_with_a_bad_date(spark):
    raw = spark.createDataFrame(
        [("a", "the app is great", "bad", 1), ("a", "the  app is great", "2026-01-01", 2), ("b", "the app is great", "2026-01-01", 3)],
        "app_id string, text string, review_date string, n int",
    )
    assert [r.n for r in cleaning.clean_and_filter(raw, ["n"]).collect()] == [3]


@pytest.mark.parametrize(
    "text,expected", [("it was not there when we came for it and the door is shut", "en"), ("ok", None), ("", None), ("12 34 56", None), ("die App ist sehr gut", "de")]
)
def test_language(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id int, cleaned_text string")
    assert language.detect_language(df, language.seed_profile(spark)).first().language == expected


def test_learned_profile_and_whole_texts(spark):
    train = spark.createDataFrame([("uno dos tres", "es"), ("one two three", "en"), ("nobody knows", None)], "text string, lang string")
    profile = language.learn_profile(train)
    late = "zzz " * 5000 + "dos tres"
    df = spark.createDataFrame([(1, late), (2, "twofold threesome"), (3, "knows"), (1, late)], "id int, cleaned_text string")
    got = {r.id: r.language for r in language.detect_language(df, profile).collect()}
    assert got == {1: "es", 2: "en", 3: None}


def test_language_has_no_bound_on_words_or_languages(spark, monkeypatch):
    # 70,000 words of one language and 300 languages of a few words each; letters only, so that no two words share an edge by rule.
    spell = lambda n, k: "".join(chr(97 + n // 26**i % 26) for i in range(k))
    rows = [(" ".join(spell(n, 5) for n in range(k, 70_000, 70)), "big") for k in range(70)]
    rows += [(f"{spell(n, 3)}qqq{spell(n, 3)} x{n}", f"l{n}") for n in range(300)]
    profile = language.learn_profile(spark.createDataFrame(rows, "text string, lang string"))
    ask = [(1, spell(69_999, 5) + " " + spell(123, 5)), (2, "x7 x7"), (3, "x299 unknown"), (4, "9999")]
    df = spark.createDataFrame(ask, "id int, cleaned_text string")
    expected = {1: "big", 2: "l7", 3: "l299", 4: None}
    assert {r.id: r.language for r in language.detect_language(df, profile).collect()} == expected
    monkeypatch.setattr(language, "small_side", lambda profile: None)
    assert {r.id: r.language for r in language.detect_language(df, profile).collect()} == expected


def test_only_rare_features_meet_a_large_profile_by_shuffle(spark, monkeypatch):
    rows = [(i, "the and was " * 20 + f"rare{i}q", "en") if i % 2 else (i, "der die das and " * 20 + f"selten{i}", "de") for i in range(60)]
    rows += [(60, "the the unknown9", None), (60, "die", None), (None, "was rare1q", None)]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    profile = language.learn_profile(df)
    scores = lambda: {(r.id, r.lang): (round(r.score, 6), r.known) for r in language.language_scores(df, profile, ["id"], "text").collect()}
    want, staged, stage = scores(), {}, language.stage
    monkeypatch.setattr(language, "small_side", lambda profile: None)
    monkeypatch.setattr(language, "common_part", lambda *args: layout.common_part(*args, rows=40))
    monkeypatch.setattr(language, "stage", lambda part, name: staged.setdefault(name, stage(part, name)))
    assert scores() == want and len(want) > 100
    # Of each text the rare word and at most its two edges, not its 180 to 240 other features.
    assert staged["language-common"].count() <= 40
    assert staged["language-scores"].filter("left_over is not null").count() <= 3 * 63


def test_no_text_is_shuffled_to_meet_its_language(spark, monkeypatch):
    rows = [(1, "a", "the map is the best of all", "2025-01-01"), (2, "a", "die Karte ist nicht gut", "2025-01-01"), (3, "a", "the end", "soon"),
            (4, "b", "the map is the best of all", "2025-01-03"), (5, "a", "the map  is the best of all", "2025-01-04"), (6, None, "it was the end", "2025-01-05")]
    raw = spark.createDataFrame(rows, "n int, app_id string, text string, review_date string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = cleaning.clean_and_filter(raw, ["n"])
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.n for r in kept.collect())
        # The same rows beyond what is sent out.
        monkeypatch.setattr(language, "FOUND_ROWS", 0)
        far = sorted(r.n for r in cleaning.clean_and_filter(raw, ["n"]).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    assert got == far == [1, 4, 6]


def test_positional_ids_follow_input_order(spark):
    df = spark.createDataFrame([(n,) for n in (30, 10, 20)], "n int")
    got = {r.n: r.review_id for r in cleaning.positional_id(df, ["n"]).collect()}
    assert got == {10: "0", 20: "1", 30: "2"}


def test_content_ids_do_not_depend_on_position(spark):
    rows = [("a", "x", "2026-01-01"), ("a", "y", "2026-01-01")]
    schema = "app_id string, text string, review_date string"
    first = {r.text: r.review_id for r in cleaning.content_id(spark.createDataFrame(rows, schema)).collect()}
    second = {r.text: r.review_id for r in cleaning.content_id(spark.createDataFrame(rows[::-1], schema)).collect()}
    assert first == second and len(set(first.values())) == 2


def test_drop_reasons_adds_up(spark):
    rows = [(1, "a", "the map is the best of all", "2025-01-01"), (2, "a", "die Karte ist nicht gut", "2025-01-01"), (3, "b", "", "2025-01-02"),
            (4, "b", "the end of it was not good", "soon"), (5, "b", "the end of it was not good", "2025-01-05")]
    raw = spark.createDataFrame(rows, "n int, app_id string, text string, review_date string")
    tally = {r.step: r.rows for r in cleaning.drop_reasons(raw, ["n"], language.seed_profile(spark)).collect()}
    assert sum(n for step, n in tally.items() if step != "input") in (tally["input"], tally["input"] - 1) and tally["input"] == 5
    assert (tally["empty"], tally["language"], tally["date"], tally["kept"]) == (1, 1, 1, 1)
