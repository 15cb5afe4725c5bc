"""Classification queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.catalog import query
from feedloom.catalog.cleaning_queries import words
from feedloom.catalog.inputs import documents, raw_reviews, table, with_tables
from feedloom.functions.text import cache_key, tokens
from feedloom.operators import classify, prompts
from feedloom.operators.cleaning import add_cleaned_text
from feedloom.operators.upsert import upsert_replace
from feedloom.plans.staging import stage
from feedloom.schemas import SENTIMENTS, THEME_NAMES

CLEANED = with_tables("raw_reviews", "cleaned")
THEME_LIST = "[" + ", ".join(f"'{t}'" for t in THEME_NAMES) + "]"


def cleaned(spark, sf_dir):
    return raw_reviews(spark, sf_dir).transform(add_cleaned_text)


@query("cache_key", CLEANED + " select id, sha256(concat('v1', ':', cleaned_text)) as cache_key from cleaned")
def _key(spark, sf_dir):
    return cleaned(spark, sf_dir).select("id", cache_key(F.lit("v1"), F.col("cleaned_text")).alias("cache_key"))


# The cache holds the answers for every text of the labelled documents.
KEYED = CLEANED + """, keyed as (select id, cleaned_text, sha256(concat('v1', ':', cleaned_text)) as cache_key from cleaned),
cached as (select cache_key, min(id) as first_id from keyed where id in (select doc_id from labels) group by cache_key)"""


def keyed(spark, sf_dir):
    return classify.with_cache_key(cleaned(spark, sf_dir), "v1")


def labelled_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))


def stored_cache(spark, sf_dir):
    known = keyed(spark, sf_dir).join(labelled_ids(spark, sf_dir), "id", "left_semi")
    return known.groupBy("cache_key").agg(F.min("id").alias("first_id")).select(
        "cache_key",
        F.struct(
            F.lit("Other").alias("theme"),
            F.lit("neutral").alias("sentiment"),
            F.lit(1).alias("severity"),
            F.concat_ws(" ", F.lit("from"), F.col("first_id").cast("string")).alias("reasoning"),
        ).alias("response"),
    )


@query(
    "cache_split",
    KEYED + """ select id, c.cache_key is not null as hit, case when c.cache_key is not null then concat('from ', cast(first_id as varchar)) end as reasoning
    from keyed as k left join cached as c on k.cache_key = c.cache_key""",
)
def _split(spark, sf_dir):
    split = classify.cache_split(keyed(spark, sf_dir), stored_cache(spark, sf_dir))
    return split.select("id", "hit", F.col("response.reasoning").alias("reasoning"))


@query(
    "progress_metrics",
    KEYED + """ select count(*) as total, count(c.cache_key) as hits, count(*) - count(c.cache_key) as misses
    from keyed as k left join cached as c on k.cache_key = c.cache_key""",
)
def _progress(spark, sf_dir):
    return classify.progress_metrics(classify.cache_split(keyed(spark, sf_dir), stored_cache(spark, sf_dir)))


BATCHES = KEYED + """, misses as (select cache_key, min(id) as first_id, min(cleaned_text) as text from keyed
    where cache_key not in (select cache_key from cached) group by cache_key),
numbered as (select *, (row_number() over (order by first_id) - 1) // 20 as batch_id, cast((row_number() over (order by first_id) - 1) % 20 as int) as review_index from misses)"""


def misses(spark, sf_dir):
    return classify.distinct_misses(classify.cache_split(keyed(spark, sf_dir), stored_cache(spark, sf_dir)))


@query("score_batches", BATCHES + " select batch_id, review_index, first_id, cache_key from numbered")
def _batches(spark, sf_dir):
    return classify.number_batches(misses(spark, sf_dir)).select("batch_id", "review_index", "first_id", "cache_key")


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt(version: str) -> None:
    line = "concat('[', cast(review_index as varchar), '] ', text)"
    if version == "v3":
        line = (
            "concat('[', cast(review_index as varchar), '] ', text, case when review_index % 2 = 0 then concat("
            "chr(10), '    Pricing / negative <= ', 'sample ', cast(first_id as varchar)) else '' end)"
        )

    @query(
        f"render_prompt_{version}",
        BATCHES + f" select batch_id, concat({sql_text(prompts._intro(version))}, string_agg({line}, chr(10) order by review_index), chr(10)) as prompt"
        " from numbered group by batch_id",
    )
    def run(spark, sf_dir):
        rows = misses(spark, sf_dir)
        if version == "v3":
            place = F.row_number().over(Window.partitionBy("batch_id").orderBy("review_index")) - 1
            rows = classify.number_batches(rows).withColumn("_even", place % 2 == 0)
            example = F.struct(
                F.concat_ws(" ", F.lit("sample"), F.col("first_id").cast("string")).alias("text"),
                F.lit("Pricing").alias("theme"),
                F.lit("negative").alias("sentiment"),
            )
            rows = rows.withColumn("examples", F.when(F.col("_even"), F.array(example))).drop("_even", "batch_id", "review_index")
        return classify.render_prompts(classify.score_batches(rows), version).select("batch_id", "prompt")


for _version in ("v1", "v2", "v3"):
    _prompt(_version)


# A lexicon of all words of the given texts, themes and weights dealt by hash.
LEXICON = f"""top as (select w as term, cast('0x' || substr(md5(w), 1, 8) as bigint) as r from (select distinct unnest({words('text')}) as w from documents) as t),
lexicon as (select term, {THEME_LIST}[1 + r % 10] as theme, 1 + r % 3 as weight, r % 3 - 1 as polarity, r % 2 as severity from top)"""

SCORED = CLEANED + ", " + LEXICON + f""", tok as (select id, unnest({words('cleaned_text')}) as term from cleaned),
hits as (select id, theme, weight, polarity, severity from tok join lexicon using (term)),
by_theme as (select id, theme, sum(weight) as s from hits group by id, theme),
best as (select id, theme from by_theme qualify row_number() over (partition by id order by s desc, list_position({THEME_LIST}, theme)) = 1),
tot as (select id, sum(polarity) as p, sum(severity) as sev, count(*) as found from hits group by id),
scored as (select c.id, coalesce(b.theme, 'Other') as theme,
    case when coalesce(p, 0) > 0 then 'positive' when coalesce(p, 0) < 0 then 'negative' else 'neutral' end as sentiment,
    cast(greatest(1, least(5, 1 + coalesce(sev, 0))) as int) as severity, concat(cast(coalesce(found, 0) as varchar), ' known terms in the text') as reasoning
    from cleaned as c left join best as b on c.id = b.id left join tot as t on c.id = t.id)"""


def lexicon(spark, sf_dir):
    terms = documents(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    dealt = terms.withColumn("r", F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"))
    # Written once: a query reads them more than once.
    rows = dealt.select(
        "term",
        F.element_at(F.array(*[F.lit(t) for t in THEME_NAMES]), (F.col("r") % 10 + 1).cast("int")).alias("theme"),
        (F.col("r") % 3 + 1).alias("weight"),
        (F.col("r") % 3 - 1).alias("polarity"),
        (F.col("r") % 2).alias("severity"),
    )
    return stage(rows, "lexicon")


@query("classify_lexicon", SCORED + " select id, theme, sentiment, severity, reasoning from scored")
def _lexicon(spark, sf_dir):
    texts = cleaned(spark, sf_dir).select("id", "cleaned_text")
    return classify.classify_lexicon(texts, lexicon(spark, sf_dir), key="id", text="cleaned_text")


@query(
    "classify_reviews",
    SCORED
    + """, keyed as (select id, sha256(concat('v1', ':', cleaned_text)) as cache_key from cleaned),
    cached as (select cache_key, min(id) as first_id from keyed where id in (select doc_id from labels) group by cache_key)
    select k.id as review_id, case when c.cache_key is not null then 'Other' else theme end as theme,
        case when c.cache_key is not null then 'neutral' else sentiment end as sentiment,
        case when c.cache_key is not null then 1 else severity end as severity,
        case when c.cache_key is not null then concat('from ', cast(first_id as varchar)) else reasoning end as reasoning
    from keyed as k left join cached as c on k.cache_key = c.cache_key join scored as s on k.id = s.id""",
)
def _classify(spark, sf_dir):
    out = classify.classify_reviews(
        cleaned(spark, sf_dir).select("id", "cleaned_text"),
        # Written once, as a cache is.
        stage(stored_cache(spark, sf_dir), "cache"),
        "v1",
        classify.lexicon_scorer(lexicon(spark, sf_dir)),
    )
    return out["results"]


@query("classify_model")
def _model(spark, sf_dir):
    labelled = (
        table(spark, sf_dir, "labels")
        .join(documents(spark, sf_dir), "doc_id")
        .select("doc_id", "text", F.when(F.col("quality") == 1, "UI/UX").otherwise("Other").alias("label"))
    )
    model = classify.train_theme_model(labelled)
    texts = documents(spark, sf_dir).select("doc_id", "text")
    return classify.classify_model(texts, model, "doc_id").withColumnRenamed("predicted", "theme")


# Responses written by rule from the events: one request per 20 events, with one kind of fault in some.
ANSWERS = """select event_id, event_id // 20 as batch_id, event_id % 20 as place, (event_id // 20) % 8 as fault, user_id from events"""
FAULTY_SQL = f"""a as ({ANSWERS}), r as (select batch_id, place,
    case when fault = 1 and place = 3 then 2 else place end as review_index,
    case when fault = 2 and place = 0 then 'Not A Theme' else {THEME_LIST}[1 + user_id % 10] end as theme,
    case when fault = 3 and place = 1 then 'ecstatic' else ['positive', 'neutral', 'negative'][1 + user_id % 3] end as sentiment,
    case when fault = 4 and place = 5 then 6 when fault = 5 and place = 5 then 0 else 1 + user_id % 5 end as severity,
    case when fault = 6 and place = 7 then null else concat('event ', cast(event_id as varchar)) end as reasoning from a)"""


def responses(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.expr("event_id div 20").alias("batch_id"),
        (F.col("event_id") % 20).cast("int").alias("place"),
        F.expr("(event_id div 20) % 8").alias("fault"),
        "event_id",
        "user_id",
    )
    fault, place = F.col("fault"), F.col("place")
    themes, sentiments = F.array(*[F.lit(t) for t in THEME_NAMES]), F.array(*[F.lit(s) for s in SENTIMENTS])
    record = F.struct(
        F.when((fault == 1) & (place == 3), 2).otherwise(place).alias("review_index"),
        F.when((fault == 2) & (place == 0), "Not A Theme").otherwise(themes[(F.col("user_id") % 10).cast("int")]).alias("theme"),
        F.when((fault == 3) & (place == 1), "ecstatic").otherwise(sentiments[(F.col("user_id") % 3).cast("int")]).alias("sentiment"),
        F.when((fault == 4) & (place == 5), 6).when((fault == 5) & (place == 5), 0).otherwise(1 + F.col("user_id") % 5).alias("severity"),
        F.when(~((fault == 6) & (place == 7)), F.concat_ws(" ", F.lit("event"), F.col("event_id").cast("string"))).alias("reasoning"),
    )
    packed = rows.groupBy("batch_id", "fault").agg(F.sort_array(F.collect_list(F.struct("place", record.alias("r")))).alias("rs"))
    text = F.to_json(F.struct(F.transform("rs", lambda x: x["r"]).alias("classifications")))
    return packed.select("batch_id", F.when(F.col("fault") == 7, F.lit("sorry, no answer")).otherwise(text).alias("response"), F.size("rs").alias("n"))


VALID = """(coalesce(list_contains({themes}, theme), false) and sentiment in ('positive', 'neutral', 'negative')
    and severity between 1 and 5 and reasoning is not null)""".format(themes=THEME_LIST)
PARSED = f"""{FAULTY_SQL}, f as (select distinct batch_id, fault from a),
parsed as (select r.batch_id, cast(place as bigint) as answer_pos, review_index, theme, sentiment, severity, reasoning, {VALID} as row_valid
    from r join f using (batch_id) where fault <> 7
    union all select batch_id, null, null, null, null, null, null, false from f where fault = 7)"""


@query("parse_response", f"with {PARSED} select batch_id, answer_pos, review_index, theme, sentiment, severity, reasoning, row_valid from parsed")
def _parse(spark, sf_dir):
    return classify.parse_response(responses(spark, sf_dir))


@query(
    "check_coverage",
    f"""with {PARSED}, sizes as (select batch_id, count(*) as n from a group by batch_id)
    select p.batch_id, coalesce(bool_and(row_valid) and count(distinct review_index) = any_value(n) and min(review_index) = 0
        and max(review_index) = any_value(n) - 1, false) as batch_valid from parsed as p join sizes using (batch_id) group by p.batch_id""",
)
def _coverage(spark, sf_dir):
    given = responses(spark, sf_dir)
    checked = classify.check_coverage(classify.parse_response(given), given.select("batch_id", "n"))
    return checked.groupBy("batch_id").agg(F.bool_and("batch_valid").alias("batch_valid"))


@query(
    "store_classifications",
    SCORED
    + """, old as (select id as review_id, 'Old' as theme, true_lang from cleaned where id in (select doc_id from labels))
    select id as review_id, 'v1' as prompt_version, theme, sentiment, severity, reasoning,
        concat('{"theme":"', theme, '","sentiment":"', sentiment, '","severity":', cast(severity as varchar), ',"reasoning":"', reasoning, '"}') as raw_response
    from scored where id in (select id from cleaned where true_lang = 'en')
    union all select review_id, 'v1', theme, 'neutral', 1, null, null from old where true_lang <> 'en'""",
)
def _store(spark, sf_dir):
    texts = cleaned(spark, sf_dir).select("id", "cleaned_text", "true_lang")
    old = texts.join(labelled_ids(spark, sf_dir), "id", "left_semi").select(
        F.col("id").alias("review_id"),
        F.lit("v1").alias("prompt_version"),
        F.lit("Old").alias("theme"),
        F.lit("neutral").alias("sentiment"),
        F.lit(1).alias("severity"),
        F.lit(None).cast("string").alias("reasoning"),
        F.lit(None).cast("string").alias("raw_response"),
    )
    scored = classify.classify_lexicon(
        texts.filter("true_lang = 'en'"), lexicon(spark, sf_dir), key="id", text="cleaned_text"
    ).withColumnRenamed("id", "review_id")
    return classify.store_classifications(old, scored, "v1")


# A batch for the texts of the other languages; its last answer for a key replaces the stored one.
@query(
    "upsert_replace",
    KEYED.replace("as (select id, cleaned_text, sha256", "as (select id, true_lang, cleaned_text, sha256")
    + """, latest as (select cache_key, max(id) as last_id from keyed where true_lang <> 'en' group by cache_key)
    select cache_key, concat('last ', cast(last_id as varchar)) as reasoning from latest
    union all select cache_key, concat('from ', cast(first_id as varchar)) from cached where cache_key not in (select cache_key from latest)""",
)
def _replace(spark, sf_dir):
    stored = stored_cache(spark, sf_dir).select("cache_key", F.col("response.reasoning").alias("reasoning"))
    batch = keyed(spark, sf_dir).filter("true_lang <> 'en'").select(
        "cache_key", F.concat_ws(" ", F.lit("last"), F.col("id").cast("string")).alias("reasoning"), "id"
    )
    return upsert_replace(stored.withColumn("id", F.lit(None).cast("bigint")), batch, ["cache_key"], ["id"]).drop("id")
