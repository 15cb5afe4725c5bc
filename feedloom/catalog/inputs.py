"""Review-shaped inputs derived from the given tables, as SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans.layout import spread

AS_OF = "2024-01-31"
DAYS = 15

SIGNALS = """
select event_id as review_id, concat('app', cast(user_id % 5 as varchar(10))) as app_id, 'v1' as prompt_version,
       event_type as theme, cast(user_id % 3 as int) as cluster_label,
       case when value < 20 then 'positive' when value < 60 then 'neutral' else 'negative' end as sentiment,
       cast(1 + (event_id * 7 + user_id) % 5 as int) as severity, cast(1 + event_id % 5 as int) as rating,
       cast((event_id * 13) % 50 as int) as thumbs_up, cast(ts as date) as review_date
from events"""

RAW_REVIEWS = """
select doc_id as id, concat('app', cast(doc_id % 3 as varchar(10))) as app_id,
       concat('App ', cast(doc_id % 3 as varchar(10))) as app_name, cast(doc_id as varchar(20)) as review_id,
       case when doc_id % 17 = 0 then null else cast(1 + doc_id % 5 as int) end as rating,
       case when doc_id % 11 = 0 then null else cast((doc_id * 7) % 50 as int) end as thumbs_up, text,
       case when doc_id % 13 = 0 then 'not-a-date'
            else cast(date '2024-01-01' + cast(doc_id % 90 as int) as varchar(10)) end as review_date,
       lang as true_lang
from documents"""

RANKINGS = """
select reviewer, app_id, pain_point,
       cast(row_number() over (partition by reviewer, app_id order by spend desc, pain_point) as int) as "rank"
from (select c_mktsegment as reviewer, r_name as app_id, p_type as pain_point, sum(l_extendedprice) as spend
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
           join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
           join part on l_partkey = p_partkey
      group by c_mktsegment, r_name, p_type) as spending"""

# Judgements of two prompt versions over the signals: theme rotated for every 7th (v1) or 5th (v2) review.
JUDGED = """
select prompt_version, id, true_theme, true_sentiment,
       case when id % step = 0 then case true_theme when 'click' then 'error' when 'error' then 'purchase'
            when 'purchase' then 'signup' when 'signup' then 'other' else 'click' end else true_theme end as theme,
       case when id % (step + 4) = 0 then 'neutral' else true_sentiment end as sentiment
from (select 'v1' as prompt_version, 7 as step, review_id as id, theme as true_theme, sentiment as true_sentiment
      from signals
      union all
      select 'v2' as prompt_version, 5 as step, review_id as id, theme as true_theme, sentiment as true_sentiment
      from signals) as versions"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, over all cores."""
    return spread(table(spark, sf_dir, "documents"))


def _sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run the SQL text on Spark with the named tables bound to DataFrames."""
    bound = re.sub(rf"\b(from|join) ({'|'.join(tables)})\b", r"\1 {\2}", sql)
    return spark.sql(bound.replace('"rank"', "`rank`"), **tables)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, SIGNALS, events=table(spark, sf_dir, "events"))


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, RAW_REVIEWS, documents=documents(spark, sf_dir))


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lineitem", "orders", "customer", "nation", "region", "part")
    return _sql(spark, RANKINGS, **{n: table(spark, sf_dir, n) for n in names})


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, JUDGED, signals=signals(spark, sf_dir))


def with_tables(*names: str) -> str:
    """SQL prologue naming the derived inputs as common table expressions."""
    known = {
        "signals": SIGNALS,
        "raw_reviews": RAW_REVIEWS,
        "rankings": RANKINGS,
        "judged": JUDGED,
        "cleaned": CLEANED,
        "pain": PAIN,
    }
    return "with recursive " + ", ".join(f"{n} as ({known[n]})" for n in names)


# Cleaned text as the cleaning operators give it for texts without emoji.
CLEAN_TEXT = (
    r"trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
)
CLEANED = f"select *, {CLEAN_TEXT} as cleaned_text from raw_reviews"

PAIN = f"""
select app_id, prompt_version, theme, cluster_label, count(*) as review_count,
       coalesce(cast(sum(severity * (6 - rating)) as double) / nullif(cast(sum(6 - rating) as double), 0),
                avg(cast(severity as double))) as weighted_severity,
       count(*) filter (where review_date > date '{AS_OF}' - {DAYS} and review_date <= date '{AS_OF}') as last_30_count,
       count(*) filter (where review_date > date '{AS_OF}' - {2 * DAYS}
                          and review_date <= date '{AS_OF}' - {DAYS}) as prev_30_count,
       cast(sum(thumbs_up) as bigint) as reach_sum
from signals where sentiment in ('negative', 'neutral')
group by app_id, prompt_version, theme, cluster_label"""
