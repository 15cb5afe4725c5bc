"""Queries of the operators that look at each text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from feedloom.llm import ranking, secrets
from feedloom.llm.bpe import round_trip
from feedloom.llm.common import table
from feedloom.llm.phrases import collocations
from feedloom.llm.quality_rules import quality_rules
from feedloom.llm.registry import query


@query("op1_bradley_terry")
def op1_bradley_terry(spark, sf_dir):
    """The quality score of every document, learned from the labelled ones outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~ranking.held_out())
    scored = ranking.score(docs, ranking.fit(docs, labels))
    return scored.select("doc_id", ranking.held_out().alias("held_out"), "score", "predicted")


RULES_SQL = r"""
with texts as (
  select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, concat(words[i], ' ', words[i + 1], ' ', words[i + 2]) as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from texts)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from windows) where c > 1),
repeated as (select doc_id, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from texts)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
c1 as (select *, regexp_replace(t, '[a-z]+', '', 'g') as r1 from texts),
c2 as (select *, regexp_replace(r1, '[\x20\x09-\x0D]+', '', 'g') as r2 from c1),
c3 as (select *, regexp_replace(r2, '[A-Z]+', '', 'g') as r3 from c2),
c4 as (select *, regexp_replace(r3, '[.,;:!?''"()-]+', '', 'g') as r4 from c3),
c5 as (select *, regexp_replace(r4, '[#*$%&|<>]+', '', 'g') as r5 from c4),
c6 as (select *, regexp_replace(r5, '[0-9]+', '', 'g') as r6 from c5),
c7 as (select *, regexp_replace(r6, '[\x00-\x7F]+', '', 'g') as r7 from c6),
base as (
  select doc_id, lang, words, len(words) as n_words, length(t) as n_all, length(t) - (length(r1) - length(r2)) as word_chars,
         length(r4) - length(r5) as n_symbols,
         [length(t) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4),
          length(r4) - length(r5), length(r5) - length(r6), length(r6) - length(r7), length(r7)] as classes
  from c7),
class_rows as (select doc_id, lang, n_all, unnest(range(1, 9)) as k, unnest(classes) as n from base),
class_ref as (
  select lang, k, sum(n) / greatest(sum(n_all), 1) as q from class_rows group by lang, k),
class_terms as (
  select c.doc_id, c.n / greatest(c.n_all, 1) as p, q
  from class_rows c join class_ref r on c.lang is not distinct from r.lang and c.k = r.k),
word_rows as (
  select doc_id, lang, w, count(*) as n from (select doc_id, lang, unnest(words) as w from texts) where length(w) <= 4 group by doc_id, lang, w),
totals as (select lang, sum(n_words) as n from base group by lang),
common as (
  select lang, w, sum(n) as n from word_rows group by lang, w
  qualify row_number() over (partition by lang order by sum(n) desc, w) <= 24),
word_ref as (select c.lang, c.w, c.n / t.n as q from common c join totals t on c.lang is not distinct from t.lang),
word_bins as (
  select b.doc_id, coalesce(r.n, 0) / greatest(b.n_words, 1) as p, f.q
  from base b join word_ref f on b.lang is not distinct from f.lang left join word_rows r on r.doc_id = b.doc_id and r.w = f.w),
word_terms as (
  select * from word_bins union all
  select doc_id, greatest(1 - sum(p), 0), greatest(1 - sum(q), 0) from word_bins group by doc_id),
class_distance as (
  select doc_id, sqrt(greatest(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end
       + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 0)) as d from class_terms group by doc_id),
word_distance as (
  select doc_id, sqrt(greatest(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end
       + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 0)) as d from word_terms group by doc_id),
figures as (
  select b.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
         cast(coalesce(l.n, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
         n_words < 50 or 100 * coalesce(r.n, 0) > 50 * n_words as base_failed,
         n_all >= 200 and c.d > 0.18 + 0.9 / sqrt(greatest(n_words, 1)) or n_words >= 50 and w.d > 0.21 + 1.2 / sqrt(greatest(n_words, 1)) as strange
  from base b left join lines l using (doc_id) left join repeated r using (doc_id)
       left join class_distance c using (doc_id) left join word_distance w using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(strange, false) as kept
from figures"""


@query("op2_language_divergence", RULES_SQL)
def op2_language_divergence(spark, sf_dir):
    """The base figures and the verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


@query("op4_bpe_streaming")
def op4_bpe_streaming(spark, sf_dir):
    """Every text encoded and decoded again, as digests."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_markov_secrets")
def op7_markov_secrets(spark, sf_dir):
    """The secrets in every text: those of the fixed patterns, and random-looking strings besides."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[n(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


PHRASES_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from documents),
worded as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as words from pieces),
totals as (select lang, sum(len(words)) as n from worded group by lang),
starts as (select lang, words, unnest(range(1, len(words) + 1)) as i from worded),
grams as (select lang, words[i : i + k - 1] as g from starts, (select unnest([1, 2, 3, 4, 5]) as k) where i + k - 1 <= len(words)),
counts as (select lang, g, count(*) as f from grams group by lang, g),
candidates as (select lang, g, f as a from counts where len(g) > 1 and f >= 100),
longer as (
  select distinct c.lang, c.g[i : j] as g, c.a
  from candidates c, (select unnest(range(1, 6)) as i) x, (select unnest(range(1, 6)) as j) y
  where j > i and j <= len(c.g) and j - i + 1 < len(c.g)),
kept as (
  select c.* from candidates c
  where not exists (select 1 from longer b where b.lang = c.lang and b.g = c.g and 100 * b.a >= 100 * c.a)),
cuts as (
  select c.lang, c.g, c.a, k, l.f as l, r.f as r, t.n,
         (1000::hugeint * c.a * t.n) // (l.f::hugeint * r.f) as score
  from kept c join (select unnest([1, 2, 3, 4]) as k) on k < len(c.g)
       join counts l on l.lang = c.lang and l.g = c.g[1 : k]
       join counts r on r.lang = c.lang and r.g = c.g[k + 1 : len(c.g)]
       join totals t on t.lang = c.lang),
scored as (select *, array_to_string(g, ' ') as phrase from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000"""


@query("op12_phrase_collocations", PHRASES_SQL)
def op12_phrase_collocations(spark, sf_dir):
    """The phrases of each language whose words stick together most."""
    return collocations(table(spark, sf_dir, "documents"))
