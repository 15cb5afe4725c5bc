"""Quality rules: word counts and repetition, then divergence from the document's language.

A document is compared with the reference of its declared language on two histograms: character
classes, and the language's commonest short words against all other words. The measure is the
Jensen-Shannon distance (base 2, so 0 to 1); a text shorter than a minimum length is not judged by
it. References are the pooled histograms of all documents of the language.

One pass over the texts keeps a few numbers and the short-word counts of each document; references
and verdicts are computed from those, so no text is shuffled. Only built-in functions are used.

Edge cases: a null text has no words; null languages are a language of their own; a language
without words judges nothing; repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import SEPARATORS, sized
from feedloom.plans.staging import stage

# The character classes, each taken from what the classes before it left over.
CLASSES = {
    "lower": r"[a-z]+",
    "blank": r"[\x20\x09-\x0D]+",
    "upper": r"[A-Z]+",
    "mark": r"[.,;:!?'\"()\-]+",
    "symbol": r"[#*$%&|<>]+",
    "digit": r"[0-9]+",
    "ascii": r"[\x00-\x7F]+",
}
# Limits of the base rules, and the settings of the divergence rules.
MIN_WORDS, MAX_REPEATED = 50, 50
SHORT_WORD, COMMON_WORDS = 4, 24
MIN_CHARS, MIN_JUDGED_WORDS = 200, 50
# The largest distance that passes, as (of a long text, added times 1 / sqrt(words)): short histograms are noisy.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = (0.18, 0.9), (0.21, 1.2)


def _again(numbered: Column) -> Column:
    """Places of the windows that occur at least twice; in sorted order such a window stands next to its equal.

    ``numbered`` must be a column of its own: inside a lambda an expression would be computed per element.
    """
    flagged = F.transform(
        numbered,
        lambda x, k: F.struct(
            x["i"].alias("i"),
            (x["g"].eqNullSafe(F.get(numbered, k - 1)["g"]) | x["g"].eqNullSafe(F.get(numbered, k + 1)["g"])).alias("twice"),
        ),
    )
    return F.transform(F.filter(flagged, lambda x: x["twice"]), lambda x: x["i"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base figures, class counts and short-word counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("t"), F.array_remove(F.split(text, SEPARATORS), "").alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    short = F.filter("words", lambda w: F.length(w) <= SHORT_WORD)
    n = F.size("words")
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    df = df.select(
        "*",
        n.cast("long").alias("n_words"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("grams"),
        lines.alias("lines"),
        F.sort_array(short).alias("short"),
    )
    all_apart = F.size(F.array_distinct("grams")) == F.size("grams")
    numbered = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("numbered", F.when(~all_apart, numbered))
    df = df.withColumn("again", F.coalesce(_again(F.col("numbered")), F.array().cast("array<int>")))
    covered = F.array_distinct(
        F.concat("again", F.transform("again", lambda i: i + 1), F.transform("again", lambda i: i + 2))
    )
    starts = F.filter(F.sequence(F.lit(0), F.size("short") - 1), lambda k: (k == 0) | (F.get("short", k) != F.get("short", k - 1)))
    df = df.select(
        "doc_id",
        "lang",
        "t",
        "short",
        "n_words",
        F.size(covered).cast("long").alias("n_repeat_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("short") > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"),
    )
    counted = F.transform(
        "starts",
        lambda p, j: F.struct(
            F.get("short", p).alias("w"), (F.coalesce(F.get("starts", j + 1), F.size("short")) - p).cast("long").alias("n")
        ),
    )
    left = "t"
    for name, pattern in CLASSES.items():
        rest = f"no_{name}"
        df = df.withColumn(rest, F.regexp_replace(left, pattern, ""))
        df = df.withColumn(name, (F.length(left) - F.length(rest)).cast("long"))
        left = rest
    return df.select(
        "doc_id",
        "lang",
        "n_words",
        (F.length("t") - F.col("blank")).cast("long").alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.length("t").cast("long").alias("n_all"),
        F.array(*CLASSES, F.length(left).cast("long")).alias("classes"),
        counted.alias("short_words"),
    )


def references(measured: DataFrame) -> DataFrame:
    """One row per language: class shares, and its commonest short words with their shares of all words."""
    n = len(CLASSES) + 1
    sums = measured.groupBy("lang").agg(
        F.sum("n_words").alias("all_words"), F.sum("n_all").alias("all_chars"), F.array(*[F.sum(F.col("classes")[i]) for i in range(n)]).alias("sums")
    )
    counts = measured.select("lang", F.inline("short_words")).groupBy("lang", "w").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    common = counts.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= COMMON_WORDS)
    # At most COMMON_WORDS entries per language.
    lists = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_place", "w", "n"))).alias("common"))
    joined = sums.alias("s").join(lists.alias("c"), F.col("s.lang").eqNullSafe(F.col("c.lang")), "left")
    return joined.select(
        F.col("s.lang").alias("ref_lang"),
        F.transform("sums", lambda x: x / F.greatest(F.col("all_chars"), F.lit(1))).alias("ref_classes"),
        F.transform("common", lambda x: F.struct(x["w"].alias("w"), (x["n"] / F.col("all_words")).alias("q"))).alias("ref_words"),
    )


def _term(p: Column, q: Column) -> Column:
    """One bin's part of twice the divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def judge(measured: DataFrame) -> DataFrame:
    """The base figures and the verdict of every row of ``measured`` (a written table)."""
    refs = sized(stage(references(measured), "language-references"))
    df = measured.join(refs, measured.lang.eqNullSafe(refs.ref_lang), "left")
    n = len(CLASSES) + 1
    share = lambda i: F.col("classes")[i] / F.greatest(F.col("n_all"), F.lit(1))
    by_class = reduce(lambda a, b: a + b, [_term(share(i), F.col("ref_classes")[i]) for i in range(n)])
    own = lambda word: F.get(F.col("short_words.n"), F.array_position(F.col("short_words.w"), word).cast("int") - 1)
    bins = F.transform(
        "ref_words",
        lambda r: F.struct((F.coalesce(own(r["w"]), F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1))).alias("p"), r["q"].alias("q")),
    )
    df = df.withColumn("bins", bins)
    # What is not a common word is one more bin.
    other = _term(
        F.greatest(1 - _total(F.transform("bins", lambda b: b["p"])), F.lit(0.0)),
        F.greatest(1 - _total(F.transform("bins", lambda b: b["q"])), F.lit(0.0)),
    )
    by_word = _total(F.transform("bins", lambda b: _term(b["p"], b["q"]))) + other
    distance = lambda twice: F.sqrt(F.greatest(twice / 2, F.lit(0.0)))
    df = df.withColumn("char_distance", distance(by_class)).withColumn("word_distance", distance(by_word))
    limit = lambda m: m[0] + m[1] / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    strange = (F.col("n_all") >= MIN_CHARS) & (F.col("char_distance") > limit(MAX_CHAR_DISTANCE)) | (
        F.col("n_words") >= MIN_JUDGED_WORDS
    ) & (F.col("word_distance") > limit(MAX_WORD_DISTANCE))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(strange, F.lit(False))).alias("kept"),
        "char_distance",
        "word_distance",
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """The figures and the verdict of every row of ``docs``."""
    return judge(stage(measure(docs), "quality-figures"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns; rows without a doc_id stay."""
    # Written first: a filter on the verdict would compute the distances anew for every use.
    verdicts = stage(quality_rules(docs).select("doc_id", "kept"), "verdicts")
    bad = verdicts.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(sized(stage(bad, "rejected")), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
