"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers.

The patterns find assignments of secrets, access keys and long hex runs. Besides, every run of
credential characters that no pattern has found is scored by two first-order Markov models over
characters, one of random strings and one of ordinary identifiers; a run whose log-likelihood ratio
favours the random model by a margin, in total and per character, is reported too.

The models are trained from labelled samples: letter-only words of the corpus, as written and in capitals,
are the ordinary class, values that the patterns mark as secrets and digests of the ordinary words the random class;
the samples are bounded by a documented parameter. Everything runs on built-in functions.

Edge cases: a null text counts as empty; without samples of either class the smoothed models are
equal and nothing is added; repeated rows are scanned alike; an empty table gives an empty result;
other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_hash
from feedloom.plans.staging import stage

# The patterns by kind, in the order in which equal starts are listed, and the length each needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "markov")
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
MIN_VALUE = 12
# What a scored run is, and what the models must agree on.
RUN = r"[A-Za-z0-9+/_=-]{12,}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE = 20_000
BACK_OFF = 20.0
MIN_TOTAL, MIN_PER_CHARACTER = 12.0, 0.75


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and the pieces of text between them (one more)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _spans(kind: int, matches: Column, pieces: Column) -> Column:
    """array<struct<start, kind, end, value>> from the lengths of pieces and matches."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))
    steps = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    walked = F.aggregate(
        steps,
        empty,
        lambda a, s: F.struct(
            (a["at"] + F.length(s["p"]) + F.length(s["m"])).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + F.length(s["p"])).alias("start"),
                        F.lit(kind).alias("kind"),
                        (a["at"] + F.length(s["p"]) + F.length(s["m"])).alias("end"),
                        s["m"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return walked["out"]


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the patterns), runs and gaps (credential characters, and what lies before each)."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    # Matches and pieces are columns of their own, so each is computed once per text.
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, RUN), strict=True):
        matches, pieces = _found(F.col("t"), pattern)
        df = df.withColumn(f"m_{kind}", matches).withColumn(
            f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, pieces).otherwise(F.array(F.lit("")))
        )
    spans = [_spans(n, F.col(f"m_{k}"), F.col(f"p_{k}")).alias(f"s_{k}") for n, k in enumerate(KINDS[:3])]
    gaps = F.transform("p_markov", lambda p: F.length(p)).alias("gaps")
    df = df.select("doc_id", *spans, F.col("m_markov").alias("runs"), gaps)
    long_value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE
    return df.select(
        "doc_id",
        F.array_sort(F.concat(F.filter("s_assign", long_value), "s_access", "s_hex")).alias("base"),
        "runs",
        "gaps",
    )


def train(samples: DataFrame) -> DataFrame:
    """(value, random boolean) -> (bigram, llr): how much likelier the random model makes its second character.

    The table has one row per pair of symbols.
    """
    symbols = samples.sparkSession.createDataFrame([(c,) for c in SYMBOLS], "c string")
    pairs = symbols.select(F.col("c").alias("a"), F.explode(F.array(*map(F.lit, SYMBOLS))).alias("b"))
    bigrams = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    seen = (
        samples.filter(F.length("value") > 1)
        .select("random", F.explode(bigrams).alias("bigram"))
        .groupBy("bigram")
        .agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    )
    every = pairs.select(F.concat("a", "b").alias("bigram"), "a", "b").join(seen, "bigram", "left").fillna(0, ["r", "o"])
    rows = every.collect()  # len(SYMBOLS) squared rows
    logs = [_log_model({(r.a, r.b): r[column] for r in rows}) for column in ("r", "o")]
    table = [(r.bigram, logs[0][r.a, r.b] - logs[1][r.a, r.b]) for r in rows]
    return samples.sparkSession.createDataFrame(table, "bigram string, llr double")


def _log_model(count: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """log P(b after a), drawn towards P(b) where a is rare, and P(b) towards even shares."""
    after, alone = dict.fromkeys(SYMBOLS, 0), dict.fromkeys(SYMBOLS, 0)
    for (a, b), n in count.items():
        after[a] += n
        alone[b] += n
    every = sum(alone.values())
    share = {b: (n + 0.5) / (every + 0.5 * len(SYMBOLS)) for b, n in alone.items()}
    return {(a, b): math.log((n + BACK_OFF * share[b]) / (after[a] + BACK_OFF)) for (a, b), n in count.items()}


def samples_of(scanned: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Up to ``limit`` labelled values per class: secrets found by the patterns, and letter-only runs."""
    value = F.col("s.value")
    secrets = (
        scanned.select(F.explode("base").alias("s"))
        .select(F.when(F.col("s.kind") == 0, F.regexp_extract(value, ASSIGN, 2)).otherwise(value).alias("value"))
        .filter(F.length("value") >= 16)
    )
    words = scanned.select(F.explode("runs").alias("value"))
    words = words.filter(F.col("value").rlike("^[A-Z]?[a-z]+$"))
    # Equal values count once, and the draw is by hash, so no document and no copy decides it.
    draw = lambda df: df.select("value").distinct().orderBy(id_hash(7, "value"), "value").limit(limit)
    ordinary = stage(draw(words), "ordinary-words")
    # Digests of the same words in base 64 are random by construction; the patterns alone know mostly hex.
    digests = ordinary.select(F.base64(F.unhex(F.sha2("value", 256))).alias("value"))
    random = draw(secrets).union(digests)
    # Each word counts in capitals too. Runs of capitals are no samples: where they are rare, random ones would be their own model.
    words = ordinary.union(ordinary.select(F.upper("value")))
    return random.withColumn("random", F.lit(True)).union(words.withColumn("random", F.lit(False)))


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, value) of every row."""
    scanned = stage(_columns(docs), "secret-spans")
    llr = {r.bigram: r.llr for r in train(samples_of(scanned, sample)).collect()}
    # The table of symbol pairs has a fixed size, so it travels inside the expression, as an array by symbol numbers.
    n = len(SYMBOLS)
    table = F.array(*[F.lit(float(llr[a + b])) for a in SYMBOLS for b in SYMBOLS])
    number = F.array(*[F.lit(SYMBOLS.find(chr(i)) if 0 < i and chr(i) in SYMBOLS else None).cast("int") for i in range(128)])

    def ratio(value: Column) -> Column:
        codes = F.transform(F.split(value, ""), lambda c: F.get(number, F.ascii(c)))
        start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum"))
        step = lambda a, c: F.struct(
            F.coalesce(c, a["last"]).alias("last"), (a["sum"] + F.coalesce(F.get(table, a["last"] * n + c), F.lit(0.0))).alias("sum")
        )
        return F.aggregate(codes, start, step)["sum"]

    margin = lambda v: F.greatest(F.lit(MIN_TOTAL), MIN_PER_CHARACTER * F.length(v))
    kind = KINDS.index("markov")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    steps = F.zip_with("runs", F.slice("gaps", 1, F.size("runs")), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
    found = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, s: F.struct(
            (a["at"] + s["g"] + F.length(s["v"])).alias("at"),
            F.when(
                ratio(s["v"]) >= margin(s["v"]),
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + s["g"]).alias("start"),
                            F.lit(kind).alias("kind"),
                            (a["at"] + s["g"] + F.length(s["v"])).alias("end"),
                            s["v"].alias("value"),
                        )
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
    )["out"]
    df = scanned.select("doc_id", "base", found.alias("found"))
    # A run that touches a pattern's span is that secret already.
    added = F.filter("found", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"])))
    return df.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mask(docs: DataFrame, spans: DataFrame, with_text: str = "[secret]") -> DataFrame:
    """(doc_id, text) with every span of ``spans`` (a result of ``scan``) replaced."""
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(spans.select("doc_id", "spans"), "doc_id")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, s["start"] - a["at"]), F.lit(with_text)))
        .otherwise(a["out"])
        .alias("out"),
    )
    walked = F.aggregate("spans", start, step)
    rest = F.substring(F.col("t"), walked["at"] + 1, F.length("t"))
    return joined.select("doc_id", F.concat(walked["out"], rest).alias("text"))
