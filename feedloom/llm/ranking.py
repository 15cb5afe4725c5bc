"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is a linear score of features of its text. Of each labelled good and bad document
put together as a pair, the good one is preferred; the weights maximise the likelihood of these
preferences, which is logistic loss on feature differences without an intercept. The decision
threshold is a quantile of the scores of the labelled sample: the share of bad documents in it.

The weights are fitted on a bounded sample of labelled rows (``sample_rows``); all documents are
scored, in one pass over whole texts that shuffles nothing.

Edge cases: a null text counts as empty and gets the score of an empty text; a document with
contradicting labels is not learned from; without both labels in the sample there is nothing to
prefer and every score is 0.5; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import id_hash
from feedloom.plans.staging import stage

# Bounds of the labelled sample, pairs per document of the larger class, and where "good" starts.
SAMPLE_ROWS = 20_000
PAIRS_PER_ROW = 3
GOOD = 0.3
# Byte classes whose shares are features.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#*$%&<>@^~=_+\\/{}[]",
    "quote": b"'\"()-`",
}
FEATURES = [*_CLASSES, "other", "log_words", "word_length", "distinct_words", "repeated_windows", "repeated_lines", "short_words"]
_IN_CLASS = np.zeros((256, len(_CLASSES) + 1))
for _i, _members in enumerate(_CLASSES.values()):
    _IN_CLASS[list(_members), _i] = 1
_IN_CLASS[128:, -1] = 1


def features(text: str) -> list[float]:
    """The feature values of one whole text."""
    raw = text.encode()
    shares = np.bincount(np.frombuffer(raw, "uint8"), minlength=256) @ _IN_CLASS / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    windows = len(words) - 2
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return [
        *shares.tolist(),
        float(np.log1p(len(words))),
        min(30.0, sum(map(len, words)) / n),
        len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / windows if windows > 0 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        sum(len(w) <= 3 for w in words) / n,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def feature_column(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t or "") for t in texts], dtype=object)


class Ranking(NamedTuple):
    """Weights and shift of the linear score; the threshold is already in the shift. None: nothing was learned."""

    weights: list[float] | None
    shift: float


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pairs_per_row: int = PAIRS_PER_ROW) -> Ranking:
    """Learn from ``labels`` (doc_id, quality 0 or 1; one label per document) on ``docs``."""
    known = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("_other"))
        .filter("label = _other")
    )
    drawn = known.select("doc_id", "label", id_hash(1, "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_rows)
    # The drawn rows are at most sample_rows ids, so they are sent to the documents and no text moves.
    texts = docs.select("doc_id", "text").join(F.broadcast(stage(drawn, "drawn-labels")), "doc_id")
    sample = stage(texts.select("label", "h", "doc_id", feature_column("text").alias("x")), "labelled-sample")
    scale = sample.select("label", F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = {r.k: (r.m, r.s) for r in scale.collect()}
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Ranking(None, 0.0)
    mean, sd = (np.array([scale[k][j] for k in range(len(FEATURES))]) for j in (0, 1))
    sd = np.where(sd > 1e-9, sd, np.inf)
    standard = F.array(*[(F.col("x")[k] - float(mean[k])) / float(sd[k]) if np.isfinite(sd[k]) else F.lit(0.0) for k in range(len(FEATURES))])
    # Numbering runs over the bounded sample only.
    placed = sample.select("label", standard.alias("z"), (F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id")) - 1).alias("place"))
    more = max(sizes, key=sizes.get)
    turns = F.explode(F.sequence(F.lit(0), F.lit(pairs_per_row - 1)))
    many = placed.filter(F.col("label") == more).select("z", (F.col("place") * pairs_per_row).alias("base"), turns.alias("turn"))
    many = many.select("z", F.pmod(F.col("base") + F.col("turn"), F.lit(sizes[1 - more])).alias("place"))
    few = placed.filter(F.col("label") != more).select(F.col("z").alias("other"), "place")
    apart = F.zip_with("z", "other", (lambda a, b: a - b) if more == 1 else (lambda a, b: b - a))
    better = many.join(few, "place").select(apart.alias("d"))
    pairs = better.select(F.lit(1.0).alias("label"), "d").union(better.select(F.lit(0.0), F.transform("d", lambda v: -v)))
    pairs = stage(pairs, "preference-pairs").select("label", array_to_vector("d").alias("features"))
    fitted = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60).fit(pairs)
    raw = fitted.coefficients.toArray() / sd
    worth = np.sort(np.array([r.s for r in sample.select(_dot("x", raw).alias("s")).collect()]))
    # The quantile that leaves as many of the sample below as are labelled bad; halfway to the next score.
    below = sizes[0]
    threshold = (worth[below - 1] + worth[min(below, len(worth) - 1)]) / 2
    return Ranking(raw.tolist(), float(np.log(GOOD / (1 - GOOD)) - threshold))


def _dot(x: str, weights) -> Column:
    terms = [F.col(x)[k] * float(w) for k, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from GOOD on) of every row."""
    if ranking.weights is None:
        value = F.lit(0.5)
        scored = docs.select("doc_id", value.alias("score"))
    else:
        weights, shift = np.array(ranking.weights), ranking.shift

        @F.pandas_udf("double")
        def worth(texts: pd.Series) -> pd.Series:
            x = np.array([features(t or "") for t in texts]).reshape(-1, len(weights))
            return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights + shift, -500, 500))))

        scored = docs.select("doc_id", worth("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that is never learned from; rows without an id are not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
