"""Declared table schemas and the shared taxonomy."""

from __future__ import annotations

from pyspark.sql import types as T

# The names of the ten themes, in display order. The notes tell a scorer where each one ends.
THEMES = [
    ("Performance & Crashes", "the program itself breaks down: freezing, quitting, lagging, draining the phone"),
    ("Login & Account", "getting in or staying in: passwords, codes, sessions, profiles"),
    ("Payments & Billing", "money moved wrongly: double bookings, refunds, receipts, declined cards"),
    ("UI/UX", "layout and handling, where nothing is broken but something is hard or pleasant to use"),
    ("Feature Request", "something absent that the writer would like to have"),
    ("Customer Support", "dealings with the people behind the product"),
    ("Pricing", "the amount asked, as opposed to how it was charged"),
    ("Notifications", "messages pushed to the device, or those that fail to come"),
    ("Data & Privacy", "what is collected, shared, lost or asked access to"),
    ("Other", "none of these"),
]
THEME_NAMES = [name for name, _ in THEMES]
# The sentiment labels.
SENTIMENTS = ["positive", "neutral", "negative"]


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str, required: tuple[str, ...] = (), **nested: T.DataType) -> T.StructType:
    """Fields from ``name type`` pairs; built without a running session."""
    fields = []
    for column in columns.split(","):
        name, kind = column.split()
        fields.append(T.StructField(name, nested[name] if name in nested else _TYPES[kind], name not in required))
    return T.StructType(fields)


REVIEWS = _schema(
    "id bigint, app_id string, app_name string, review_id string, user_name string, rating int, thumbs_up int,"
    " text string, cleaned_text string, language string, review_date date, app_version string, source string,"
    " created_at timestamp",
    ("app_id", "app_name", "review_id", "text", "cleaned_text", "source"),
)
CLASSIFICATIONS = _schema(
    "review_id bigint, prompt_version string, theme string, sentiment string, severity int, reasoning string,"
    " raw_response string, created_at timestamp",
    ("review_id", "prompt_version"),
)
RETRIEVALS = _schema(
    "review_id bigint, prompt_version string, examples array",
    ("review_id", "prompt_version"),
    examples=T.ArrayType(_schema("text string, theme string, sentiment string, distance double")),
)
PAIN_POINTS = _schema(
    "app_id string, prompt_version string, theme string, cluster_label int, title string, summary string,"
    " next_step string, review_count bigint, weighted_severity double, last_30_count bigint, prev_30_count bigint,"
    " reach_sum bigint, example_quotes array, example_review_ids array",
    ("app_id", "prompt_version", "theme", "cluster_label"),
    example_quotes=T.ArrayType(T.StringType()),
    example_review_ids=T.ArrayType(T.LongType()),
)
PAIN_POINT_MEMBERS = _schema(
    "app_id string, prompt_version string, theme string, cluster_label int, review_id bigint",
    ("app_id", "prompt_version", "theme", "cluster_label", "review_id"),
)
MODEL_CACHE = _schema(
    "cache_key string, response struct, created_at timestamp",
    ("cache_key",),
    response=_schema("theme string, sentiment string, severity int, reasoning string"),
)
LABELS = _schema("review_id bigint, theme string, sentiment string, labeler string, labeled_at timestamp")
PM_RANKINGS = _schema(
    "reviewer string, app_id string, pain_point string, rank int, rating int, ranked_at timestamp"
)
LABEL_QUEUE = _schema("id bigint, app_id string, app_name string, rating int, cleaned_text string")
