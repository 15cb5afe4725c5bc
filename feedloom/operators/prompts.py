"""Prompt text per version, rendered as columns over batches of reviews.

A prompt has sections in capitals: what to do, the allowed values, for some versions help, then the
shape of the answer and the batch, one review per line behind its index in brackets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.schemas import SENTIMENTS, THEME_NAMES, THEMES

# Heads the reviews of a batch; nothing but reviews follows it.
BATCH = "BATCH"
# Worked answers of v2: theme, sentiment, severity, review.
SOLVED = [
    ("Notifications", "negative", 3, "Eleven pings before breakfast and the mute switch does nothing"),
    ("Data & Privacy", "neutral", 2, "why would a torch need my contacts?"),
    ("Customer Support", "positive", 1, "Chat agent fixed my delivery slot in two minutes, lovely"),
]
SHAPE = (
    'JSON {"classifications": [...]} with exactly one entry for each index of the batch. Fields of an entry: '
    "review_index, theme, sentiment, severity, reasoning (a short phrase)."
)


def _section(title: str, *lines: str) -> list[str]:
    return [title, *lines, ""]


def _intro(version: str) -> str:
    themes = ["theme is one of: " + " | ".join(THEME_NAMES)] if version == "v1" else ["theme is one of"]
    if version != "v1":
        themes += [f"  {name} = {meaning}" for name, meaning in THEMES]
    lines = _section("TASK", "Label the store reviews of the batch.")
    lines += _section(
        "VALUES",
        *themes,
        "sentiment is one of: " + " | ".join(SENTIMENTS),
        "severity runs from 1, no harm done, up to 5, the product cannot be used",
    )
    if version == "v2":
        lines += _section("SOLVED", *[f"{theme} / {sentiment} / {severity} <= {text}" for theme, sentiment, severity, text in SOLVED])
    if version == "v3":
        lines += _section("HINTS", "An indented line quotes a labelled review near the one above it. Labels may differ.")
    lines += _section("ANSWER", SHAPE)
    return "\n".join([*lines, BATCH, ""])


def numbered(item: Column) -> Column:
    return F.concat(F.lit("["), item["review_index"].cast("string"), F.lit("] "), item["text"])


def with_examples(item: Column) -> Column:
    """A numbered review followed by the labelled examples retrieved for it, if any."""
    shown = F.transform(
        item["examples"],
        lambda e: F.concat(F.lit("\n    "), e["theme"], F.lit(" / "), e["sentiment"], F.lit(" <= "), e["text"]),
    )
    return F.concat(numbered(item), F.coalesce(F.array_join(shown, ""), F.lit("")))


def _render(version: str, line: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda items: F.concat(F.lit(_intro(version)), F.array_join(F.transform(items, line), "\n"), F.lit("\n"))


# Prompt versions by name: array of (review_index, text[, examples]) -> prompt text.
PROMPTS: dict[str, Callable[[Column], Column]] = {
    "v1": _render("v1", numbered),
    "v2": _render("v2", numbered),
    "v3": _render("v3", with_examples),
}


def prompt_for(version: str) -> Callable[[Column], Column]:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version {version!r}; known: {', '.join(PROMPTS)}")
    return PROMPTS[version]
