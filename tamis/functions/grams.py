"""Column functions over word n-grams, and the gates on late text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of model-written text, and years after the cutoff as words of their own.
MODEL_NOUN = r"(?:(?:large )?language model|artificial intelligence|ai model|ai assistant|chatbot|a\.i\.|ai)"
MODEL_PHRASES = (
    rf"\bas an? {MODEL_NOUN}\b",
    rf"\bi(?: am|'m) (?:just |only |merely |simply )?an? {MODEL_NOUN}\b",
    r"\blanguage model (?:developed|trained|created|made) by\b",
    r"\b(?:trained|developed|created) by openai\b",
    r"\bi (?:don't|do not) have (?:personal|my own) (?:opinions|beliefs|experiences|preferences|feelings|emotions)\b",
    r"\b(?:my|the) knowledge cut-?off\b",
    r"\bas of my (?:last|latest) (?:update|training)\b",
    r"\bmy training data\b",
    r"\bi(?: am|'m) open ?assistant\b",
    r"\bchat ?gpt\b",
    r"\bgpt-?3\.5\b",
    r"\bgpt-?4o?\b",
    r"\bopen ?ai\b",
)
LATE_YEAR = r"(?:^|[^\w.,])202[3-9](?:\W|$)"


def grams(words: Column, n: int) -> Column:
    """Every n neighbouring words joined by spaces; none of fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


def has_repeat(ordered: Column, times: int) -> Column:
    """Whether a sorted array holds some value so many times: then two places that far apart are equal."""
    at = F.sequence(F.lit(1), F.size(ordered) - (times - 1))
    return F.when(F.size(ordered) >= times, F.exists(at, lambda i: F.element_at(ordered, i) == F.element_at(ordered, i + (times - 1)))).otherwise(F.lit(False))


def shared_part(source: Column, target: Column) -> Column:
    """Share of the distinct values of `source` that `target` has; 0 if there are fewer than two."""
    distinct = F.array_distinct(source)
    return F.when(F.size(distinct) >= 2, F.size(F.array_intersect(distinct, target)) / F.size(distinct)).otherwise(F.lit(0.0))


def model_phrase(text: Column) -> Column:
    """Whether a text holds a phrase that model-written text has; false for null."""
    return F.coalesce(F.replace(F.lower(text), F.lit("’"), F.lit("'")).rlike("|".join(MODEL_PHRASES)), F.lit(False))


def late_year(text: Column) -> Column:
    """Whether a text names a year from 2023 to 2029; false for null."""
    return F.coalesce(text.rlike(LATE_YEAR), F.lit(False))


def in_reserve(salt: str, key: Column) -> Column:
    """Whether the key falls in the eighth held in reserve: the salted SHA-256, as a number, is a multiple of 8."""
    last = F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")).cast("binary"), 256), 64, 1)
    return last.isin("0", "8")
