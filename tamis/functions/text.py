"""Column functions over texts: words, hygiene gates, URL keys and hash units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stopwords and the gate bounds of the hygiene rule.
STOPWORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from "
    "they we say her she or an will my one all would there their what so up out if about who get "
    "which go me is are was were can just no yes it's don't i'm"
)
MIN_BYTES, MAX_NON_ASCII, MIN_STOPWORDS = 200, 0.30, 0.10
#: Letters only, with one inner apostrophe.
WORD = r"\p{L}+(?:'\p{L}+)?"


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once: Spark shares nothing between the branches and operands of a condition."""
    return F.element_at(F.transform(F.array(value), use), 1)


def non_ascii_letter_ratio(text: Column) -> Column:
    """Share of letters that aren't A-Z or a-z; 0 without letters."""
    other = lambda letters: F.length(F.regexp_replace(letters, "[A-Za-z]+", ""))
    return _with(F.regexp_replace(text, r"\P{L}+", ""), lambda x: F.when(F.length(x) > 0, other(x) / F.length(x)).otherwise(F.lit(0.0)))


def stopword_ratio(text: Column) -> Column:
    """Share of words that are English stopwords; 0 without words. Words hold letters and apostrophes only, so a digit can stand for a stopword."""
    rests: dict[str, list[str]] = {}
    for word in STOPWORDS.split():  # by first letter, so that most words are told apart by one character
        rests.setdefault(word[0], []).append(word[1:])
    stop = "(?:^| )(?:" + "|".join(f"{first}(?:{'|'.join(own)})" for first, own in sorted(rests.items())) + ")(?= |$)"
    hits = lambda line: F.length(F.regexp_replace(F.regexp_replace(line, stop, "1"), "[^1]+", ""))
    count = lambda line: F.length(F.regexp_replace(line, "[^ ]+", "")) + 1
    return _with(F.array_join(words(text), " "), lambda x: F.when(x != "", hits(x) / count(x)).otherwise(F.lit(0.0)))


def hygiene_reason(text: Column) -> Column:
    """The first failing gate of a text, or null: empty, too_short, non_ascii, not_english. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text == "", F.lit("empty"))
        .when(F.octet_length(text) < MIN_BYTES, F.lit("too_short"))
        .when(non_ascii_letter_ratio(text) > MAX_NON_ASCII, F.lit("non_ascii"))
        .when(stopword_ratio(text) < MIN_STOPWORDS, F.lit("not_english"))
    )


def url_key(url: Column) -> Column:
    """Scheme, www., fragment and trailing slash stripped; small letters."""
    key = F.regexp_replace(F.lower(url), r"^[a-z]+://", "")
    key = F.regexp_replace(key, r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(key, r"#.*$", ""), r"/+$", "")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the SHA-256 of the parts, joined by |."""
    head = F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 32))
