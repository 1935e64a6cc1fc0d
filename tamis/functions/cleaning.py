"""Text clean-up: normal forms, marks of lines and comments, control strings, and windows of long texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Strings that steer a model and must not stand in its data.
CONTROL = ("<|pad|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|tool|>", "<note>", "</note>", "<think>", "</think>", "<lookup>", "</lookup>", "<result>", "</result>")
CONTROL_PATTERN = "|".join(c.replace("|", r"\|") for c in CONTROL)
#: What begins or marks a moderator's stock comment.
TEMPLATES = (
    "^(?:possible )?duplicate of\\b", "^this question (?:already has|appears to be off-topic)", "^i'?m voting to close\\b", "^from review\\b",
    "^this does not (?:provide|really answer)", r"\btake the \[?tour\b", r"\bhelp center\b", r"\bhow do i ask a good question\b",
)
_EDGE = r"[\p{Z}\t-\r\x1c-\x1f\x85]"


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode normal form C, for which Spark has no function; null stays."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalized(text: Column) -> Column:
    """NUL out, form C, one kind of line end, no blanks at line ends, no more than one empty line in a row, none at the ends."""
    lines = F.regexp_replace(composed(F.replace(text, F.lit("\x00"), F.lit(""))), "\r\n?", "\n")
    trimmed = F.regexp_replace(lines, rf"(?m)[\p{{Z}}\t\x0b-\r\x1c-\x1f\x85&&[^\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "\n{3,}", "\n\n"), rf"^{_EDGE}+|{_EDGE}+\z", "")


def without_bars(text: Column) -> Column:
    """The text without lines that hold bars and blanks only, a bar at least."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(r"^[\s|]*\|[\s|]*$")), "\n")


def comment_text(text: Column) -> Column:
    """Links become their words; marks of bold, italic and code go; white space becomes one blank."""
    plain = F.regexp_replace(text, r"\[([^\]\n]+)\]\((?:[^()\s]+)(?:\s+\"[^\"]*\")?\)", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\*\*([^*\n]+)\*\*", "$1"), r"\*([^*\n]+)\*", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "`([^`\n]+)`", "$1"), r"\s+", " "))


def is_template(text: Column) -> Column:
    return F.lower(text).rlike("|".join(TEMPLATES))


def control_strings(text: Column) -> Column:
    """How many control strings a text holds; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(CONTROL_PATTERN)), F.lit(0))


def without_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_PATTERN, " ")


def middle(text: Column, most: int) -> Column:
    """At most so many bytes from a long text's middle, cut at empty lines if it holds two; shorter texts and null stay. Characters that the byte
    cut would split are left out: a byte 80 to BF goes on with a character."""
    raw, size = F.encode(text, "UTF-8"), F.octet_length(text)
    begin = F.floor((size - most) / 2).cast("int")
    end = begin + most
    split_before = F.length(F.regexp_extract(F.hex(F.substr(raw, begin + 1, F.lit(3))), "^(?:[89AB].)*", 0)) / 2
    split_after = F.length(F.regexp_extract(F.hex(F.substr(raw, end - 2, F.lit(4))), "(?:[89AB].)*$", 0)) / 2
    begin, end = begin + split_before.cast("int"), end - F.when(end < size, split_after.cast("int")).otherwise(0)
    part = F.decode(F.substr(raw, begin + 1, end - begin), "UTF-8")
    first, last = F.instr(part, "\n\n"), F.length(part) - F.instr(F.reverse(part), "\n\n")
    inner = F.when((first > 0) & (first < last), F.substr(part, first + 2, last - first - 2)).otherwise(part)
    return F.when(size > most, F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(text)


def wiki_reason(wiki: Column, namespace: Column, extra: tuple[tuple[str, str], ...] = (("wikibooks.com", "102"), ("wikibooks.com", "110"))) -> Column:
    """Null for a content page, else wiki_talk (odd namespaces) or wiki_namespace."""
    content = namespace == "0"
    for name, number in extra:
        content = content | ((wiki == name) & (namespace == number))
    return F.when(F.coalesce(content, F.lit(False)), F.lit(None)).when(F.coalesce(namespace.rlike("^[0-9]*[13579]$"), F.lit(False)), "wiki_talk").otherwise("wiki_namespace")


def message_problem(deleted: Column, synthetic: Column, review: Column, spam: Column, lang: Column, text: Column, marked: Column) -> Column:
    """Why a message of a tree can't be used, the first reason that holds, or null."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(holds(deleted), "deleted")
        .when(holds(synthetic), "synthetic")
        .when(holds(~review), "review_failed")
        .when(holds(spam >= 0.5), "spam")
        .when(~holds(lang == "en"), "lang_mismatch")
        .when(F.coalesce(F.trim(text), F.lit("")) == "", "empty")
        .when(holds(marked), "aiism")
    )
