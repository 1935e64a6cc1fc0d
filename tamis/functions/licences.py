"""Licence gates: canonical names of licences that allow use, null for all others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Addresses and short names of Creative Commons licences, and the days on which a site's default licence changed.
ADDRESS = r"creativecommons\.org/(licenses|publicdomain)/([a-z-]+)/([0-9]+(?:\.[0-9]+)?)"
SHORT = r"^cc[- ]?(by(?:[- ]sa)?|zero|0)(?:[- ]v?([0-9]+(?:\.[0-9]+)?))?$"
ERAS = (("2011-04-08", "cc-by-sa-2.5"), ("2018-05-02", "cc-by-sa-3.0"), ("9999-99-99", "cc-by-sa-4.0"))


def canonical(raw: Column) -> Column:
    """public-domain, cc0, cc-by[-sa][-version], apache-2.0 or mit; null if refused or unknown, as Creative Commons without a variant is."""
    t = F.lower(F.trim(raw))
    kind, name, version = (F.regexp_extract(t, ADDRESS, i) for i in (1, 2, 3))
    dashed = F.replace(t, F.lit("_"), F.lit("-"))
    short, of = F.regexp_extract(dashed, SHORT, 1), F.regexp_extract(dashed, SHORT, 2)
    return (
        F.when(t.isin("public domain", "public-domain", "pd"), "public-domain")
        .when(t.isin("apache-2.0", "apache 2.0"), "apache-2.0")
        .when(t == "mit", "mit")
        .when(kind == "publicdomain", F.when(name == "zero", "cc0").when(name == "mark", "public-domain"))
        .when(kind != "", F.when(name.isin("by", "by-sa"), F.concat_ws("-", F.lit("cc"), name, version)))
        .when(t.rlike("creativecommons|creative commons"), F.lit(None).cast("string"))
        .when(short.isin("zero", "0"), "cc0")
        .when(short != "", F.concat_ws("-", F.lit("cc"), F.replace(short, F.lit(" "), F.lit("-")), F.when(of != "", of)))
    )


#: How a text says what it is licensed under, and words of a licence's title that its short name leaves out.
SAID = r"(?i)\b(?:licen[sc]ed|released) under (?:the )?([^\n]{2,60}?)\.?(?:\n|$)"
TITLE_WORDS = r"(?i)[, ]*\b(?:licen[sc]e|version)\b"


def in_text(text: Column) -> Column:
    """The licence that a text says it is under, as it names it but for words of titles; null where it says none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), SAID, 1), TITLE_WORDS, ""), F.lit(""))


def composite_reason(whole: Column, parts: Column) -> Column:
    """license if the whole or any part is refused, else license_component_missing if a part is null or 'None', else null."""
    blank = lambda p: p.isNull() | (p == "None")
    refused = canonical(whole).isNull() | F.exists(parts, lambda p: ~blank(p) & canonical(p).isNull())
    return F.when(F.coalesce(refused, canonical(whole).isNull()), "license").when(F.exists(parts, blank), "license_component_missing")


def by_era(created: Column) -> Column:
    """The default licence on a day: each holds until the next one begins."""
    day, held = F.substring(created, 1, 10), None
    for end, name in ERAS:
        held = F.when(day < end, name) if held is None else held.when(day < end, name)
    return held


def of_post(raw: Column, created: Column) -> Column:
    """A post's own licence, or the one of its day where it names none."""
    return F.when(F.coalesce(raw, F.lit("")) != "", canonical(raw)).otherwise(by_era(created))
