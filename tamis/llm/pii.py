"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of one pattern for each kind. Labelers vote on each (1: personal, -1: not, 0: abstains): format
checks, small gazetteers and words beside the span. Votes meet as a table of counts by kind and vote pattern, whose size depends
on the labelers alone. Expectation-maximisation over that table estimates each labeler's reliability, and a linear span
classifier is trained on the posteriors. Base spans (the contract's four kinds that pass their checks) always stay; a candidate of another kind
is added where the classifier accepts it, no labeler of formats refuses it and no base span overlaps it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.session import Scratch

#: Code points beside a span that the context labeler reads.
BEFORE, AFTER = 40, 20
#: Spans placed at a time, so that building an array of them takes time in proportion to their number.
BLOCK = 256
ROUNDS = 60

_RUN = "A-Za-z0-9._%+-"
#: A kind's pattern (possessive and anchored where that changes no match, so that long runs stay linear), a
#: literal or class without which a text has no match, and words that speak for it nearby.
BASE = {
    "email": (rf"(?:\G|(?<![{_RUN}]))[{_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"mail|contact|write to|reply|schreib|correo"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"\bip\b|addr|host|server|client|login|from"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", r"card|visa|master|amex|karte|carte|tarjeta|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"phone|tel|call|mobile|cell|fax|anruf|llam"),
}
EXTRA = {
    "masked_email": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++", r"[\[(]at[\])]", r"mail|contact|write to|reply"),
    "local_phone": (r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9]{3}[.-][0-9]{4}", r"phone|tel|call|mobile|cell|fax"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", r"\bssn\b|social|security"),
    "iban": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])", r"[A-Z]{2}[0-9]{2}", r"iban|account|konto|compte|cuenta|bank"),
}
KINDS = BASE | EXTRA
#: Gazetteers. Top-level domains, telephone country codes, card number prefixes, bank country codes.
DOMAINS = "com org net edu gov io info biz co de fr es uk us eu it nl ch at be ca au jp cn in br mx ru pl se no dk fi"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421"
CARD_PREFIXES = "34 37 4 51 52 53 54 55 22 23 24 25 26 27 6011 65 35 30 36 38"
BANK_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE"
#: Fixed value: what speaks against a span beside it.
AGAINST = r"version|release|order|invoice|article|isbn|doi|figure|section|build"
VOTERS = ("format", "gazetteer", "context", "length", "edge")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _alternatives(words: str) -> str:
    return "|".join(words.split())


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + twice

    at = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.when(F.length(digits) > 0, F.aggregate(at, F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def _mod97(value: Column) -> Column:
    """Whether a bank account number passes its check: letters as two digits, first four characters last."""
    plain = F.regexp_replace(value, "\\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _passes(kind: Column, value: Column) -> Column:
    """The check that a match must pass; for base kinds, the contract's."""
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = _digits(value)
    return (
        F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .when(kind == "ssn", ~value.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "iban", _mod97(value))
        .otherwise(F.lit(True))
    )


#: What a gazetteer knows of a kind's spans, as patterns over them.
KNOWN = {
    "email": rf"\.(?i:{_alternatives(DOMAINS)})$",
    "masked_email": rf"(?i)(?:\.|dot[\])])\x20?(?:{_alternatives(DOMAINS)})$",
    "phone": rf"^\+(?:{_alternatives(COUNTRY_CODES)})",
    "card": rf"^(?:{_alternatives(CARD_PREFIXES)})",
    "iban": rf"^(?:{_alternatives(BANK_COUNTRIES)})",
    "ip": r"^(?:10|127|192\.168|172|8\.8)\.",
}
#: The usual lengths of a kind.
USUAL = {"email": (8, 60), "ip": (7, 15), "card": (13, 23), "phone": (10, 22), "masked_email": (8, 70), "local_phone": (12, 15), "ssn": (11, 11), "iban": (15, 42)}
#: Kinds whose patterns leave nothing for a format check.
UNCHECKED = ("email", "masked_email", "local_phone")


def _by_kind(kind: Column, values: dict) -> Column:
    """A constant that depends on the kind; null for kinds that have none."""
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in values.items()))


def votes(kind: Column, value: Column, before: Column, after: Column, passed: Column) -> Column:
    """Struct of each labeler's vote on a span."""
    vote = lambda for_, against: F.when(against, F.lit(-1)).when(for_, F.lit(1)).otherwise(F.lit(0))
    near = F.lower(F.concat_ws(" ", before, after))
    usual = F.length(value).between(_by_kind(kind, {k: v[0] for k, v in USUAL.items()}), _by_kind(kind, {k: v[1] for k, v in USUAL.items()}))
    said = {
        "format": vote(passed & ~kind.isin(*UNCHECKED), ~passed),
        "gazetteer": vote(F.rlike(value, _by_kind(kind, KNOWN)), (kind == "ip") & value.startswith("0")),
        "context": vote(F.rlike(near, _by_kind(kind, {k: v[2] for k, v in KINDS.items()})), F.lower(before).rlike(AGAINST)),
        "length": vote(usual, ~usual),
        "edge": vote(F.lit(False), before.rlike(r"[\w/.-]$") | after.rlike(r"^[\w/]")),
    }
    return F.struct(*(said[v].cast("tinyint").alias(v) for v in VOTERS))


def _matches(kind: str, text: Column) -> Column:
    """A kind's leftmost non-overlapping matches; null where a quick look finds none."""
    pattern, needed, _ = KINDS[kind]
    there = F.contains(text, F.lit(needed)) if len(needed) == 1 else text.rlike(needed)
    return F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _placed(part: Column) -> Column:
    """array<struct<kind,start,end,value,before,after>> of one kind's matches, in code points; gaps are what stands around them."""
    span = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"

    def one(acc: Column, i: Column) -> Column:
        gap, value = F.element_at(part["gaps"], i + 1), F.element_at(part["matches"], i + 1)
        start = acc["at"] + F.length(gap)
        end = start + F.length(value)
        made = F.struct(
            part["kind"].alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"),
            F.right(gap, F.lit(BEFORE)).alias("before"), F.left(F.element_at(part["gaps"], i + 2), F.lit(AFTER)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(made)).alias("spans"))

    def block(acc: Column, b: Column) -> Column:
        last = F.least(F.size(part["matches"]), (b + 1) * BLOCK) - 1
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0))
        start = F.struct(at.alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
        return F.concat(acc, F.array(F.aggregate(F.sequence(b * BLOCK, last), start, one)))

    blocks = F.sequence(F.lit(0), F.floor((F.size(part["matches"]) - 1) / BLOCK).cast("int"))
    none = F.array().cast(f"array<struct<at:int,spans:array<{span}>>>")
    return F.aggregate(blocks, none, block, lambda acc: F.flatten(F.transform(acc, lambda x: x["spans"])))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row: array<struct<kind,start,end,ok,votes>> by kind, then start."""
    held = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # columns of their own, since what a lambda holds is worked out again for each element
    held = held.select("key", "t", *(_matches(k, F.col("t")).alias(f"m_{k}") for k in KINDS))
    part = lambda k: F.when(
        F.size(f"m_{k}") > 0, F.struct(F.lit(k).alias("kind"), F.col(f"m_{k}").alias("matches"), F.split("t", KINDS[k][0], -1).alias("gaps"))
    )
    held = held.select("key", F.filter(F.array(*map(part, KINDS)), lambda p: p.isNotNull()).alias("parts"))
    held = held.select("key", F.flatten(F.transform("parts", _placed)).alias("spans"))
    held = held.select("key", F.transform("spans", lambda s: s.withField("ok", _passes(s["kind"], s["value"]))).alias("spans"))

    def voted(s: Column) -> Column:
        vote = votes(s["kind"], s["value"], s["before"], s["after"], s["ok"])
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["ok"].alias("ok"), vote.alias("votes"))

    return held.select("key", F.transform("spans", voted).alias("spans"))


@dataclass(frozen=True)
class SpanModel:
    """Linear weights over (kind, labeler, vote) and kinds; `reliability` holds P(vote | class) by kind and labeler."""

    weights: dict[tuple[str, str, int], float]
    bias: dict[str, float]
    reliability: dict[tuple[str, str], list[list[float]]]

    def score(self, kind: Column, vote: Column) -> Column:
        """Log-odds of a span; kinds without a span to learn from are refused."""
        if not self.bias:
            return F.lit(-1.0)
        total = F.coalesce(_by_kind(kind, self.bias), F.lit(-1.0))
        for v in VOTERS:
            yes, no = ({k: self.weights[k, v, said] for k in self.bias} for said in (1, -1))
            total = total + F.coalesce(F.when(vote[v] == 1, _by_kind(kind, yes)).when(vote[v] == -1, _by_kind(kind, no)), F.lit(0.0))
        return total


def fit(counts: Iterable[tuple[str, tuple[int, ...], int]]) -> SpanModel:
    """EM, then the span classifier, over (kind, votes, number of spans). Its work depends on the number of vote patterns only."""
    counts = sorted(counts)
    weights, bias, reliability = {}, {}, {}
    for kind in sorted({k for k, *_ in counts}):
        said = np.array([v for k, v, _ in counts if k == kind]) + 1
        n = np.array([c for k, _, c in counts if k == kind], float)
        hot = np.eye(3)[said]
        q = 1 / (1 + np.exp(-1.5 * (said - 1).sum(1)))
        for _ in range(ROUNDS):
            w = np.stack([n * (1 - q), n * q])
            # smoothed, and better than chance at the start, so that classes keep their meaning
            share = np.einsum("cp,pvk->cvk", w, hot) + np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])[:, None, :]
            share /= share.sum(2, keepdims=True)
            prior = (w.sum(1) + 1) / (n.sum() + 2)
            log = np.log(prior) + np.einsum("pvk,cvk->pc", hot, np.log(share))
            q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
        for j, v in enumerate(VOTERS):
            reliability[kind, v] = share[:, j].tolist()
        x = np.concatenate([hot[:, :, 2], hot[:, :, 0], np.ones((len(n), 1))], axis=1)
        beta, weight = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(25):  # Newton steps of a ridge-penalised logistic loss
            p = 1 / (1 + np.exp(-x @ beta))
            slope = x.T @ (weight * (p - q)) + 1e-3 * beta
            curve = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(len(beta))
            beta -= np.clip(np.linalg.solve(curve, slope), -4, 4)
        for j, v in enumerate(VOTERS):
            weights[kind, v, 1], weights[kind, v, -1] = float(beta[j]), float(beta[len(VOTERS) + j])
        bias[kind] = float(beta[-1])
    return SpanModel(weights, bias, reliability)


def vote_counts(found: DataFrame) -> DataFrame:
    """(kind, labelers' votes, n) over the spans of `candidates`."""
    every = found.select(F.explode("spans").alias("s"))
    return every.groupBy("s.kind", *(F.col(f"s.votes.{v}").alias(v) for v in VOTERS)).agg(F.count("*").alias("n"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base (array of spans by kind, then start) and added (likewise) of every row.

    Null and empty texts have no spans. Repeated rows and null keys are kept, other columns ignored; an empty table gives no rows.
    """
    kept = Scratch(docs.sparkSession, "pii").keep(candidates(docs, key, text), "candidates")
    model = fit((r["kind"], tuple(r[v] for v in VOTERS), r["n"]) for r in vote_counts(kept).collect())
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    based = kept.withColumn("base", slim(F.filter("spans", lambda s: s["kind"].isin(*BASE) & s["ok"])))

    def accepted(s: Column) -> Column:
        clear = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["kind"].isin(*EXTRA) & s["ok"] & (model.score(s["kind"], s["votes"]) >= 0) & clear

    return based.select(F.col("key").alias(key), "base", slim(F.filter("spans", accepted)).alias("added"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text, of every row.

    Null and empty texts count 0 and have the hash of nothing; repeated rows and null keys are kept; other columns are ignored; an empty
    table gives no rows.
    """
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs, key, text).select(
        key, *map(of, BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans")
    )
