"""Secret scans by a trigram inverted index.

A Boolean trigram query is derived from each rule's parse tree. Every block of rows becomes an index segment of its own:
posting lists of the trigrams that some query names, over lower-cased bytes. A rule's query is answered by uniting and
intersecting posting lists, and only the rows that are left are verified with the rule itself. Rules without mandatory
trigrams scan every row. Segments live in the task that reads the rows, so nothing is shuffled or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`group` of a match must have `least` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Published token formats, listed after the base rules.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9a-zA-Z]{24,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA
#: Strings that a set may hold while a query is derived; larger sets are turned into what is known of them so far.
MOST_EXACT = 64
#: Bytes of a segment that are turned into trigrams at a time.
SLICE = 1 << 22
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

Query = tuple | bool  # True: any row; ("and" | "or", *queries); ("tri", trigram as bytes)


def _both(a: Query, b: Query) -> Query:
    return b if a is True else a if b is True or a == b else ("and", a, b)


def _either(a: Query, b: Query) -> Query:
    return True if a is True or b is True else a if a == b else ("or", a, b)


def _of_strings(strings: frozenset[bytes]) -> Query:
    """That one of the strings occurs."""

    def one(s: bytes) -> Query:
        return reduce(_both, (("tri", s[i : i + 3]) for i in range(len(s) - 2)), True)

    return reduce(_either, map(one, sorted(strings)))


@dataclass(frozen=True)
class _Known:
    """What is known of a part's matches: all of them (`exact`), or their first and last bytes, and what they hold."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    query: Query


_NOTHING = frozenset({b""})
_ANY = _Known(None, _NOTHING, _NOTHING, True)


def _ends(strings: frozenset[bytes], head: bool) -> frozenset[bytes]:
    cut = frozenset(s[:2] if head else s[-2:] for s in strings)
    return cut if len(cut) <= MOST_EXACT else _NOTHING


def _exact(strings: frozenset[bytes]) -> _Known:
    if len(strings) <= MOST_EXACT:
        return _Known(strings, strings, strings, True)
    return _Known(None, _ends(strings, True), _ends(strings, False), _of_strings(strings))


def _open(k: _Known) -> _Known:
    """The same without the exact set."""
    if k.exact is None:
        return k
    return _Known(None, _ends(k.exact, True), _ends(k.exact, False), _of_strings(k.exact))


def _then(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_EXACT:
        return _exact(frozenset(map(b"".join, product(a.exact, b.exact))))
    tail, head = a.last if a.exact is None else a.exact, b.first if b.exact is None else b.exact
    over = True
    if len(tail) * len(head) <= MOST_EXACT * 4:
        over = _of_strings(frozenset(map(b"".join, product(tail, head))))
    first = frozenset(map(b"".join, product(a.exact, head))) if a.exact is not None and len(a.exact) * len(head) <= MOST_EXACT else a.first
    last = frozenset(map(b"".join, product(tail, b.exact))) if b.exact is not None and len(tail) * len(b.exact) <= MOST_EXACT else b.last
    query = _both(_both(_open(a).query, _open(b).query), over)
    return _Known(None, _ends(first, True), _ends(last, False), query)


def _or(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_EXACT:
        return _exact(a.exact | b.exact)
    a, b = _open(a), _open(b)
    return _Known(None, _ends(a.first | b.first, True), _ends(a.last | b.last, False), _either(a.query, b.query))


def _know(op: object, arg: object) -> _Known:
    fold = lambda code: chr(code).encode().translate(_LOWER)
    if op is sre.LITERAL:
        return _exact(frozenset({fold(arg)}))
    if op is sre.IN:
        found: set[bytes] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(fold(value))
            elif kind is sre.RANGE and value[1] - value[0] < 128:
                found.update(map(fold, range(value[0], value[1] + 1)))
            else:  # a category or a negated set
                return _ANY
        return _exact(frozenset(found)) if len(found) <= 8 else _ANY
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        return reduce(_or, map(_sequence, arg[1]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        part = _sequence(inner)
        if most == 1:
            return part if least else _or(part, _exact(_NOTHING))
        if not least:
            return _ANY
        part = _open(part)
        return _Known(None, part.first, part.last, part.query)
    if op is sre.AT:
        return _exact(_NOTHING)
    return _ANY  # assertions and all else say nothing


def _sequence(parsed: object) -> _Known:
    return reduce(_then, (_know(op, arg) for op, arg in parsed), _exact(_NOTHING))


def trigram_query(pattern: str) -> Query:
    """What trigrams, as lower-cased bytes, a text must hold for the pattern to match; True if none are mandatory."""
    return _open(_sequence(_parser.parse(pattern))).query


def trigrams_of(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1:]))


@lru_cache(maxsize=2)
def _numbers(trigrams: tuple[bytes, ...]) -> np.ndarray:
    """The number of each trigram, from 1, by its three bytes; made once in a worker."""
    number = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(trigrams):
        number[int.from_bytes(t, "big")] = i + 1
    return number


class Segment:
    """Posting lists of some trigrams over a block of texts; lists are sorted row numbers."""

    def __init__(self, ends: np.ndarray, raw: np.ndarray, trigrams: list[bytes]):
        number = _numbers(tuple(trigrams))
        self.rows = len(ends)
        found = []
        for at in range(0, max(0, len(raw) - 2), SLICE):
            part = np.frombuffer(raw[at : at + SLICE + 2].tobytes().translate(_LOWER), np.uint8).astype(np.uint32)
            hit = number[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            place = np.flatnonzero(hit)
            row = np.searchsorted(ends, place + at, side="right")
            inside = place + at + 2 < ends[row]
            found.append(np.unique(hit[place[inside]].astype(np.int64) * self.rows + row[inside]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(pairs, np.arange(1, len(trigrams) + 2, dtype=np.int64) * self.rows)
        self.postings = {t: pairs[cuts[i] : cuts[i + 1]] - (i + 1) * self.rows for i, t in enumerate(trigrams)}

    def answer(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if query[0] == "tri":
            return self.postings[query[1]]
        join = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(join, map(self.answer, query[1:]))


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]) -> tuple[list[tuple[int, Rule, re.Pattern, Query]], list[bytes]]:
    made = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
    return made, sorted(set().union(*(trigrams_of(q) for *_, q in made)))


def scan_block(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Sorted (start, rule number, end) of each text, in code points."""
    made, trigrams = _compiled(rules)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(texts) else np.zeros(0, np.uint8)
    segment = Segment(offsets[1:] - offsets[0], raw, trigrams)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    scanned = texts.to_pylist()
    for i, rule, pattern, query in made:
        for row in segment.answer(query).tolist():
            spans[row] += [(m.start(), i, m.end()) for m in pattern.finditer(scanned[row]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [sorted(s) for s in spans]


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<start,end,kind>> by start, then in the rules' order; null counts as the empty text, which has none."""

    @F.arrow_udf("array<struct<start:int,end:int,kind:string>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [[{"start": a, "end": b, "kind": rules[i].kind} for a, i, b in s] for s in scan_block(texts, rules)]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))

    return found(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Key and spans of every row. Null and empty texts have no spans; repeated rows and null keys are kept; other columns
    are ignored; an empty table gives no rows."""
    return docs.select(F.col(key).alias(key), find_spans(F.col(text), rules).alias("spans"))


def redact(docs: DataFrame, columns: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns asked for, each secret of `text` replaced by its kind in square brackets; overlapping spans become one,
    named by the first. Texts without secrets, and null texts, are unchanged."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, scan_block(pa.array(texts, pa.large_string(), from_pandas=True), rules)):
            pieces, at = [], 0
            for start, i, end in spans:
                if start >= at:
                    pieces += [t[at:start], f"[{rules[i].kind}]"]
                at = max(at, end)
            out.append(t if not spans else "".join([*pieces, t[at:]]))
        return pd.Series(out, dtype=object)

    return docs.select(*(clean(F.col(c)).alias(c) if c == text else F.col(c) for c in columns))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text, of every row.

    Null and empty texts count 0 and have the hash of nothing; repeated rows and null keys are kept; other columns are ignored; an empty
    table gives no rows.
    """
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return scan(docs, key, text).select(
        key, *(of(r.kind) for r in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
