"""Quality scores by Bradley-Terry ranking.

A document's utility is linear in features of its text. Pairs of a labelled good and a labelled poor document say that the first is
preferred, and the weights maximise the likelihood of all such preferences: logistic loss on feature differences. The cut
between accepted and rejected is a quantile of the utilities of all learning rows: the share of them that is labelled poor.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tamis.session import Scratch

#: Labelled rows that the weights are fitted to, at most; and preference pairs drawn from them. The cut is taken over all labelled rows.
MOST_LABELLED, PAIRS = 20_000, 200_000
PENALTY, STEPS = 1e-3, 60
#: The cut moves to the widest gap between utilities within this share of ranks around the quantile, found in so many bins.
NEAR, BINS = 0.01, 512
FEATURES = (
    "length", "words", "word_length", "letters", "digits", "capitals", "spaces", "lines", "marks", "runs_of_marks", "bars", "non_ascii",
    "distinct_words", "top_word", "repeated_neighbours", "distinct_lines", "distinct_triples", "ends", "exclamations",
)
_MARKS = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]{2,}")
_CLASS = np.zeros(256, np.int8)
for _i, _set in enumerate((range(48, 58), range(65, 91), range(97, 123), (9, 11, 12, 13, 32), (10,), range(128, 256)), 1):
    _CLASS[list(_set)] = _i


def text_features(text: str | None) -> list[float]:
    """Values of FEATURES; shares lie in 0 to 1, and a text without words has 0 for all that speaks of words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    digit, upper, lower, space, line, high = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7)[1:7] / n
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x.strip()]
    count = max(1, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    top = np.bincount(ids).max() / count if words else 0.0
    same = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
    m = len(number) + 1
    triples = (ids[:-2] * m + ids[1:-1]) * m + ids[2:] if len(ids) > 2 else ids
    bars, shouts = raw.count(b"|"), raw.count(b"!")
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), min(1.0, len(raw) / count / 20), lower + upper + high, digit, upper / max(1e-9, lower + upper), space, line,
        1 - digit - upper - lower - space - line - high, min(1.0, len(_MARKS.findall(raw)) / count), min(1.0, bars / count), high,
        len(number) / count, top, same, len(set(lines)) / max(1, len(lines)), len(np.unique(triples)) / max(1, len(triples)),
        min(1.0, (raw.count(b".") + raw.count(b"?")) / count), min(1.0, shouts / count),
    ]


@F.pandas_udf(ArrayType(FloatType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(text_features(t), np.float32) for t in texts], dtype=object)


@dataclass(frozen=True)
class Ranking:
    """Utility = sum of weights * features; `cut` is the utility at which a document is as likely kept as not."""

    weights: tuple[float, ...]
    cut: float
    spread: float

    def utility(self, values: Column) -> Column:
        return sum((F.lit(w) * values[i].cast("double") for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, values: Column) -> Column:
        """0 to 1; 0.5 at the cut."""
        utility = self.utility(values)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (utility - self.cut) / self.spread))))


def fit(x: np.ndarray, label: np.ndarray, seed: int = 42, pairs: int = PAIRS) -> Ranking:
    """Weights from preference pairs between label 1 and label 0; the cut is 0. With one class only, all utilities are equal and all is kept or rejected."""
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(poor):
        return Ranking((0.0,) * len(FEATURES), -1.0 if len(good) or not len(poor) else 1.0, 1.0)
    scale = x.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    both = len(good) * len(poor)
    if both <= pairs:
        i, j = np.repeat(good, len(poor)), np.tile(poor, len(good))
    else:
        i, j = rng.choice(good, pairs), rng.choice(poor, pairs)
    d = (x[i] - x[j]) / scale
    beta = np.zeros(d.shape[1])
    for _ in range(STEPS):  # Newton steps
        p = 1 / (1 + np.exp(np.clip(d @ beta, -40, 40)))
        slope = -(d.T @ p) / len(d) + PENALTY * beta
        curve = (d.T * (p * (1 - p))) @ d / len(d) + PENALTY * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(tuple(map(float, beta / scale)), 0.0, 1.0)


def usable_labels(labels: DataFrame, learn: Column, label: str, key: str) -> DataFrame:
    """(label_key, label): one row for each key whose labels are 0 or 1 and agree; null keys don't count."""
    usable = labels.where(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key"))
    return usable.agg(F.min(F.col(label).cast("int")).alias("label"), F.max(F.col(label).cast("int")).alias("most")).where("label = most").drop("most")


def first_by_hash(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """At most so many rows, the first by a hash of `order`: the same ones wherever they lie."""
    return rows.orderBy(F.xxhash64(*order, F.lit(42)), *order).limit(most)


def learned(scored: DataFrame, labels: DataFrame, most: int) -> Ranking:
    """The ranking from (key, features) rows and (label_key, label): weights by `most` rows at most, the cut by all of them."""
    known = scored.join(labels, F.col("key") == F.col("label_key")).select("label_key", "features", "label")
    rows = first_by_hash(known, most, "label_key", "label", "features").toPandas()
    x = np.stack(rows["features"].to_numpy()).astype(float) if len(rows) else np.zeros((0, len(FEATURES)))
    y = rows["label"].to_numpy()
    order = np.lexsort((y, *x.T))  # the fit doesn't depend on the rows' order
    model = fit(x[order], y[order])
    if not any(model.weights):
        return model
    placed = known.select(model.utility(F.col("features")).alias("u"), "label")
    share = 1 - placed.agg(F.avg("label")).head()[0]
    ranks = [min(1.0, max(0.0, share + d)) for d in (-NEAR, NEAR)]
    low, high = placed.agg(F.percentile_approx("u", ranks, 10_000)).head()[0]
    if high <= low:
        return Ranking(model.weights, low, model.spread)
    binned = F.floor((F.col("u") - low) / (high - low) * BINS).cast("int").alias("bin")
    full = sorted(r["bin"] for r in placed.where(F.col("u").between(low, high)).groupBy(binned).count().collect())
    edges = list(zip(full, full[1:]))
    before, after = max(edges, key=lambda e: (e[1] - e[0], -abs(e[0] + e[1] - BINS)), default=(BINS // 2, BINS // 2))
    return Ranking(model.weights, low + (high - low) * (before + 1 + after) / 2 / BINS, model.spread)


def _measured(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    return scratch.keep(docs.select(F.col(key).alias("key"), features(F.col(text)).alias("features")), "features")


def scores(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """Key, score (0 to 1) and predicted (1 if the score is 0.5 or more) of every row; only labels where `learn` holds are used.

    Null counts as the empty text, which is scored by its features like any other. Repeated rows and null keys are kept; other
    columns are ignored. A key that is labelled both ways teaches nothing; a document key that repeats counts once for each of its
    rows. Of equal utilities at the cut all are accepted. Without usable labels every row scores above 0.5.
    """
    measured = _measured(docs, key, text, Scratch(docs.sparkSession, "quality"))
    model = learned(measured, usable_labels(labels, learn, label, key), most)
    score = model.score(F.col("features"))
    return measured.select(F.col("key").alias(key), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether a key's remainder is the one that is held out; a null key isn't."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part, F.lit(False))


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, columns: list[str], text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents that score 0.5 or more, with the columns asked for, whatever other columns are named.

    Null and empty texts, repeated rows, null keys and missing labels as in `scores`; an empty table gives no rows. Features are
    worked out once for the model, of which only the narrow table of features is kept, and once in the scan that filters: no copy of
    the texts is written.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    model = learned(_measured(docs, key, text, scratch), usable_labels(labels, learn, label, key), MOST_LABELLED)
    scratch.drop()
    return docs.where(model.score(features(F.col(text))) >= 0.5).select(*columns)
