"""Toxicity by weak supervision.

Many voters look at a text: one for each word of general lexicons, one for each word beginning that the labelled learning rows
show to be an insult of their own, and patterns over both. A generative label model estimates each voter's
accuracy and the voters' correlations by expectation-maximisation over all texts: labelled learning rows are drawn to
their labels, all others get a posterior by what the voters say. A voter that repeats others counts for less. A linear classifier is
trained on the posteriors, in which a label weighs as much as the voters together, and scores every text. Both models see the texts as a table of
patterns, what the voters say and how many texts it is said of; a round is one pass over that table, whose tasks return sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.quality import first_by_hash, usable_labels
from tamis.session import Scratch

#: Labelled rows that the models are fitted to, at most; others count as rows without a label.
MOST_LABELLED = 20_000
#: Steps of a voter's value from 0 to 1 in patterns, and tasks of a pass over them at most.
LEVELS, TASKS = 8, 16
#: How much of a labelled row's posterior is its label, as labels may err too.
GOLD = 0.5
ROUNDS, STEPS, PENALTY = 40, 60, 1e-4
#: General lexicons of insults by language; each word is a voter.
LEXICONS = {
    "en": "idiot moron stupid dumb fool imbecile loser pathetic worthless disgusting scum trash garbage clown filth vermin coward liar ugly "
    "freak creep jerk bastard bitch asshole shit fuck fucking whore slut retard retarded psycho lunatic useless ignorant "
    "brainless degenerate parasite leech rotten nasty hideous despicable repulsive",
    "de": "idiot dumm blöd trottel depp arschloch scheisse scheiße abschaum wertlos ekelhaft versager hure schlampe wichser dreckig hässlich lügner feigling parasit",
    "fr": "idiot imbécile connard connasse salaud salope merde putain crétin débile minable ordure dégoûtant pathétique stupide abruti menteur lâche raclure",
    "es": "idiota imbécil estúpido estúpida tonto pendejo cabrón mierda puta basura asqueroso inútil patético perdedor escoria cobarde mentiroso payaso maldito",
}
WORDS = tuple(dict.fromkeys(" ".join(LEXICONS.values()).split()))
#: Words that make an insult an address.
SECOND_PERSON = frozenset("you your youre u ur du dein deine ihr euch tu ton ta vous votre tú tu eres usted".split())
PATTERNS = ("two_hits", "three_words", "dense", "very_dense", "addressed", "neighbours")
#: Lengths of word beginnings that may become voters; how many may, and how sure their odds must be (standard errors, least log-odds).
BEGINNINGS, MOST_MINED, ERRORS, LEAST_ODDS = range(4, 9), 256, 2.0, math.log(3)
#: Letters as they are, A-Z made small, all other ASCII characters as spaces; other characters are left to str.lower.
_PLAIN = {i: (chr(i).lower() if chr(i).isalpha() else " ") for i in range(128)}


def plain_words(text: str | None) -> list[str]:
    text = text or ""
    words = text.translate(_PLAIN)
    return (words if text.isascii() else words.lower()).split()


def repeated_beginnings(words: list[str]) -> set[str]:
    """Word beginnings that a text holds twice, or in a hundredth of its words."""
    count = Counter(w[:k] for w in words for k in BEGINNINGS if len(w) >= k)
    least = min(2, max(1, len(words) // 100 + 1))
    return {b for b, c in count.items() if c >= least}


class Voters:
    """Lexicon words, mined beginnings and patterns, numbered in this order."""

    def __init__(self, mined: tuple[str, ...]):
        self.size = len(WORDS) + len(mined) + len(PATTERNS)
        self.words = {w: i for i, w in enumerate(WORDS)}
        self.mined = {b: len(WORDS) + i for i, b in enumerate(mined)}
        self.first = {w[:4] for w in (*WORDS, *mined)}

    def numbers(self, word: str) -> list[int]:
        own = [self.mined[word[:k]] for k in BEGINNINGS if word[:k] in self.mined and len(word) >= k]
        return [self.words[word], *own] if word in self.words else own

    def features(self, text: str | None) -> np.ndarray:
        """How strongly each voter speaks: the root of its hits in a hundred words, 1 at most, or 0 or 1 of a pattern. No words: all 0."""
        words, first = plain_words(text), self.first
        out = np.zeros(self.size, np.float32)
        near = [at for at, w in enumerate(words) if w[:4] in first]
        found = [(at, own) for at in near if (own := self.numbers(words[at]))]
        if not found:
            return out
        for _, own in found:
            out[own] += 1
        out = np.minimum(1, np.sqrt(out * 100 / max(100, len(words)), dtype=np.float32))
        share, places = len(found) / len(words), [at for at, _ in found]
        out[-len(PATTERNS) :] = (
            len(found) >= 2, len({words[at] for at in places}) >= 3, share >= 0.003, share >= 0.01,
            any(SECOND_PERSON.intersection(words[max(0, at - 3) : at + 4]) for at in places),
            any(b - a <= 2 for a, b in zip(places, places[1:])),
        )
        return out


@lru_cache(maxsize=4)
def _voters(mined: tuple[str, ...]) -> Voters:
    return Voters(mined)


def features(text: Column, mined: tuple[str, ...]) -> Column:
    """array<struct<voter,value>> of the voters that speak."""

    @F.pandas_udf("struct<voter:array<smallint>,value:array<float>>")
    def spoken(texts: pd.Series) -> pd.DataFrame:
        voters = _voters(mined)
        rows = [voters.features(t) for t in texts]
        said = [np.flatnonzero(r).astype(np.int16) for r in rows]
        return pd.DataFrame({"voter": said, "value": [r[i] for r, i in zip(rows, said)]})

    return spoken(text)


def mine(texts: DataFrame) -> tuple[str, ...]:
    """Beginnings whose odds to be repeated in texts of label 1, against label 0, are surely high; from (text, label) rows."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter[tuple[str, int]] = Counter()
            for text, label in zip(batch["text"], batch["label"]):
                count.update((b, label) for b in {"", *repeated_beginnings(plain_words(text))})
            yield pd.DataFrame([(b, c * (label == 1), c * (label == 0)) for (b, label), c in count.items()], columns=["beginning", "toxic", "clean"])

    total = texts.mapInPandas(counts, "beginning string, toxic long, clean long").groupBy("beginning").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = total.where((F.col("toxic") >= 3) | (F.col("beginning") == ""))
    whole = total.where(F.col("beginning") == "").head()
    if whole is None:
        return ()
    odds = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (whole["clean"] + 1))
    sure = odds - ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = total.where(F.col("beginning") != "").withColumn("sure", sure).where(F.col("sure") >= LEAST_ODDS)
    return tuple(r["beginning"] for r in best.orderBy(F.desc("sure"), "beginning").limit(MOST_MINED).collect())


@dataclass(frozen=True)
class LabelModel:
    """P(voter speaks | class), the class prior, and each voter's weight after its correlations."""

    speaks: np.ndarray
    prior: float
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        p, share = self.speaks, self.share
        said = votes * share * (np.log(p[1]) - np.log(p[0]))
        silent = (1 - votes) * share * (np.log1p(-p[1]) - np.log1p(-p[0]))
        log = math.log(self.prior / (1 - self.prior)) + (said + silent).sum(1)
        return 1 / (1 + np.exp(np.clip(-log, -40, 40)))


#: Sums over the rows of a table of what a function of (features, labels, numbers of texts) returns for a part of them.
Total = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]], list[np.ndarray]]


def held(x: np.ndarray, label: np.ndarray, times: np.ndarray | None = None) -> Total:
    """Sums over a table that is held as arrays."""
    n = np.ones(len(label)) if times is None else times
    return lambda part: part(x, label, n)


def believed(model: LabelModel | None, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Probability of class 1 by the votes and, where there is one (0 or 1; -1 is none), the label; before the first model, some doubt for who is voted for."""
    votes = (x > 0).astype(float)
    if model is None:
        return np.where(label >= 0, label, np.minimum(votes.sum(1), 1) * 0.9 + 0.05).astype(float)
    q = model.posterior(votes)
    return np.where(label >= 0, GOLD * label + (1 - GOLD) * q, q)


def label_model(total: Total) -> LabelModel:
    """EM. A voter's share is 1 over 1 plus its correlations, within classes, with the other voters: copies of one signal share one vote."""

    def both(x: np.ndarray, label: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        votes = (x > 0).astype(float)
        return [(votes.T * n) @ votes]

    def round_(model: LabelModel | None):
        def sums(x: np.ndarray, label: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
            q = believed(model, x, label)
            weight = np.stack([n * (1 - q), n * q])
            return [weight @ (x > 0), np.array([*weight.sum(1), (n * q * q).sum(), (n * q * (1 - q)).sum(), (n * (1 - q) ** 2).sum()])]

        return sums

    together, model = total(both)[0], None
    for _ in range(ROUNDS):
        said, (none, some, qq, qr, rr) = total(round_(model))
        p = np.clip((said + np.array([[0.05], [0.5]])) / (np.array([[none], [some]]) + 1), 1e-5, 1 - 1e-5)
        # sums of (vote - expected)(vote - expected)' from those of votes, with expected = q p1 + (1 - q) p0
        cross = np.outer(said[1], p[1]) + np.outer(said[0], p[0])
        mixed = np.outer(p[1], p[0])
        cov = (together - cross - cross.T + qq * np.outer(p[1], p[1]) + qr * (mixed + mixed.T) + rr * np.outer(p[0], p[0])) / (none + some)
        spread = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
        corr = np.clip(cov / spread[:, None] / spread, 0, 1)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
        new = LabelModel(p, float(np.clip(some / (none + some), 1e-4, 1 - 1e-4)), share)
        done = model is not None and np.abs(new.speaks - model.speaks).max() < 1e-5 and abs(new.prior - model.prior) < 1e-5
        model = new
        if done:
            break
    return model


@dataclass(frozen=True)
class Linear:
    weights: tuple[float, ...]
    bias: float

    def score(self, said: Column) -> Column:
        """0 to 1; a row that no voter speaks on has the bias alone."""
        weight = F.array(*map(F.lit, self.weights))
        each = F.zip_with(said["voter"], said["value"], lambda i, v: F.element_at(weight, i + F.lit(1)) * v.cast("double"))
        total = F.lit(self.bias) + F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), total))))


def train(total: Total, voters: int, target: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Linear:
    """Ridge-penalised logistic regression on the soft targets of rows."""
    beta = np.zeros(voters + 1)
    keep = PENALTY * np.ones(len(beta))
    keep[-1] = 1e-9

    def slopes(beta: np.ndarray):
        def sums(x: np.ndarray, label: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
            full = np.column_stack([x, np.ones(len(x))])
            p = 1 / (1 + np.exp(np.clip(-full @ beta, -40, 40)))
            return [full.T @ (n * (p - target(x, label))), (full.T * (n * p * (1 - p))) @ full, np.array([n.sum()])]

        return sums

    for _ in range(STEPS):
        slope, curve, n = total(slopes(beta))
        step = np.clip(np.linalg.solve(curve / n + np.diag(keep + 1e-6), slope / n + keep * beta), -2, 2)
        beta = beta - step
        if np.abs(step).max() < 1e-5:
            break
    return Linear(tuple(map(float, beta[:-1])), float(beta[-1]))


def fit(total: Total, voters: int) -> Linear:
    """Label model, then classifier on what it believes of each row."""
    model = label_model(total)
    return train(total, voters, lambda x, label: believed(model, x, label))


def patterns(said: DataFrame) -> DataFrame:
    """(voter, value, label, times) of (voter, value, label) rows: values in LEVELS steps, one at least, so that most texts fall together."""
    level = F.transform("value", lambda v: F.greatest(F.lit(1), F.round(v * LEVELS)).cast("tinyint"))
    return said.select("voter", level.alias("value"), F.col("label").cast("tinyint").alias("label")).groupBy("voter", "value", "label").agg(F.count("*").alias("times"))


def spread_over(table: DataFrame, voters: int) -> Total:
    """Sums over a table of patterns, whatever its size: each task returns one row of numbers, at most TASKS of them reach the driver."""
    table = table.coalesce(TASKS)

    def total(part: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole: list[np.ndarray] | None = None
            for frame in frames:
                for at in range(0, len(frame), 8192):
                    rows = frame.iloc[at : at + 8192]
                    x = np.zeros((len(rows), voters))
                    sizes = rows["voter"].map(len).to_numpy()
                    if sizes.sum():
                        line = np.repeat(np.arange(len(rows)), sizes)
                        x[line, np.concatenate(rows["voter"].to_list()).astype(int)] = np.concatenate(rows["value"].to_list()).astype(float) / LEVELS
                    own = part(x, rows["label"].to_numpy(int), rows["times"].to_numpy(float))
                    whole = own if whole is None else [a + b for a, b in zip(whole, own)]
            if whole is not None:
                yield pd.DataFrame({"sums": [[a.ravel().tolist() for a in whole]], "shapes": [[list(a.shape) for a in whole]]})

        found = table.mapInPandas(sums, "sums array<array<double>>, shapes array<array<int>>").collect()
        each = [[np.array(a).reshape(shape) for a, shape in zip(r["sums"], r["shapes"])] for r in found]
        return [sum(parts[1:], parts[0]) for parts in zip(*each)]

    return total


def scores(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELLED, threshold: float = 0.3) -> DataFrame:
    """Key, score (0 to 1) and predicted (1 if the score is at least the threshold) of every row; only labels where `learn` holds are used.

    Null counts as the empty text, on which no voter speaks; texts of equal votes score alike. Repeated rows and null keys are kept; other
    columns are ignored. A key that is labelled both ways teaches nothing. The labelled sample is the first rows by a hash of the key; all other rows teach
    the label model by what the voters say. Without any row the voters alone decide. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = usable_labels(labels, learn, label, key)
    sample = F.broadcast(scratch.keep(first_by_hash(usable, most, "label_key", "label"), "sample"))  # `most` rows at most
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    mined = mine(base.join(sample, F.col("key") == F.col("label_key")).select("text", "label"))
    measured = scratch.keep(base.select("key", features(F.col("text"), mined).alias("said")), "features")
    known = measured.join(sample, F.col("key") == F.col("label_key"), "left").select("key", "said.voter", "said.value", F.coalesce("label", F.lit(-1)).alias("label"))
    voters, table = _voters(mined).size, scratch.keep(patterns(known), "patterns")
    model = Linear((2.0,) * voters, -3.0) if table.isEmpty() else fit(spread_over(table, voters), voters)
    score = model.score(F.col("said"))
    return measured.select(F.col("key").alias(key), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
