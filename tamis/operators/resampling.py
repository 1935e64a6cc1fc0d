"""Intervals by resampling what lies inside what: units within strata, sampling seeds within training seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import hash_unit
from tamis.operators.ordered import placed
from tamis.session import Scratch


def _pick(n: Column, *parts: Column) -> Column:
    """One of n places from 0 by a hash."""
    return F.least(F.floor(hash_unit(*parts) * n).cast("int"), n.cast("int") - 1)


def unit_weights(units: DataFrame, n: int, seed: str) -> DataFrame:
    """(replicate, stratum, place, weight) of units (stratum, place from 1, rows): how often each is drawn, in shares of the stratum. In every
    replicate a stratum is drawn from as often as it has units, so strata keep their sizes; a unit that isn't drawn has no row."""
    slots = units.select("stratum", "rows", F.col("place").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    drawn = _pick(F.col("rows"), F.lit(seed), F.col("replicate"), F.col("stratum"), F.col("slot"))
    each = slots.select("replicate", "stratum", "rows", (drawn + 1).cast("long").alias("place"))
    return each.groupBy("replicate", "stratum", "place").agg((F.count("*") / F.max("rows")).alias("weight"))


def run_weights(runs: DataFrame, n: int, seed: str) -> DataFrame:
    """(replicate, arm, train, seed, weight) of runs (arm, train, seed): training seeds are drawn within an arm, and for each draw sampling seeds within the
    training seed that was drawn, as many as there are."""
    of_train = runs.groupBy("arm", "train").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    of_arm = of_train.groupBy("arm").agg(F.array_sort(F.collect_list(F.struct("train", "seeds"))).alias("trains"))  # an experiment's runs: some dozens
    each = of_arm.select("arm", "trains", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    slot = each.select("arm", "trains", "replicate", F.explode(F.sequence(F.lit(0), F.size("trains") - 1)).alias("slot"))
    train = F.get("trains", _pick(F.size("trains"), F.lit(seed), F.col("replicate"), F.col("arm"), F.col("slot")))
    drawn = slot.select("arm", "replicate", "slot", train.alias("t"))
    inner = drawn.select("arm", "replicate", "slot", "t", F.explode(F.sequence(F.lit(0), F.size("t.seeds") - 1)).alias("k"))
    picked = F.get("t.seeds", _pick(F.size("t.seeds"), F.lit(seed), F.col("replicate"), F.col("arm"), F.col("slot"), F.col("k")))
    by = inner.groupBy("replicate", "arm", F.col("t.train").alias("train"), picked.alias("seed")).agg(F.count("*").alias("n"))
    whole = by.groupBy(F.col("replicate").alias("r_"), F.col("arm").alias("a_")).agg(F.sum("n").alias("picks"))
    out = by.join(whole, (F.col("replicate") == F.col("r_")) & (F.col("arm") == F.col("a_")))
    return out.select("replicate", "arm", "train", "seed", (F.col("n") / F.col("picks")).alias("weight"))


def nested_difference(scores: DataFrame, a: str, b: str, n: int, seed: str) -> DataFrame:
    """(units, point, low, high) in percent: arm a's score less arm b's, and its 95 % percentile interval over n replicates.

    Scores have arm, train, seed, stratum, unit and score, one row each. A run's score is the mean over strata of the means of their
    units; an arm's is the mean over training seeds of the means over their runs. A replicate draws units within each stratum, the same
    ones for every run of both arms, and runs by `run_weights`. Units that some run of the two arms lacks, or has without a score, take no
    part; without units or without an arm all but `units` is null.
    """
    scratch = Scratch(scores.sparkSession, "nested")
    own = scratch.keep(scores.where(F.col("arm").isin(a, b)).select("arm", "train", "seed", "stratum", "unit", F.col("score").cast("double").alias("score")), "scores")
    runs = own.select("arm", "train", "seed").distinct()
    many = runs.count()
    full = own.where("score is not null").groupBy("stratum", "unit").agg(F.count("*").alias("n")).where(F.col("n") == many).select("stratum", "unit")
    units = scratch.keep(placed(full, "stratum", [F.col("unit")]), "units")
    strata = max(1, units.select("stratum").distinct().count())
    kept = scratch.keep(own.join(units, ["stratum", "unit"]).select("arm", "train", "seed", "stratum", "place", "rows", "score"), "kept")
    mean = kept.groupBy("arm", "train", "seed").agg((F.sum(F.col("score") / F.col("rows")) / strata).alias("score"))
    arm = mean.groupBy("arm", "train").agg(F.avg("score").alias("score")).groupBy("arm").agg(F.avg("score").alias("score"))
    sign = F.when(F.col("arm") == a, 100.0).otherwise(-100.0)
    point = arm.agg(F.when(F.count("*") == 2, F.sum(F.col("score") * sign)).alias("point"))
    drawn = unit_weights(units.select("stratum", "place", "rows"), n, seed).join(kept.select("arm", "train", "seed", "stratum", "place", "score"), ["stratum", "place"])
    by_run = drawn.groupBy("replicate", "arm", "train", "seed").agg((F.sum(F.col("weight") * F.col("score")) / strata).alias("score"))
    both = by_run.join(run_weights(runs, n, seed), ["replicate", "arm", "train", "seed"])
    # differences are rounded before they are ordered, so that sums in another order give the same interval
    gaps = both.groupBy("replicate").agg(F.when(F.countDistinct("arm") == 2, F.round(F.sum(F.col("weight") * F.col("score") * sign), 9)).alias("gap"))
    line = gaps.agg(F.array_sort(F.collect_list("gap")).alias("gaps"))  # n numbers, a parameter
    at = lambda share: F.get("gaps", F.least(F.lit(n - 1), F.lit(int(share * n))))
    ends = line.select(F.lit(units.count()).cast("long").alias("units"), at(0.025).alias("low"), at(0.975).alias("high"), F.lit(0).alias("one"))
    return ends.join(point.select(F.round("point", 9).alias("point"), F.lit(0).alias("one")), "one").select("units", "point", "low", "high")
