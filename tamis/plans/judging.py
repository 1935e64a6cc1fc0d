"""Votes, judges, banks of items, scores and their statistics. Judges, cells and scores that the tables lack are planted by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T
from tamis.operators import ordered, phrases, planning

#: Bars of scores (inclusive), headroom, re-anchoring and the largest base rate of a rule.
BAR, FLOOR, CEILING, STEP, LEAST, MOST_RATE = 0.80, 0.05, 0.95, 0.05, 0.60, 0.30
#: Cumulative probabilities of a Poisson variable of mean 1, for resampling by weights; beyond eight the rest is under 1e-6.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9))
REPLICATES = 200


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _unit(*parts: Column) -> Column:
    return T.hash_unit(*parts)


def slot_coverage(spark, d):
    """Of each order priority the orders, the customers that have any, the busiest customer's share and the share that ordered once."""
    each = _t(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    whole = each.groupBy("o_orderpriority").agg(F.sum("n").alias("orders"), F.count("*").alias("customers"), F.max("n").alias("top"), F.count_if(F.col("n") == 1).alias("once"))
    return whole.select("o_orderpriority", "orders", "customers", F.round(F.col("top") / F.col("orders"), 9).alias("top_share"), F.round(F.col("once") / F.col("customers"), 9).alias("once_share"))


def label_yield(spark, d):
    """Labelled documents by source and language: attempts, accepted (good and not toxic), and their share, with subtotals."""
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    tally = rows.rollup("source", "lang").agg(F.count("*").alias("attempts"), F.count_if(good).alias("accepted"))
    return tally.withColumn("share", F.round(F.col("accepted") / F.col("attempts"), 9))


def label_disagreement(spark, d):
    """Two labels as judges of one source's documents: judged and dropped by judge, and how often one alone drops."""
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    a, b = F.col("quality") == 0, F.col("toxic") == 1
    return rows.groupBy("source").agg(F.count("*").alias("judged"), F.count_if(a).alias("quality_drops"), F.count_if(b).alias("toxic_drops"), F.count_if(a != b).alias("one_alone"))


def author_shares(spark, d):
    """Share of each source in the documents that are kept."""
    kept = _t(spark, d, "documents").where(T.hygiene_reason(F.col("text")).isNull()).groupBy("source").agg(F.count("*").alias("n"))
    return kept.select("source", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))  # a row for each source


def bits_per_byte(spark, d):
    """Planted losses in bits over bytes, by language and over all: sums before the division, not a mean of ratios."""
    nll = F.size(T.words(F.col("text"))) * 3 + F.col("doc_id") % 7
    docs = _t(spark, d, "documents").select("lang", nll.alias("nll"), F.octet_length("text").alias("b"))
    total = docs.rollup("lang").agg(F.sum("nll").cast("long").alias("nll"), F.sum("b").cast("long").alias("bytes"))
    return total.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.round(F.col("nll") / F.lit(math.log(2)) / F.col("bytes"), 9).alias("bpb"))


def _scores(spark, d) -> DataFrame:
    """Nations as models, order priorities as families: the share of finished orders; a model may lack a family."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.where("(c_nationkey + cast(left(o_orderpriority, 1) as int)) % 11 > 0").groupBy(F.col("c_nationkey").alias("model"), F.col("o_orderpriority").alias("family")).agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("score"))


def composites(spark, d):
    """A hundred times the mean of a model's family scores, null if one of the five is missing, and whether all reach the bar."""
    whole = _scores(spark, d).groupBy("model").agg(F.count("*").alias("k"), F.avg("score").alias("m"), F.every(F.col("score") >= 0.4).alias("all_met"))
    full = F.col("k") == 5
    return whole.select("model", F.when(full, F.round(100 * F.col("m"), 6)).alias("composite"), (full & F.col("all_met")).alias("met"))


def headroom(spark, d):
    """Families whose scores leave no room: all models at the floor, or all at the ceiling."""
    by = _scores(spark, d).groupBy("family").agg(F.max("score").alias("most"), F.min("score").alias("least"), F.count("*").alias("models"))
    return by.select("family", "models", F.when(F.col("most") <= 0.5, "floor").when(F.col("least") >= 0.45, "ceiling").alias("reason"))


def reanchored(spark, d):
    """Each family's bar: kept if the mean reaches it, at the floor if below that, else the step below the mean."""
    by = _scores(spark, d).groupBy("family").agg(F.round(F.avg("score") + 0.2, 9).alias("rate"))
    down = F.round(F.greatest(F.lit(LEAST), F.floor(F.round(F.col("rate") / STEP, 9)) * STEP), 2)
    bar = F.when(F.col("rate") >= BAR, F.lit(BAR)).when(F.col("rate") < LEAST, F.lit(LEAST)).otherwise(down)
    return by.select("family", bar.alias("bar"), F.when(F.col("rate") >= BAR, "kept").when(F.col("rate") < LEAST, "floor").otherwise("re-anchored").alias("rule"))


RULES = {"digit": "[0-9]", "question": r"\?\s*$", "long_word": "[A-Za-z]{14,}", "newline": "\n", "capital_start": "^[A-Z]"}


def base_rates(spark, d):
    """Of each rule the share of a role's turns that it holds on, and whether a rate above the bound for any role drops the rule."""
    turns = _t(spark, d, "conversations").select("role", F.coalesce("text", F.lit("")).alias("t"))
    holds = F.array(*(F.struct(F.lit(n).alias("rule"), F.col("t").rlike(p).alias("hit")) for n, p in RULES.items()))
    rates = turns.select("role", F.explode(holds).alias("h")).groupBy("h.rule", "role").agg(F.round(F.avg(F.col("h.hit").cast("int")), 9).alias("rate"))
    drop = rates.groupBy("rule").agg((F.max("rate") > MOST_RATE).alias("dropped"))
    return rates.join(drop, "rule")


def phrase_gains(spark, d):
    """The 50 phrases of two to four words that a vocabulary would gain most by: fewer units times occurrences, ties by the phrase."""
    return phrases.heaviest(_t(spark, d, "documents"), (2, 3, 4), 50)


def unseen_words(spark, d):
    """The 20 longest benchmark words that no document has, ties by the word."""
    words = lambda name: _t(spark, d, name).select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct()
    return words("benchmark").join(words("documents"), "word", "left_anti").select("word", F.octet_length("word").alias("bytes")).orderBy(F.desc("bytes"), "word").limit(20)


def name_profiles(spark, d):
    """Of each customer nation: orders by era, the era of the highest rate among that era's orders, and the nation's rank in it."""
    era = F.when(F.year("o_orderdate") < 1994, "a").when(F.year("o_orderdate") < 1996, "b").otherwise("c")
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", era.alias("era")).agg(F.count("*").alias("n"))
    rated = rows.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("era")), 12))
    top = rated.groupBy("c_nationkey").agg(F.sum("n").alias("orders"), F.max(F.struct("rate", "era"))["era"].alias("era"))
    return top.withColumn("place", F.row_number().over(Window.partitionBy("era").orderBy(F.desc("orders"), "c_nationkey")))


def pos_votes(spark, d):
    """A word class by votes: of each part's planted teachers and a proxy, the class with two votes or more, else amb; pending without votes."""
    key = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("noun", "verb", "adj", "unk")))
    at = lambda m: F.element_at(kinds, (F.pmod(F.floor(_unit(F.lit(m), key) * 97), F.lit(4)) + 1).cast("int"))
    votes = F.filter(F.array(*(F.when(key % m > 0, at(m)) for m in (2, 3, 5))), lambda v: v.isNotNull())
    rows = _t(spark, d, "part").select("p_partkey", votes.alias("votes"), at(7).alias("proxy"))
    every = rows.select("p_partkey", "proxy", F.size("votes").alias("n"), F.explode_outer(F.concat("votes", F.when(F.col("proxy") != "unk", F.array("proxy")).otherwise(F.array().cast("array<string>")))).alias("v"))
    counted = every.groupBy("p_partkey", "proxy", "n", "v").agg(F.count("v").alias("c"))
    best = counted.groupBy("p_partkey", "proxy", "n").agg(F.max("c").alias("most"), F.max(F.struct("c", "v"))["v"].alias("v"))
    none, sure = F.col("n") == 0, F.col("most") >= 2
    return best.select("p_partkey", F.when(none, F.col("proxy")).when(sure, F.col("v")).otherwise("amb").alias("pos"), F.when(none, "pending").when(sure, "confirmed").otherwise("amb").alias("status"))


def _judgements(spark, d) -> DataFrame:
    """Lines of orders as judgements of an item: the order is the item, the supplier's number gives the judge, the part's the verdict."""
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("at"), (F.col("l_suppkey") % 4).alias("judge"), (F.col("l_orderkey") % 5).alias("author"), (F.col("l_partkey") % 3 > 0).alias("keep"))


def first_judgements(spark, d):
    """The first judgement of each item by each judge; a repeat doesn't count, and of two at one place a drop does."""
    first = F.min(F.struct("at", "keep"))
    return _judgements(spark, d).groupBy("item", "judge").agg(first["at"].alias("at"), first["keep"].alias("keep"))


def two_judge_rule(spark, d):
    """Items by the rule of exactly two judges that aren't the author: kept if both keep, else why not."""
    rows = _judgements(spark, d)
    by = rows.groupBy("item").agg(F.count("*").alias("n"), F.countDistinct("judge").alias("k"), F.some(F.col("judge") == F.col("author")).alias("own"), F.some(F.col("judge") == 3).alias("loose"), F.every("keep").alias("all_keep"))
    missing = (F.col("n") != 2) | (F.col("k") != 2) | F.col("own")
    status = F.when(missing, "JUDGE_MISSING").when(F.col("loose"), "JUDGE_NOT_PINNED").when(F.col("all_keep"), "kept").otherwise("JUDGE_DROP")
    return by.groupBy(status.alias("status")).agg(F.count("*").alias("items"))


def checklist_pass(spark, d):
    """Orders whose lines all pass (shipped full, nothing sent back) with none added later; the first complete check counts."""
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.every(F.col("l_linestatus") == "F").alias("points"), F.every(F.col("l_returnflag") != "R").alias("clean"), F.count("*").alias("lines"))
    return rows.groupBy((F.col("points") & F.col("clean")).alias("passed")).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))


def bank_winners(spark, d):
    """Of each bank (part brand) the first kept item by a seeded hash; all other kept ones are dropped with a code."""
    rows = _t(spark, d, "part").where("p_size > 10").select("p_brand", "p_partkey", F.sha2(F.concat(F.lit("w-1:"), F.col("p_partkey").cast("string")).cast("binary"), 256).alias("h"))
    first = rows.groupBy("p_brand").agg(F.min(F.struct("h", "p_partkey"))["p_partkey"].alias("winner"), F.count("*").alias("kept"))
    return first.select("p_brand", "winner", (F.col("kept") - 1).alias("dropped"))


def registry_problems(spark, d):
    """Suppliers by what their entry breaks, all codes in order; entries without a fault are listed as ok."""
    tests = {"NAME": ~F.col("s_name").rlike("^Supplier#[0-9]+$"), "NATION": ~F.col("s_nationkey").between(0, 24), "NEGATIVE": F.col("s_acctbal") < 0, "ROUND": F.round(F.col("s_acctbal") * 100) % 10 == 0}
    codes = F.array_compact(F.array(*(F.when(t, F.lit(c)) for c, t in tests.items())))
    return _t(spark, d, "supplier").groupBy(F.coalesce(F.nullif(F.array_join(codes, ","), F.lit("")), F.lit("ok")).alias("codes")).agg(F.count("*").alias("entries"))


def filtered_listing(spark, d):
    """Parts of brands like Brand#1? of some sizes: how many, and their price."""
    rows = _t(spark, d, "part").where(F.col("p_brand").like("Brand#1_") & F.col("p_size").isin(1, 5, 9, 20, 33))
    return rows.groupBy("p_brand").agg(F.count("*").alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def bank_manifest(spark, d):
    """By source: kept documents, drops by code, and the share that is kept."""
    code = T.hygiene_reason(F.col("text"))
    rows = _t(spark, d, "documents").select("source", code.alias("code"))
    by = rows.groupBy("source", "code").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.concat_ws(":", "code", F.col("n").cast("string")))))
    return by.groupBy("source").agg(F.sum(F.when(F.col("code").isNull(), F.col("n")).otherwise(0)).alias("kept"), F.array_join(listed, ",").alias("drops"))


def separation(spark, d):
    """What benchmark items of odd and even number share: words, runs of three words, and whole texts."""
    rows = _t(spark, d, "benchmark").select((F.col("item_id") % 2 == 0).alias("even"), "text", T.words(F.col("text")).alias("w"))
    kinds = {"words": F.array_distinct("w"), "runs": F.array_distinct(G.grams(F.col("w"), 3)), "texts": F.array("text")}
    each = rows.select("even", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("values")) for k, v in kinds.items()))).alias("e"))
    flat = each.select("even", "e.kind", F.explode_outer("e.values").alias("v")).where("v is not null")
    sides = flat.groupBy("kind", "v").agg(F.countDistinct("even").alias("sides"))
    return sides.groupBy("kind").agg(F.count_if(F.col("sides") == 2).alias("shared"), F.count("*").alias("values"))


def seed_order(spark, d):
    """The 40 documents that come first by a seeded hash, in that order."""
    h = F.sha2(F.concat(F.lit("seed-9|"), F.col("doc_id").cast("string")).cast("binary"), 256)
    first = _t(spark, d, "documents").select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(40)
    return first.select("doc_id", F.row_number().over(Window.orderBy("h", "doc_id")).alias("place"))  # forty rows


def answer_margins(spark, d):
    """Orders as questions, lines as candidates, the first line as the right one: whether its score is strictly best, and by how much."""
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, price)).alias("gold"), F.max(F.when(F.col("l_linenumber") > 1, price)).alias("other"))
    return rows.select("l_orderkey", F.coalesce(F.col("gold") > F.col("other"), F.lit(False)).alias("right"), (F.col("gold") - F.col("other")).alias("margin"))


def model_comparison(spark, d):
    """Two models (price and quantity) on the same orders: accuracy of each on the lines both have, and the accuracy of guessing."""
    lines = _t(spark, d, "lineitem").where("l_orderkey % 7 > 0")
    of = lambda c, gold: F.max(F.when((F.col("l_linenumber") == 1) == F.lit(gold), F.round(F.col(c) * 100).cast("long")))
    rows = lines.groupBy("l_orderkey").agg(of("l_extendedprice", True).alias("ga"), of("l_extendedprice", False).alias("oa"), of("l_quantity", True).alias("gb"), of("l_quantity", False).alias("ob"), F.count("*").alias("n")).where("oa is not null and ga is not null")
    keyed = rows.join(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    mean = lambda c: F.round(F.avg(c.cast("double")), 9)
    a, b = (F.col("ga") > F.col("oa")).cast("int"), (F.col("gb") > F.col("ob")).cast("int")
    return keyed.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"), mean(a).alias("acc_a"), mean(b).alias("acc_b"), mean(1 / F.col("n")).alias("chance"))


def contrast_readings(spark, d):
    """Each priority against the lowest one, paired by nation: BETTER or WORSE if all pairs agree and the mean is clear, EQUAL if it is surely small."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    base = rows.where("o_orderpriority = '5-LOW'").select("c_nationkey", F.col("m").alias("base"))
    pairs = rows.where("o_orderpriority <> '5-LOW'").join(base, "c_nationkey").withColumn("diff", F.col("m") - F.col("base"))
    by = pairs.groupBy("o_orderpriority").agg(F.count("*").alias("k"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"), F.every(F.col("diff") < 0).alias("down"), F.every(F.col("diff") > 0).alias("up"), F.avg("base").alias("level"))
    clear = 2.06 * F.col("sd") / F.sqrt("k")
    label = F.when((-F.col("mean") > clear) & F.col("down"), "BETTER").when((F.col("mean") > clear) & F.col("up"), "WORSE").when(F.abs("mean") + clear < 0.1 * F.col("level"), "EQUAL").otherwise("UNRESOLVED")
    return by.select("o_orderpriority", "k", F.round("mean", 3).alias("mean"), label.alias("reading"))


def sign_agreement(spark, d):
    """Of all pairs of nations, those whose summed difference of two priorities has the sign of the overall mean."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    diff = rows.groupBy("c_nationkey").agg((mean("1-URGENT") - mean("5-LOW")).alias("d")).where("d is not null")
    other = diff.select(F.col("c_nationkey").alias("b"), F.col("d").alias("e"))
    sign = diff.agg(F.signum(F.avg("d"))).head()[0]
    pairs = diff.join(F.broadcast(other), F.col("c_nationkey") < F.col("b"))  # 25 nations, so 300 pairs
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.signum(F.col("d") + F.col("e")) == F.lit(sign)).alias("agree"))


def bootstrap_interval(spark, d):
    """Bytes over words, with a 95 % interval from replicates that weigh each source by a Poisson variable of mean 1, drawn from a hash."""
    docs = _t(spark, d, "documents").select("source", F.octet_length("text").alias("b"), F.size(T.words(F.col("text"))).alias("w"))
    unit = docs.groupBy("source").agg(F.sum("b").cast("long").alias("b"), F.sum("w").cast("long").alias("w"))
    each = unit.select("*", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("r"))
    u = _unit(F.lit("boot"), F.col("r"), F.col("source"))
    weight = sum(((u >= p).cast("int") for p in POISSON), F.lit(0))
    ratio = each.withColumn("k", weight).groupBy("r").agg((F.sum(F.col("k") * F.col("b")) / F.sum(F.col("k") * F.col("w"))).alias("x"))
    at = ordered.placed(ratio.where("x is not null").withColumn("g", F.lit(1)), "g", [F.col("x"), F.col("r")])
    end = lambda q: F.max(F.when(F.col("place") == F.floor(F.lit(q) * F.col("rows")) + 1, F.col("x")))
    point = unit.agg(F.sum("b") / F.sum("w")).head()[0]
    return at.agg(F.round(F.lit(point), 9).alias("ratio"), F.round(end(0.025), 9).alias("low"), F.round(end(0.975), 9).alias("high"), F.count("*").alias("replicates"))


def quota_bands(spark, d):
    """Up to 20 customers of each segment: of the richest half by balance first up to twelve, then others by a hash."""
    rows = _t(spark, d, "customer").select("c_mktsegment", "c_custkey", F.percent_rank().over(Window.partitionBy("c_mktsegment", F.col("c_nationkey") % 5).orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"), _unit(F.lit("q"), F.col("c_custkey")).alias("u"))
    band = F.when(F.col("rank") < 0.5, "common").otherwise("rare")
    order = Window.partitionBy("c_mktsegment", "band").orderBy(F.when(F.col("band") == "common", F.col("rank")).otherwise(F.col("u")), "c_custkey")
    placed = rows.withColumn("band", band).withColumn("place", F.row_number().over(order))
    return placed.where(F.col("place") <= F.when(F.col("band") == "common", 12).otherwise(8)).select("c_mktsegment", "band", "c_custkey", "place")


def author_trim(spark, d):
    """Documents of each source that stay when none may have more than 1.1 times the smallest source's count, by a seeded hash."""
    rows = _t(spark, d, "documents").select("doc_id", "source", _unit(F.lit("trim"), F.col("doc_id")).alias("u"))
    at = ordered.placed(rows, "source", [F.col("u"), F.col("doc_id")])
    most = rows.groupBy("source").count().agg(F.floor(F.min("count") * 1.1)).head()[0] or 0
    return at.where(F.col("place") <= most).select("doc_id", "source")


def round_robin(spark, d):
    """Thirty rejected documents, one of each code in turn, the code with most first."""
    rows = _t(spark, d, "documents").select("doc_id", T.hygiene_reason(F.col("text")).alias("code")).where("code is not null")
    at = ordered.placed(rows, "code", [F.col("doc_id")])
    first = at.where("place <= 30").orderBy("place", F.desc("rows"), "code").limit(30)
    return first.select("doc_id", "code", "place")


def rule_segments(spark, d):
    """Sign-ups as rules of a user: each holds from its event to the user's next one; the events under it."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    held = _t(spark, d, "events").withColumn("rule", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(by))
    return held.where("rule is not null and event_id <> rule").groupBy("user_id", "rule").agg(F.count("*").alias("events"), F.max("event_id").alias("last"))


def state_replay(spark, d):
    """A user's list after all events: purchases add their tens, errors drop the oldest, sign-ups begin anew, clicks move the last to the front."""
    ops = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", (F.floor(F.col("value") / 10) % 10).cast("int").alias("v")))), lambda x: F.struct(x["event_type"].alias("op"), x["v"].alias("v")))

    def step(state: Column, op: Column) -> Column:
        n = F.size(state)
        return (
            F.when(op["op"] == "purchase", F.when(n < 8, F.concat(state, F.array(op["v"]))).otherwise(F.concat(F.slice(state, 2, 7), F.array(op["v"]))))
            .when((op["op"] == "error") & (n > 0), F.slice(state, 2, 8))
            .when(op["op"] == "signup", F.array(op["v"]))
            .when((op["op"] == "click") & (n > 1), F.concat(F.slice(state, -1, 1), F.slice(state, F.lit(1), n - 1)))
            .otherwise(state)
        )

    folded = _t(spark, d, "events").groupBy("user_id").agg(ops.alias("ops"))
    return folded.select("user_id", F.array_join(F.aggregate("ops", F.array().cast("array<int>"), step), ",").alias("list"))


def guarded_minimum(spark, d):
    """Order months as settings: the one of the least mean price, moved one step towards the least mean quantity if that is over 1 % worse there."""
    lines = _t(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("x")).agg(F.round(F.avg("l_extendedprice"), 4).alias("chat"), F.round(F.avg("l_quantity"), 4).alias("prose"))
    whole = Window.partitionBy()  # twelve rows
    best = lines.select("x", "chat", "prose", F.min(F.struct("chat", "x")).over(whole)["x"].alias("arg"), F.min(F.struct("prose", "x")).over(whole)["x"].alias("goal"), F.min("prose").over(whole).alias("least"), F.max("x").over(whole).alias("last"))
    at = best.where("x = arg")
    moved = F.col("prose") > 1.001 * F.col("least")
    pick = F.when(moved, F.col("arg") + F.when(F.col("goal") > F.col("arg"), 1).otherwise(-1)).otherwise(F.col("arg"))
    return at.select("arg", pick.alias("pick"), moved.alias("guard_moved"), F.when(pick == 1, "low").when(pick == F.col("last"), "high").alias("edge"))


def global_rank(spark, d):
    """Every document's place by tier, day and key, without one task that sorts them all."""
    rows = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("g"), F.regexp_extract("source", "[0-9]+", 0).try_cast("int").alias("tier"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") * 37 % 1000).alias("day"))
    at = ordered.placed(rows, "g", [F.col("tier"), F.col("day").asc_nulls_last(), F.col("doc_id")])
    return at.select("doc_id", "place")


def nearest_mix(spark, d):
    """Thirty benchmark items of which planted kinds come near a target mix, in the order of choice."""
    kind = F.element_at(F.array(*map(F.lit, ("A", "B", "C", "C"))), (F.col("item_id") % 4 + 1).cast("int"))
    h = F.sha2(F.concat(F.lit("pick:"), F.col("item_id").cast("string")).cast("binary"), 256)
    items = [(str(r["item_id"]), r["kind"]) for r in _t(spark, d, "benchmark").select("item_id", kind.alias("kind"), h.alias("h")).orderBy("h").limit(10_000).collect()]
    chosen = planning.nearest_mix(items, {"A": 0.5, "B": 0.25, "C": 0.25}, min(30, len(items)), "A") or []
    return spark.createDataFrame([(int(k), i) for i, k in enumerate(chosen)], "item_id long, place int")


_W = r"regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')"
_UNIT = "cast(concat('0x', substr(sha256(concat_ws('|', {})), 1, 8)) as ubigint)::double / 4294967296.0"
_RUN = "list_transform(range(1, len(w) - {}), lambda i: array_to_string(w[i:i + {}], ' '))"
_STOP = "'" + "', '".join(w.replace("'", "''") for w in T.STOPWORDS.split()) + "'"
_L, _P = r"len(regexp_extract_all(coalesce(text, ''), '\p{L}'))", "len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]'))"
_CODE = f"""case when coalesce(text, '') = '' then 'empty' when strlen(text) < 200 then 'too_short' when {_L} > 0 and ({_L} - {_P}) / {_L} > 0.30 then 'non_ascii'
    when len({_W}) = 0 or len(list_filter({_W}, lambda w: w in ({_STOP}))) / len({_W}) < 0.10 then 'not_english' end"""
_SCORES = """select c_nationkey as model, o_orderpriority as family, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as score
    from orders join customer on o_custkey = c_custkey where (c_nationkey + cast(left(o_orderpriority, 1) as int)) % 11 > 0 group by 1, 2"""
_JUDGED = "select l_orderkey as item, l_linenumber as line, l_suppkey % 4 as judge, l_orderkey % 5 as author, l_partkey % 3 > 0 as keep from lineitem"
_KIND = "case when p_partkey % {0} > 0 then ['noun', 'verb', 'adj', 'unk'][cast(floor(" + _UNIT.format("'{0}', p_partkey") + " * 97) as bigint) % 4 + 1] end"
_CENTS = "cast(round({} * 100) as bigint)"
ORACLES = {
    "slot_coverage": """
        with e as (select o_orderpriority, o_custkey, count(*) as n from orders group by 1, 2)
        select o_orderpriority, cast(sum(n) as bigint) as orders, count(*) as customers, round(max(n) / sum(n), 9) as top_share, round(count(*) filter (n = 1) / count(*), 9) as once_share from e group by 1""",
    "label_yield": """
        select source, lang, count(*) as attempts, count(*) filter (quality = 1 and toxic = 0) as accepted, round(count(*) filter (quality = 1 and toxic = 0) / count(*), 9) as share
        from labels join documents using (doc_id) group by rollup (source, lang)""",
    "label_disagreement": """
        select source, count(*) as judged, count(*) filter (quality = 0) as quality_drops, count(*) filter (toxic = 1) as toxic_drops, count(*) filter ((quality = 0) <> (toxic = 1)) as one_alone
        from labels join documents using (doc_id) group by source""",
    "author_shares": f"select source, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from documents where ({_CODE}) is null group by source",
    "bits_per_byte": f"""
        select coalesce(lang, 'ALL') as lang, round(sum(len({_W}) * 3 + doc_id % 7) / ln(2) / sum(strlen(text)), 9) as bpb from documents group by rollup (lang)""",
    "composites": f"""
        select model, case when count(*) = 5 then round(100 * avg(score), 6) end as composite, count(*) = 5 and bool_and(score >= 0.4) as met from ({_SCORES}) group by model""",
    "headroom": f"select family, count(*) as models, case when max(score) <= 0.5 then 'floor' when min(score) >= 0.45 then 'ceiling' end as reason from ({_SCORES}) group by family",
    "reanchored": f"""
        with r as (select family, round(avg(score) + 0.2, 9) as rate from ({_SCORES}) group by family)
        select family, case when rate >= 0.8 then 0.8 when rate < 0.6 then 0.6 else round(greatest(0.6, floor(round(rate / 0.05, 9)) * 0.05), 2) end as bar,
               case when rate >= 0.8 then 'kept' when rate < 0.6 then 'floor' else 're-anchored' end as rule from r""",
    "base_rates": f"""
        with t as (select role, coalesce(text, '') as t from conversations),
        h as ({" union all ".join(f"select role, '{n}' as rule, regexp_matches(t, '{p}') as hit from t" for n, p in RULES.items())}),
        r as (select rule, role, round(avg(case when hit then 1.0 else 0.0 end), 9) as rate from h group by all)
        select rule, role, rate, max(rate) over (partition by rule) > 0.30 as dropped from r""",
    "phrase_gains": f"""
        with d as (select {_W} as w from documents),
        p as (select unnest({_RUN.format(0, 1)}) as phrase, 1 as k from d union all select unnest({_RUN.format(1, 2)}), 2 from d union all select unnest({_RUN.format(2, 3)}), 3 from d)
        select phrase, count(*) as n, count(*) * max(k) as gain from p group by phrase order by gain desc, phrase limit 50""",
    "unseen_words": f"""
        with b as (select distinct unnest({_W}) as word from benchmark), s as (select distinct unnest({_W}) as word from documents)
        select word, cast(strlen(word) as integer) as bytes from b where word not in (select word from s) order by bytes desc, word limit 20""",
    "name_profiles": """
        with r as (select c_nationkey, case when year(o_orderdate) < 1994 then 'a' when year(o_orderdate) < 1996 then 'b' else 'c' end as era, count(*) as n
                   from orders join customer on o_custkey = c_custkey group by 1, 2),
        s as (select *, round(n / sum(n) over (partition by era), 12) as rate from r),
        t as (select c_nationkey, cast(sum(n) as bigint) as orders, arg_max(era, (rate, era)) as era from s group by 1)
        select *, cast(row_number() over (partition by era order by orders desc, c_nationkey) as integer) as place from t""",
    "pos_votes": f"""
        with v as (select p_partkey, list_filter([{", ".join(_KIND.format(m) for m in (2, 3, 5))}], lambda x: x is not null) as votes,
                          ['noun', 'verb', 'adj', 'unk'][cast(floor({_UNIT.format("'7', p_partkey")} * 97) as bigint) % 4 + 1] as proxy from part),
        e as (select p_partkey, unnest(list_concat(votes, case when proxy <> 'unk' then [proxy] else [] end)) as x from v), c as (select p_partkey, x, count(*) as c from e group by 1, 2),
        b as (select p_partkey, max(c) as most, arg_max(x, (c, x)) as x from c group by 1)
        select p_partkey, case when len(votes) = 0 then proxy when most >= 2 then x else 'amb' end as pos,
               case when len(votes) = 0 then 'pending' when most >= 2 then 'confirmed' else 'amb' end as status from v left join b using (p_partkey)""",
    "first_judgements": f'select item, judge, min(line) as "at", arg_min(keep, (line, keep)) as keep from ({_JUDGED}) group by 1, 2',
    "two_judge_rule": f"""
        with b as (select item, count(*) <> 2 or count(distinct judge) <> 2 or bool_or(judge = author) as missing, bool_or(judge = 3) as loose, bool_and(keep) as keep from ({_JUDGED}) group by item)
        select case when missing then 'JUDGE_MISSING' when loose then 'JUDGE_NOT_PINNED' when keep then 'kept' else 'JUDGE_DROP' end as status, count(*) as items from b group by 1""",
    "checklist_pass": """
        with b as (select l_orderkey, bool_and(l_linestatus = 'F') and bool_and(l_returnflag <> 'R') as passed, count(*) as n from lineitem group by 1)
        select passed, count(*) as orders, cast(sum(n) as bigint) as lines from b group by 1""",
    "bank_winners": "select p_brand, arg_min(p_partkey, sha256('w-1:' || p_partkey)) as winner, count(*) - 1 as dropped from part where p_size > 10 group by 1",
    "registry_problems": """
        with c as (select concat_ws(',', case when not regexp_full_match(s_name, 'Supplier#[0-9]+') then 'NAME' end, case when s_nationkey not between 0 and 24 then 'NATION' end,
                   case when s_acctbal < 0 then 'NEGATIVE' end, case when round(s_acctbal * 100) % 10 = 0 then 'ROUND' end) as c from supplier)
        select coalesce(nullif(c, ''), 'ok') as codes, count(*) as entries from c group by 1""",
    "filtered_listing": """
        select p_brand, count(*) as parts, round(sum(p_retailprice), 2) as price from part where p_brand like 'Brand#1_' and p_size in (1, 5, 9, 20, 33) group by 1""",
    "bank_manifest": f"""
        with b as (select source, {_CODE} as code, count(*) as n from documents group by all)
        select source, cast(coalesce(sum(n) filter (code is null), 0) as bigint) as kept, coalesce(string_agg(code || ':' || n, ',' order by code) filter (code is not null), '') as drops from b group by source""",
    "separation": f"""
        with r as (select item_id % 2 = 0 as even, text, {_W} as w from benchmark),
        e as (select even, 'words' as kind, unnest(w) as v from r union all select even, 'runs', unnest({_RUN.format(1, 2)}) from r union all select even, 'texts', text from r),
        s as (select kind, v, count(distinct even) as sides from e where v is not null group by 1, 2)
        select kind, count(*) filter (sides = 2) as shared, count(*) as "values" from s group by kind""",
    "seed_order": """
        select doc_id, cast(row_number() over (order by sha256('seed-9|' || doc_id), doc_id) as integer) as place from documents qualify place <= 40""",
    "answer_margins": f"""
        with r as (select l_orderkey, max({_CENTS.format("l_extendedprice")}) filter (l_linenumber = 1) as gold, max({_CENTS.format("l_extendedprice")}) filter (l_linenumber > 1) as other from lineitem group by 1)
        select l_orderkey, coalesce(gold > other, false) as "right", gold - other as margin from r""",
    "model_comparison": f"""
        with r as (select l_orderkey, max({_CENTS.format("l_extendedprice")}) filter (l_linenumber = 1) as ga, max({_CENTS.format("l_extendedprice")}) filter (l_linenumber > 1) as oa,
                          max({_CENTS.format("l_quantity")}) filter (l_linenumber = 1) as gb, max({_CENTS.format("l_quantity")}) filter (l_linenumber > 1) as ob, count(*) as n
                   from lineitem where l_orderkey % 7 > 0 group by 1)
        select o_orderpriority as key, count(*) as n, round(avg(case when ga > oa then 1.0 else 0.0 end), 9) as acc_a, round(avg(case when gb > ob then 1.0 else 0.0 end), 9) as acc_b,
               round(avg(1.0 / n), 9) as chance from r join orders on l_orderkey = o_orderkey where oa is not null and ga is not null group by 1""",
    "contrast_readings": """
        with r as (select c_nationkey, o_orderpriority, avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey group by 1, 2),
        p as (select r.*, b.m as base, r.m - b.m as diff from r join r b on b.c_nationkey = r.c_nationkey and b.o_orderpriority = '5-LOW' where r.o_orderpriority <> '5-LOW'),
        g as (select o_orderpriority, count(*) as k, avg(diff) as mean, stddev_samp(diff) as sd, bool_and(diff < 0) as down, bool_and(diff > 0) as up, avg(base) as level from p group by 1),
        c as (select *, 2.06 * sd / sqrt(k) as clear from g)
        select o_orderpriority, k, round(mean, 3) as mean, case when -mean > clear and down then 'BETTER' when mean > clear and up then 'WORSE' when abs(mean) + clear < 0.1 * level then 'EQUAL' else 'UNRESOLVED' end as reading from c""",
    "sign_agreement": """
        with d as (select c_nationkey, avg(o_totalprice) filter (o_orderpriority = '1-URGENT') - avg(o_totalprice) filter (o_orderpriority = '5-LOW') as d
                   from orders join customer on o_custkey = c_custkey group by 1 having d is not null)
        select count(*) as pairs, count(*) filter (sign(a.d + b.d) = (select sign(avg(d)) from d)) as agree from d a join d b on a.c_nationkey < b.c_nationkey""",
    "bootstrap_interval": f"""
        with u as (select source, sum(strlen(text)) as b, sum(len({_W})) as w from documents group by 1), e as (select *, {_UNIT.format("'boot', r, source")} as u from u, range({REPLICATES}) t(r)),
        k as (select *, {" + ".join(f"cast(u >= {p!r} as integer)" for p in POISSON)} as k from e), x as (select r, sum(k * b) / sum(k * w) as x from k group by r having sum(k * w) > 0),
        o as (select x, row_number() over (order by x, r) as place, count(*) over () as n from x)
        select round((select sum(b) / sum(w) from u), 9) as ratio, round(max(x) filter (place = floor(0.025 * n) + 1), 9) as low, round(max(x) filter (place = floor(0.975 * n) + 1), 9) as high, count(*) as replicates from o""",
    "quota_bands": f"""
        with r as (select c_mktsegment, c_custkey, percent_rank() over (partition by c_mktsegment, c_nationkey % 5 order by c_acctbal desc, c_custkey) as rank, {_UNIT.format("'q', c_custkey")} as u from customer),
        b as (select *, case when rank < 0.5 then 'common' else 'rare' end as band from r),
        p as (select c_mktsegment, band, c_custkey, cast(row_number() over (partition by c_mktsegment, band order by case when band = 'common' then rank else u end, c_custkey) as integer) as place from b)
        select * from p where place <= case when band = 'common' then 12 else 8 end""",
    "author_trim": f"""
        with r as (select doc_id, source, row_number() over (partition by source order by {_UNIT.format("'trim', doc_id")}, doc_id) as place from documents)
        select doc_id, source from r where place <= (select floor(min(n) * 1.1) from (select count(*) as n from documents group by source))""",
    "round_robin": f"""
        with c as (select doc_id, {_CODE} as code from documents), p as (select doc_id, code, row_number() over (partition by code order by doc_id) as place, count(*) over (partition by code) as rows from c where code is not null)
        select doc_id, code, place from p order by place, rows desc, code limit 30""",
    "rule_segments": """
        with h as (select *, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id) as rule from events)
        select user_id, rule, count(*) as events, max(event_id) as last from h where rule is not null and event_id <> rule group by 1, 2""",
    "guarded_minimum": """
        with m as (select month(l_shipdate) as x, round(avg(l_extendedprice), 4) as chat, round(avg(l_quantity), 4) as prose from lineitem group by 1),
        a as (select arg_min(x, (chat, x)) as arg, arg_min(x, (prose, x)) as goal, min(prose) as least, max(x) as last from m),
        g as (select arg, last, prose > 1.001 * least as moved, arg + case when prose > 1.001 * least then case when goal > arg then 1 else -1 end else 0 end as pick from a join m on x = arg)
        select cast(arg as integer) as arg, cast(pick as integer) as pick, moved as guard_moved, case when pick = 1 then 'low' when pick = last then 'high' end as edge from g""",
    "global_rank": """
        select doc_id, row_number() over (order by cast(regexp_extract(source, '[0-9]+') as int) nulls first, case when doc_id % 5 > 0 then doc_id * 37 % 1000 end nulls last, doc_id) as place from documents""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "state_replay", "nearest_mix")}
