"""Searches along orders, near lists and sets, greedy acceptance, chains, donors and nested intervals against plain Python."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import families, ranges, resampling, similar
from tamis.session import Scratch


@pytest.fixture
def split(spark):
    """Sets the number of ranges of the test."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def set_(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield set_
    for k, v in before.items():
        spark.conf.set(k, v)


def test_array_searches():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(0, 40)
        values, start, least = rng.integers(0, 10, n).astype(float), rng.integers(0, n + 2, 50), rng.integers(0, 12, 50).astype(float)
        want = [next((j for j in range(s, n) if values[j] >= x), n) for s, x in zip(start, least)]
        assert ranges.first_at_least(values, start, least).tolist() == want
        ranks = rng.integers(0, 8, n)
        assert ranges.earlier_greater_here(ranks).tolist() == [int((ranks[:i] > ranks[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("parts,kind", [(1, "random"), (7, "random"), (7, "one"), (7, "rising"), (7, "falling"), (64, "one")])
def test_next_eligible(spark, split, parts, kind):
    """Also where all rows wait for one row, so that one range is asked by all others."""
    split(parts)
    rng, n = np.random.default_rng(2), 250
    size = {"random": rng.integers(0, 1000, n), "one": np.where(np.arange(n) == 137, 1000, rng.integers(0, 5, n)), "rising": np.arange(n), "falling": np.arange(n)[::-1]}[kind]
    need = np.full(n, 900) if kind == "one" else rng.integers(0, size.max() + 50, n)
    rows = [(i, int(s), int(x), 1, "k") for i, (s, x) in enumerate(zip(size, need))]
    rows[5:7] = [(5, None, 3, 1, "k"), (6, 7, None, 1, "k")]
    df = spark.createDataFrame([*rows, (None, 5, 5, 1, "k")], "id long, size int, need int, part int, key string")
    got = {r.id: r.next for r in ranges.next_eligible(df, "id", "size", "need").collect()}
    ok = lambda i, j: rows[i][2] is not None and rows[j][1] is not None and rows[j][1] >= rows[i][2]
    assert got == {i: next(((i + s) % n for s in range(1, n) if ok(i, (i + s) % n)), None) for i in range(n)}
    assert ranges.next_eligible(df.limit(0), "id", "size", "need").count() == 0


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_earlier_greater(spark, parts):
    rank = np.random.default_rng(3).permutation(400)
    df = spark.createDataFrame([(i, int(p), 0) for i, p in enumerate(rank)], "id long, rank int, bin int").repartition(5)
    found = ranges.earlier_greater(df, "id", [F.col("id")], [F.col("rank")], ranges=parts)
    assert {r.id: r.n for r in found.collect()} == {i: int((rank[:i] > rank[i]).sum()) for i in range(400)}
    assert ranges.earlier_greater(df.limit(0), "id", [F.col("id")], [F.col("rank")], ranges=parts).count() == 0


def test_many_late_rows_without_a_nested_loop(spark):
    n = 1_000_000
    df = spark.range(n).select("id", F.pmod(F.col("id") * 7919, F.lit(n)).alias("rank"))
    found = ranges.earlier_greater(df, "id", [F.col("id")], [F.col("rank")], ranges=16)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    rank = np.arange(n) * 7919 % n
    assert found.agg(F.sum("n")).head()[0] == int(ranges.earlier_greater_here(rank).sum())


def full_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@pytest.fixture(scope="module")
def lists():
    r = random.Random(3)
    return [(i, [r.choice("abcdef") for _ in range(r.randint(0, 12))], r.choice("xy")) for i in range(150)]


def test_word_edits(spark, lists):
    for (_, a, _), (_, b, _) in itertools.product(lists[:60], repeat=2):
        for cap in range(4):
            assert similar.word_edits(a, b, cap) == min(full_edits(a, b), cap + 1)
    df = spark.createDataFrame([*lists, (None, ["a"], "x"), (900, None, "x"), (901, ["a"], None)], "k long, w array<string>, g string")
    for cap in (1, 2, 3):
        want = sorted((a[0], b[0], full_edits(a[1], b[1])) for a, b in itertools.combinations(lists, 2) if a[2] == b[2] and full_edits(a[1], b[1]) <= cap)
        assert sorted(tuple(r) for r in similar.within_edits(df, "k", "w", cap, "g").collect()) == want
    assert similar.within_edits(df.limit(0), "k", "w", 1).count() == 0


@pytest.mark.parametrize("bound", [(1, 3), (6, 10), (8, 10), (1, 1)])
def test_similar_sets(spark, lists, bound):
    df = spark.createDataFrame([*lists, (None, ["a"], "x"), (900, None, "x"), (901, [None], "x")], "k long, w array<string>, g string")
    alike = lambda a, b: len(set(a) & set(b)) * bound[1] >= bound[0] * len(set(a) | set(b))
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(lists, 2) if a[2] == b[2] and a[1] and b[1] and alike(a[1], b[1]))
    assert sorted(tuple(r) for r in similar.similar_sets(df, "k", "w", bound, "g").collect()) == want


@pytest.mark.parametrize("n,share", [(60, 0.05), (60, 0.2), (25, None)])
def test_greedy_acceptance(spark, n, share):
    """Random links, and a chain in the order of ranks, where every second one is accepted and components would keep one."""
    r = random.Random(n)
    ids = list(range(n))
    rank = dict(zip(ids, ids if share is None else r.sample(ids, n)))
    links = [(i, i + 1) for i in range(n - 1)] if share is None else [(i, j) for i in ids for j in ids if i < j and r.random() < share]
    items, pairs = spark.createDataFrame(list(rank.items()), "k long, r long"), spark.createDataFrame([*links, (3, 3), (999, 1)], "a long, b long")
    accepted, want = [], {}
    for k in sorted(ids, key=rank.get):
        owner = next((x for x in accepted if (x, k) in links or (k, x) in links), k)
        accepted += [k] * (owner == k)
        want[k] = owner
    assert {x.k: x.owner for x in similar.first_accepted(items, pairs, "k", "r").collect()} == want
    assert {x.owner for x in similar.first_accepted(items, pairs.limit(0), "k", "r").collect()} == set(ids)


def test_inflections_and_chains(spark):
    words = ["walk", "walked", "walking", "walks", "stop", "stopped", "try", "tries", "tried", "big", "bigger", "biggest", "box", "boxes", "make", "making", "glass", "as", "rare", "rared"]
    rows = [(w, 10 + 100 * (w in ("walk", "stop", "try", "big", "box", "make", "glass"))) for w in words] + [(None, 5)]
    got = {r.word: (r.head, r.rule) for r in families.word_families(spark.createDataFrame(rows, "word string, docs int"), "word", "docs").collect()}
    heads = {"walked": ("walk", "ed"), "walking": ("walk", "ing"), "walks": ("walk", "s"), "stopped": ("stop", "ed"), "tries": ("try", "s"), "tried": ("try", "ed"),
             "bigger": ("big", "er"), "biggest": ("big", "est"), "boxes": ("box", "s"), "making": ("make", "ing"), "rared": ("rare", "ed")}
    assert got == {w: heads.get(w, (w, None)) for w in words}
    steps = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 100)], "at long, to long")
    assert {r.end for r in families.followed(steps, Scratch(spark, "chain")).collect()} == {100}


def test_chains_in_a_circle_are_refused(spark, monkeypatch):
    monkeypatch.setattr(families, "LONGEST", 4)
    with pytest.raises(ValueError):
        families.followed(spark.createDataFrame([(1, 2), (2, 1)], "at long, to long"), Scratch(spark, "circle"))


@pytest.mark.parametrize("sizes", [{"a": 3, "b": 3, "c": 4}, {"a": 1, "b": 5, None: 4}, {"a": 2, "b": 9, "c": 1}, {"a": 4}, {"a": 1, "b": 1}])
def test_donors(spark, sizes):
    groups = dict(enumerate(g for g, n in sizes.items() for _ in range(n)))
    got = {r.k: r.donor for r in families.even_donors(spark.createDataFrame(list(groups.items()), "k long, g string"), "k", "g").collect()}
    assert set(got) == set(groups)
    if len(sizes) == 1:
        assert set(got.values()) == {None}
        return
    assert all(groups[k] != groups[v] for k, v in got.items())
    most = max(sizes, key=sizes.get)
    for wanted in (set(sizes) - {most}, {most}):
        uses = Counter(v for v in got.values() if groups[v] in wanted)
        every = [uses.get(k, 0) for k, g in groups.items() if g in wanted]
        assert max(every) - min(every) <= 1


def test_strata_keep_their_sizes_and_arms_share_units(spark):
    units = spark.createDataFrame([("s", i, 5) for i in range(1, 6)] + [("t", i, 2) for i in (1, 2)], "stratum string, place long, rows long")
    for r in resampling.unit_weights(units, 30, "x").groupBy("replicate", "stratum").agg(F.sum("weight").alias("w")).collect():
        assert r.w == pytest.approx(1)
    runs = [("a", t, s) for t in range(3) for s in range(2)] + [("b", 0, 0)]
    for r in resampling.run_weights(spark.createDataFrame(runs, "arm string, train int, seed int"), 30, "x").groupBy("replicate", "arm").agg(F.sum("weight").alias("w")).collect():
        assert r.w == pytest.approx(1)
    # both arms equal: whatever units are drawn the difference is that of the runs, here none
    same = [(arm, 0, 0, st, u, float(u % 2)) for arm in "ab" for st in ("s", "t") for u in range(5)] + [("a", 0, 0, "s", 99, 1.0)]
    row = resampling.nested_difference(spark.createDataFrame(same, "arm string, train int, seed int, stratum string, unit int, score double"), "a", "b", 50, "x").head()
    assert tuple(row) == (10, 0.0, 0.0, 0.0)


def test_lines_that_share_a_frequent_word_are_not_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tamis.operators import similar

    monkeypatch.setattr(similar, "edits", lambda a, b, cap: F.raise_error(F.lit("compared")).cast("int"))
    rows = spark.createDataFrame([(i, ["the", f"a{i}", f"b{i}"]) for i in range(300)], "id long, w array<string>")
    assert similar.within_edits(rows, "id", "w", 1).collect() == []


def test_pairs_one_edit_apart_are_only_written(spark, monkeypatch):
    """Lists meet by what is equal, in blocks, so nothing is done for each pair in Python."""
    r = random.Random(5)
    words = [["we", "go", f"w{i}", "now"] for i in range(50)] + [["we", "go", "now"]] * 3 + [[r.choice(["a", "b", "a b", None]) for _ in range(r.randint(0, 4))] for _ in range(80)]
    want = [(i, j, e) for i, j in itertools.combinations(range(len(words)), 2) if (e := similar.word_edits(words[i], words[j], 1)) <= 1]
    monkeypatch.setattr(similar, "BLOCK", 7, raising=False)
    monkeypatch.setattr(similar, "edits", lambda a, b, cap: F.raise_error(F.lit("compared")).cast("int"))
    rows = spark.createDataFrame(list(enumerate(words)), "id long, w array<string>")
    assert sorted(map(tuple, similar.within_edits(rows, "id", "w", 1).collect())) == want


def test_one_edit_in_all_its_forms(spark):
    from tamis.operators import similar

    words = [[], ["a"], ["b"], ["a", "b"], ["b", "a"], ["a", "a"], ["a", "a", "b"], ["a", "b"], ["x", "a", "b", "c"], ["a", "b", "c", "x"], None]
    rows = spark.createDataFrame([(i, w, i % 2) for i, w in enumerate(words)], "id long, w array<string>, g int")
    for group in (None, "g"):
        alike = lambda i, j: group is None or i % 2 == j % 2
        pairs = ((i, j) for i in range(10) for j in range(i + 1, 10) if alike(i, j))
        want = [(i, j, similar.word_edits(words[i], words[j], 1)) for i, j in pairs if similar.word_edits(words[i], words[j], 1) <= 1]
        assert sorted(map(tuple, similar.within_edits(rows, "id", "w", 1, group).collect())) == want


def test_messages_are_made_once_for_all_steps(spark):
    from pyspark.sql import functions as F

    from tamis.operators import paths

    made = spark.sparkContext.accumulator(0)

    def seen(role):
        made.add(1)
        return role

    rows = [(1, i, None if i == 0 else i - 1, "user" if i % 2 == 0 else "assistant") for i in range(4)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string").withColumn("role", F.udf(seen, "string")("role"))
    assert sorted((r.id, r.users) for r in paths.all_paths(messages).collect()) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert made.value == 4
