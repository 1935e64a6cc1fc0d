"""Classifiers by held-out accuracy, rollups and top-k by brute force, the pipeline by what its stages promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import knn, quality, token_rollup, toxicity
from tamis.llm.queries import registry
from tamis.session import shared_folder

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("operator,label,parts,part,least", [(quality, "quality", 3, 1, 0.97), (toxicity, "toxic", 4, 2, 0.93)])
def test_held_out_accuracy(spark, operator, label, parts, part, least):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.held_out(F.col("doc_id"), parts, part)
    scored = operator.scores(docs, labels, ~out)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    right = scored.join(labels, "doc_id").where(out).agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).head()[0]
    assert right >= least


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_models_take_odd_rows(spark, operator, label):
    docs = spark.createDataFrame([(1, "a b c", 0), (1, "a b c", 0), (2, None, 0), (None, "", 1), (4, "w " * 50_000, 2)], "doc_id long, text string, features int")
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0), some.where("doc_id = 1")):
        scored = operator.scores(docs, labels, F.lit(True))
        assert scored.count() == 5 and scored.where("score is null").count() == 0
    assert operator.scores(docs.limit(0), some, F.lit(True)).count() == 0


def test_preferences_rank_the_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    label = (x[:, 3] + 0.1 * rng.normal(size=400) > 0.3).astype(int)
    model = quality.fit(x, label)
    assert np.argmax(np.abs(np.array(model.weights) * x.std(0))) == 3
    cut = np.quantile(x @ np.array(model.weights), 1 - label.mean())
    assert abs(((x @ np.array(model.weights) >= cut) == label).mean() - 1) < 0.06


def test_correlated_voters_share_their_vote():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, y, ~y).astype(float)
    one = vote(0.8)
    votes = np.column_stack([one, one, one, vote(0.9), vote(0.7)])
    model = toxicity.label_model(toxicity.held(votes, np.where(rng.random(4000) < 0.3, y, -1)))
    assert model.share[0] < 0.5 < model.share[3] and model.speaks[1, 3] > 0.75 > 0.25 > model.speaks[0, 3]


def test_rollups_follow_signed_batches(spark):
    rows = spark.createDataFrame([("s", "en", "v", 5, 3), ("s", "en", "v", 7, 7), (None, "en", "v", 1, 1)], "source string, lang string, version string, tokens long, was long")
    import uuid

    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    assert rollup.totals().count() == 0
    assert rollup.commit(1, token_rollup.inserted(rows.withColumn("tokens", F.col("was"))))
    assert rollup.commit(2, token_rollup.revised(rows)) and not rollup.commit(2, token_rollup.inserted(rows))
    totals = {r.source: (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert totals == {"s": (2, 12), None: (1, 1)}
    rollup.commit(3, token_rollup.deleted(rows.where("source is null or tokens = 7")))
    assert [(r.source, r.docs, r.tokens) for r in rollup.totals().collect()] == [("s", 1, 5)]


def test_batches_that_come_after_a_snapshot_of_later_ones(spark):
    import uuid

    of = lambda n: token_rollup.inserted(spark.createDataFrame([("s", "en", "v", 10**n)], "source string, lang string, version string, tokens long"))
    total = lambda: [(r.docs, r.tokens) for r in rollup.totals().collect()]
    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    assert rollup.compact() == 0 and rollup.commit(1, of(1)) and rollup.commit(3, of(3)) and rollup.compact() == 2
    assert rollup.commit(2, of(2)) and total() == [(3, 1110)]
    assert rollup.compact() == 3 and total() == [(3, 1110)]
    assert not rollup.commit(2, of(5)) and not rollup.commit(3, of(5)) and rollup.compact() == 3 and total() == [(3, 1110)]
    # a snapshot without its list of batches was not completed
    of(9).write.parquet(f"{rollup.folder}/snapshot=9")
    assert total() == [(3, 1110)] and rollup.commit(4, of(0)) and rollup.compact() == 4 and total() == [(4, 1111)]
    empty = of(1).limit(0)
    assert rollup.commit(5, empty) and total() == [(4, 1111)]


def test_rollup_of_a_tokenizers_counts(spark):
    """The totals of a real encoder's tokens, beside clashing columns."""
    import uuid

    from tamis.llm import byte_bpe

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", F.lit("x").alias("version"), F.lit(1).alias("docs"), F.lit(2).alias("tokens"))
    counted = byte_bpe.round_trip(docs, *byte_bpe.default_vocabulary()).select("doc_id", F.col("n_tokens").alias("bpe"))
    wide = docs.join(counted, "doc_id").select("source", "lang", "bpe", "version", "docs", "tokens")
    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit(1, token_rollup.inserted(token_rollup.by_version(wide, {"byte-bpe-50k": {"tokens": "bpe"}})))
    coder = byte_bpe.codec(*byte_bpe.default_vocabulary())
    want = {}
    for r in docs.collect():
        n, t = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = (n + 1, t + len(coder.encode(r.text or "")))
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect()} == want


def test_patterns_spread_over_tasks_give_the_same_model(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.random((500, 6)) * 8) / 8 * (rng.random((500, 6)) < 0.4)
    label = np.where(rng.random(500) < 0.3, (x[:, 0] > 0).astype(int), -1)
    said = [([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r > 0]], int(y)) for r, y in zip(x, label)]
    table = toxicity.patterns(spark.createDataFrame(said, "voter array<smallint>, value array<float>, label int"))
    assert table.agg(F.sum("times")).head()[0] == 500
    one, other = toxicity.fit(toxicity.held(x, label), 6), toxicity.fit(toxicity.spread_over(table, 6), 6)
    assert np.allclose([*one.weights, one.bias], [*other.weights, other.bias], atol=1e-6)


def test_scores_that_are_no_long_take_no_part(spark):
    rows = [(0, [1e300, 0.0]), (20, [-1e300, 1.0]), (40, [1.0, 2.0]), (41, [3.0e6, 2.0]), (42, [1.0, 1.0])]
    got = [tuple(r) for r in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3).collect()]
    assert sorted(got) == [(40, 1, 41, 64 * 64 * 3_000_000 + 128 * 128), (40, 2, 42, 64 * 64 + 128 * 64)]


def test_a_null_key_is_not_held_out(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (1,)], "k long").select(quality.held_out(F.col("k"), 1, 0)).collect()] == [False, True]


def brute_top(rows, k):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in rows], np.int64).reshape(len(rows), width)
    ids, out = np.array([i for i, _ in rows]), []
    for a in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[a]
        best = [b for b in np.lexsort((ids, -scores)) if b != a][:k]
        out += [(int(ids[a]), n, int(ids[b]), int(scores[b])) for n, b in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(900)]
    for i in range(300):
        rows[i] = (i, rows[0][1])
    rows[20], rows[40], rows[41], rows[60] = (20, None), (40, [float("nan")] * 6), (41, [None] * 6), (60, [float("inf")] * 6)
    rows += [(80, rows[80][1]), (None, [1.0] * 6), (2000, [1.0]), (2020, [])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    for slices in ((2048, 8192), (8, 100)):
        monkeypatch.setattr(knn, "QUERY_SLICE", slices[0])
        monkeypatch.setattr(knn, "DATA_SLICE", slices[1])
        got = sorted(tuple(r) for r in knn.top_k(docs, F.col("vec_id") % 20 == 0, 20).collect())
        assert got == brute_top(rows, 20)
    few = docs.where("vec_id < 5")
    assert sorted(tuple(r) for r in knn.top_k(few, F.col("vec_id") % 20 == 0, 20).collect()) == brute_top(rows[:5], 20)
    assert knn.top_k(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_clustered_queries_ask_few_slices(spark, monkeypatch):
    """Thirty tight clusters far apart: a query goes to its own slice and few others, and the result is that of brute force."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(30, 8)) * 20
    rows = [(i, [float(c) for c in middles[i % 30] + 0.05 * rng.normal(size=8)]) for i in range(1500)]
    asked, keep = [], knn.Scratch.keep

    def noted(self, df, name):
        out = keep(self, df, name)
        if name == "asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(knn.Scratch, "keep", noted)
    monkeypatch.setattr(knn, "DATA_SLICE", 60)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in knn.top_k(docs, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute_top(rows, 20)
    queries, slices = 75, 25
    assert asked[0] < 0.2 * queries * slices


def test_pipeline_keeps_its_promises(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = corpus_pipeline.run(spark, sf_dir)
    assert 0 < tokens.count() <= docs.count() and tokens.where("not exact").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert set(registry()) == {q for q in registry() if q.startswith("op")} and len(registry()) == 13


def test_near_copies_leave_the_pipeline(spark):
    rng = np.random.default_rng(4)
    vocabulary, texts = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)], []
    for _ in range(20):
        words = list(rng.choice(vocabulary, 300))
        changed = list(words)
        for at in (50, 120, 190, 260):  # 276 of 316 shingles are shared: 0.87
            changed[at] = "zzz"
        texts += [" ".join(words), " ".join(changed)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_near_fingerprints_meet_in_a_covering_table_of_the_pipeline():
    from tamis.llm import simhash
    from tamis.operators import minhash

    sketcher = minhash.Sketcher(simhash.TEXTS)
    hashes = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 40_000, dtype=np.uint64))
    bits = [sum(int(h) >> i & 1 for h in hashes[:300]) * 2 > 300 for i in range(64)]
    assert int(sketcher.fingerprint(hashes[:300])) == sum(1 << i for i, on in enumerate(bits) if on)
    # one hash of 40,000 more: fingerprints within two bits, and so a common bucket
    one, other = sketcher.fingerprint(hashes), sketcher.fingerprint(hashes[1:])
    assert int(one ^ other).bit_count() <= 2
    assert len(sketcher.keys(hashes)) == len(simhash.TEXTS.tables) + 7 and (sketcher.keys(hashes)[-7:] == sketcher.keys(hashes[1:])[-7:]).any()
