"""Registered queries over a whole test table against plain Python, and every stage with odd rows."""

import hashlib
import re
import struct
import tracemalloc

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import byte_bpe, decontaminate, pii, quality, secrets, simhash, toxicity
from tamis.llm.queries import registry
from tamis.operators import minhash
from tests.llm.test_text_operators import base_pii, base_secrets, brute_simhash, brute_windows, listing, sha

SMALL = "/root/testdata/sf0.001"
ODD = [(1, ""), (2, None), (3, "word " * 30_000), (4, "a b c"), (4, "a b c"), (5, "a b c"), (None, "x y"), (None, None), (6, "  \n"), (7, "é😀 ıİ")]
#: Names that the operators use inside, with other meanings.
CLASHING = "doc_id long, text string, h1 long, h2 string, key string, features int, hit_key int, hit_sig int, hit_spans int, place int, part int, node int, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_secrets_and_personal_data(spark, texts):
    for r in registry()["op4_trigram_secrets"](spark, SMALL).collect():
        assert r.base_sha256 == sha(listing(base_secrets(texts[r.doc_id] or "")))
    for r in registry()["op9_weak_pii"](spark, SMALL).collect():
        assert r.base_sha256 == sha(listing(base_pii(texts[r.doc_id] or "")))


def test_fingerprints_and_components(spark, texts):
    prints = {i: brute_simhash(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry()["op5_covering_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_benchmark_windows(spark, texts):
    grams = {}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = brute_windows(r.text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            grams.setdefault(tuple(words[i : i + n]), set()).add(str(r.item_id))
    for r in registry()["op7_window_decontamination"](spark, SMALL).collect():
        words, hit, items = brute_windows(texts[r.doc_id]), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(words) - n + 1):
                found = grams.get(tuple(words[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(items), sha(",".join(sorted(items))))


def test_tokens_of_a_whole_table(spark, texts):
    path, pattern = byte_bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for r in registry()["op10_byte_bpe"](spark, SMALL).collect():
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_characters_split_over_blocks_and_lone_bytes():
    coder = byte_bpe.codec(*byte_bpe.default_vocabulary())
    ids = [coder.fst.ranks[bytes([b])] for b in "aé😀z".encode()]
    pieces = list(coder.stream([[i] for i in ids]))
    assert pieces == ["a", "é", "😀", "z"]
    broken = [coder.fst.ranks[bytes([b])] for b in b"a\xf0\x9fz\xff"]
    kept = "".join(coder.stream([[i] for i in broken], "surrogateescape")).encode("utf-8", "surrogateescape")
    assert kept == b"a\xf0\x9fz\xff"


def test_pairs_of_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 10)
    coder = byte_bpe.Codec(*byte_bpe.default_vocabulary())
    coder.encode("an unusual zxqvy wordlikething and otherstrangethings")
    assert len(coder.fst.suits) <= 10


def test_cached_strings_take_bounded_memory():
    tracemalloc.start()
    ids = byte_bpe._Ids(lambda piece: piece.encode())
    for i in range(600_000):
        ids[f"{i:08d}"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids["00599999"] == b"00599999" and peak < 50e6


def test_tokens_and_sketches_go_to_python_by_rows(spark):
    path, pattern = byte_bpe.default_vocabulary()
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    found = byte_bpe.tokenise(docs, path, pattern)
    marked = docs.select("text", minhash.signature(F.col("text"), simhash.TEXTS).alias("s"), minhash.shingle_set(F.col("text"), 5).alias("set"))
    for df in (found, marked.select("s.*", "set")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 1
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = [(k, own.encode_ordinary(t or "")) for k, t in ODD]
    assert sorted(map(repr, found.collect())) == sorted(repr(Row(doc_id=k, n_tokens=len(ids), ids=ids, exact=True)) for k, ids in want)
    sketcher = minhash.Sketcher(simhash.TEXTS)
    for r in marked.collect():
        hashes = minhash.shingle_hashes(r.text)
        assert r.set == hashes.view(np.int64).tolist() and r.s["keys"] == sketcher.keys(hashes).tolist()
        assert (bytes(r.s["digest"]), r.s["size"]) == (xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes))


def newton(x, target, keep, clip, iterations=400):
    """Another way to the same minimum: plain gradient steps with a backtracking line search, from zero."""
    beta = np.zeros(x.shape[1])
    loss = lambda b: np.mean(np.logaddexp(0, x @ b) - target * (x @ b)) + (keep * b * b).sum() / 2
    for _ in range(iterations):
        slope = x.T @ (1 / (1 + np.exp(-x @ beta)) - target) / len(x) + keep * beta
        step, now = 8.0, loss(beta)
        while step > 1e-9 and loss(beta - step * slope) > now - step / 2 * (slope @ slope):
            step /= 2
        beta = beta - step * slope
    return beta


def test_classifiers_reach_the_minimum():
    rng = np.random.default_rng(3)
    x = rng.random((300, 4))
    target = np.clip(x[:, 0] * 0.6 + x[:, 1] * 0.3, 0, 1)
    model = toxicity.train(toxicity.held(x, np.arange(300)), 4, lambda _, row: target[row])
    keep = np.array([toxicity.PENALTY] * 4 + [1e-9])
    full = np.column_stack([x, np.ones(len(x))])
    score = lambda b: 1 / (1 + np.exp(-full @ b))
    assert np.abs(score(np.array([*model.weights, model.bias])) - score(newton(full, target, keep, None, 4000))).max() < 0.02
    label = (x[:, 2] > 0.5).astype(int)
    padded = np.column_stack([x, np.zeros((300, len(quality.FEATURES) - 4))])
    ranking = quality.fit(padded, label)
    i, j = np.repeat(np.flatnonzero(label == 1), (label == 0).sum()), np.tile(np.flatnonzero(label == 0), label.sum())
    scale = padded.std(0) + 1e-3
    beta = newton((padded[i] - padded[j]) / scale, np.ones(len(i)), np.full(padded.shape[1], quality.PENALTY), None, 300)
    order = lambda w: np.argsort(padded @ w)
    assert np.corrcoef(padded @ np.array(ranking.weights), padded @ (beta / scale))[0, 1] > 0.99 and len(order(beta)) == 300


def test_unlabelled_rows_teach_a_voter():
    """A voter that no labelled row has gets its weight from the texts on which voters agree."""
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, y, rng.random(4000) < 0.02).astype(float)
    x = np.column_stack([vote(0.9), vote(0.9), vote(0.8)])
    label = np.full(4000, -1)
    label[:200] = y[:200]
    x[:200, 2] = 0
    assert toxicity.fit(toxicity.held(x, label), 3).weights[2] > 0.5 > toxicity.fit(toxicity.held(x[:200], label[:200]), 3).weights[2]


def test_quality_cut_covers_all_labelled_rows(spark):
    rows = [(i, [float(i % 97)] + [0.0] * (len(quality.FEATURES) - 1), int(i % 97 >= 40)) for i in range(3000)]
    scored = spark.createDataFrame([(i, f) for i, f, _ in rows], "key long, features array<float>")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "label_key long, label int")
    model = quality.learned(scored, labels, 200)
    wrong = sum((model.weights[0] * (i % 97) >= model.cut) != bool(y) for i, _, y in rows)
    assert wrong == 0


def test_added_spans():
    found = {k for _, k, _ in ((a, secrets.RULES[i].kind, b) for a, i, b in secrets.scan_block(__import__("pyarrow").array(["x ghp_" + "a" * 36 + " xoxb-1234567890-abc AIza" + "b" * 35 + " sk_live_" + "c" * 24 + " -----BEGIN RSA PRIVATE KEY-----"]), secrets.RULES)[0])}
    assert {"github", "slack", "google", "stripe", "pem"} <= found
    for rule in secrets.EXTRA:
        for t in ("plain words only", "gh", "AIza", "eyJ.eyJ."):
            assert not re.search(rule.pattern, t)


def test_added_personal_data_needs_votes(spark):
    rows = [(i, f"call (212) 555-{1000 + i} or write; ssn 123-45-{6000 + i}") for i in range(50)] + [(100 + i, f"item 123-45-{6000 + i} of list") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find(docs).collect():
        text = dict(rows)[r.doc_id]
        spans = [(s.start, s.end) for s in r.added]
        assert all(0 <= a < b <= len(text) for a, b in spans)
        assert not any(a < d and c < b for a, b in spans for c, d in ((s.start, s.end) for s in r.base))


def jaccard(a, b):
    a, b = minhash.shingles(a), minhash.shingles(b)
    return len(a & b) / len(a | b)


def test_covering_tables_over_places():
    layout = simhash.TEXTS
    rng = np.random.default_rng(6)
    for _ in range(300):
        bad = set(rng.choice(layout.places, 17, replace=False).tolist())
        assert any(not bad.intersection(t) for t in layout.tables)
    sketcher, met, all_ = minhash.Sketcher(layout), 0, 0
    for _ in range(400):  # pairs of similarity 0.8: 400 of 500 hashes shared
        shared = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        one, two = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])) for _ in range(2))
        met += bool((sketcher.keys(one) == sketcher.keys(two)).any())
        all_ += 1
    assert met / all_ > 0.97


def test_recall_of_the_stage_on_a_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, minhash.shingles(r.text)) for r in docs.collect()]
    where, links, sizes = {}, set(), {i: len(own) for i, own in rows}
    for i, own in rows:
        counts = {}
        for s in own:
            for j in where.get(s, ()):
                counts[j] = counts.get(j, 0) + 1
            where.setdefault(s, []).append(i)
        links |= {(j, i) for j, n in counts.items() if n * 1000 >= 800 * (len(own) + sizes[j] - n)}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    kept = {r.doc_id for r in simhash.representatives(docs).select("doc_id").collect()}
    assert kept == {i for i in parent if find(i) == i}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    rows = [(k, t, 1, "a", "b", 2, 3, 4, 5, 6, 7, 8, len(t or "")) for k, t in ODD]
    docs = spark.createDataFrame(rows, CLASHING).repartition(4)
    kept = stage(spark, docs, SMALL)
    found = kept.collect()
    if name != "tokens":
        assert kept.columns == docs.columns
    if name in ("decontamination", "secrets", "tokens"):
        assert len(found) == len(ODD)
    if name == "near_duplicates":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 3), (False, 4), (False, 6), (False, 7), (True, 0)]
    empty = stage(spark, docs.limit(0), SMALL)
    assert empty.count() == 0


def test_long_text_takes_the_exchange_path(spark):
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "clean text here")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words[700:712])), (10, "w5 w6")], "item_id long, text string")
    for most in (1 << 26, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench, most_broadcast=most).collect()}
        assert got == {1: (20_000, 14, ["10", "9"]), 2: (3, 0, [])}
    assert docs.where(F.length("text") < 0).count() == 0
