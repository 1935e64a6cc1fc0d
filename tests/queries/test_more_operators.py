"""Operators beyond SQL, against brute force and small cases."""

import random

from tamis.functions import grams as G
from tamis.functions.html import page_text
from tamis.operators import minhash
from tamis.sources import jsonl
from tamis.streaming import events as stream


def jaccard(a, b):
    a, b = minhash.shingles(a), minhash.shingles(b)
    return len(a & b) / len(a | b)


def test_minhash_groups_equal_brute_force(spark):
    draw = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    texts = []
    for _ in range(30):
        words = draw.choices(vocabulary, k=200)
        changed = list(words)
        changed[100] = "zzz"
        texts += [" ".join(words), " ".join(words).upper(), " ".join(changed), " ".join(draw.choices(vocabulary, k=200))]
    texts += ["", None, "12 34", "56 78"]
    docs = spark.createDataFrame([(i, t, "src1" if i % 4 == 1 else "src2") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a or "", texts[j] or "") >= 0.9:  # the made pairs lie well over the bound, all others far below it
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    want = {i: (min(g, key=lambda k: (k % 4 != 1, k)), len(g)) for g in groups.values() for i in g}
    got = {r["doc_id"]: (r["lead"], r["size"]) for r in minhash.near_duplicates(docs, [docs["source"]]).collect()}
    assert got == want
    assert minhash.near_duplicates(docs.limit(0), [docs["source"]]).count() == 0


def test_minhash_links_follow_the_exact_similarity(spark, monkeypatch):
    """Texts around the bound, and texts that share a passage with each other and with a head that resembles none of them."""
    draw = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    texts = []
    for changes in (2, 3, 4, 5, 6, 7) * 6:  # similarities from 0.90 down to 0.70
        words = draw.choices(vocabulary, k=200)
        texts.append(" ".join(words))
        for at in range(changes):
            words[10 + 25 * at] = "zzz"
        texts.append(" ".join(words))
    passage = draw.choices(vocabulary, k=150)
    texts.insert(0, " ".join(passage))
    for _ in range(12):
        own = [*passage, *draw.choices(vocabulary, k=70)]
        texts.append(" ".join(own))
        texts.append(" ".join([*own[:-1], "zzz"]))
    rows = [(i, t) for i, t in enumerate(texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small, rows in ((8, 512), (1, 7)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
        got = {r["doc_id"]: r["lead"] for r in minhash.near_duplicates(docs, []).collect()}
        assert got == {i: root(i) for i in range(len(texts))}


def test_pages_become_text():
    page = "<style>p{}</style><h1>A  b</h1><p>one<br>two &amp; <b>three</b></p><ul><li>x<ol><li>y</li></ol></li></ul><blockquote><p>q</p></blockquote><table><tr><td>1</td><td>2</td></tr></table><pre>k\n  l</pre>"
    assert page_text(page).split("\n") == ["A b", "one", "two & three", "- x", "  1. y", "> q", "1 | 2", "k", "  l"]
    assert page_text(None) == page_text("") == page_text("<script>x") == ""


def test_late_text(spark):
    rows = [("As an AI model, I", True, False), ("in 2024.", False, True), ("v.2024 12023 20245", False, False), ("I’m a chatbot", True, False), ("", False, False), (None, False, False)]
    df = spark.createDataFrame(rows, "text string, phrase boolean, year boolean")
    assert df.where((G.model_phrase(df["text"]) != df["phrase"]) | (G.late_year(df["text"]) != df["year"])).count() == 0


def test_repeats_are_counted_at_the_bound(spark):
    df = spark.createDataFrame([(["a", "a", "b"], False), (["a", "a", "a"], True), ([], False), (["a", "b", "b", "b"], True)], "s array<string>, want boolean")
    assert df.where(G.has_repeat(df["s"], 3) != df["want"]).count() == 0


def test_bad_lines_are_rows_with_a_reason(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n\n{"id": \n')
    rows = jsonl.read(spark, str(tmp_path), spark.createDataFrame([], "id string").schema).collect()
    assert sorted((r["id"], r["reason"], r["raw_bytes"]) for r in rows if r["id"]) == [("x", None, None)]
    assert [(r["reason"], r["raw_bytes"]) for r in rows if not r["id"]] == [("bad_json", 7)]


def test_streams_do_not_depend_on_batches(spark, tmp_path):
    rows = [(1, "src2", "a"), (2, "src1", "a"), (3, "src3", "b"), (4, "src3", "b"), (5, "src1", None)]
    for i in (0, 3):
        spark.createDataFrame(rows[i : i + 3] if i == 0 else rows[3:], "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r["doc_id"] for n in (1, 10) for r in stream.first_documents(spark, str(tmp_path / "in"), "*.parquet", n).collect()}
    assert got == {2, 3, 5}


def test_heaviest_phrases_equal_brute_force_however_few_slots_there_are(spark):
    from collections import Counter

    from tamis.operators import phrases

    draw = random.Random(5)
    texts = [None, "", "one", "a'b a'b a'b", *(" ".join(draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(draw.randint(1, 40))) for _ in range(60))] * 2
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for sizes, by_text, slots, first in (((2, 3, 4), False, 256, 3), ((2, 3, 4), False, 64, 1), ((2,), True, 128, 5), ((3, 2), True, 1 << 10, 1 << 12)):
        each = [[" ".join(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)] for w in ((t or "").split() for t in texts)]
        n = Counter(p for own in each for p in (set(own) if by_text else own))
        want = sorted(((p, c, p.count(" ") * c) for p, c in n.items()), key=lambda x: (-x[2], x[0]))
        for most in (7, 40, len(want) + 5):
            got = phrases.heaviest(rows, sizes, most, by_text=by_text, slots=slots, first=first)
            assert [tuple(r) for r in got.collect()] == want[:most]
    assert not phrases.heaviest(rows.where("text is null"), (2, 3), 9).collect()


def _files_read(spark, query, folder):
    spark.createDataFrame([(i, f"x{chr(97 + i % 26)} y{chr(97 + i // 26)} of the z") for i in range(200)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return query(spark, str(folder)).inputFiles()


def test_phrase_gains_ranks_a_table_of_the_heaviest_instead_of_all_phrases(spark, tmp_path):
    from tamis.plans import judging

    assert not [f for f in _files_read(spark, judging.phrase_gains, tmp_path) if "documents.parquet" in f]


def test_word_pairs_ranks_a_table_of_the_commonest_instead_of_all_pairs(spark, tmp_path):
    from tamis.plans import measures

    assert not [f for f in _files_read(spark, measures.word_pairs, tmp_path) if "documents.parquet" in f]


def test_shingle_hashes_are_those_of_the_joined_words_and_fold_each_character_once(monkeypatch):
    import unicodedata
    from types import SimpleNamespace

    texts = [None, "", "...", "a b", "a  B c", "a b c d e", "a b c d e f a b c d e", "a_b É00 100 x", "x\x1cy\x00z 1000 a0b00c", "１２ ٣٤ ﬁ ™ İ ß ̈a", "\ud800 q"]
    for text in texts:
        want = {minhash.xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in minhash.shingles(text)}
        assert minhash.shingle_hashes(text).tolist() == sorted(want)
    assert minhash.folded("É00 100 ×٣٤ İx_007") == "e0 0 ×0 ix_0" and minhash.folded("A0b00C1000") == "a0b0c0"
    asked = []
    category = lambda c: asked.append(c) or unicodedata.category(c)
    monkeypatch.setattr(minhash, "unicodedata", SimpleNamespace(normalize=unicodedata.normalize, category=category))
    assert minhash.folded("é à " * 500) == "e a " * 500 and len(asked) <= 5
