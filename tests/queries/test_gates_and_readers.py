"""Rules at their bounds, readers on planted files, and operators beyond SQL against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tamis.functions import cleaning as C
from tamis.functions import dates as D
from tamis.functions import licences as L
from tamis.functions.html import page_text
from tamis.operators import books, checks, dedup, minhash, ordered, packing, planning, sampling
from tamis.session import Scratch
from tamis.sources import readers


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    values = ["2022-11-30T23:59:59", "2022-12-01", "2022-13-01", "2022-00-10", "x", "", None, " 2020-01-01 "]
    assert column(spark, values, D.iso_status) == ["ok", "post_cutoff", "unparseable", "unparseable", "unparseable", "undated", "undated", "ok"]
    written = ["Mar 26, 2024", "Published on December 13, 2021", "1st December 2022", "26 July 2015 at 18:13", "08 Jul", "1862", "2022-11", "02-30-2020", "2021-02-29", "3 of May 2019", "08/27/2020"]
    assert column(spark, written, lambda v: D.parsed(v, True)) == ["2024-03-26", "2021-12-13", "2022-12-01", "2015-07-26", None, "1862", "2022-11", None, None, "2019-05-03", "2020-08-27"]
    assert column(spark, ["08/27/2020"], D.parsed) == [None]
    assert column(spark, ["2022", "2021", "2022-11", "2022-12", "2022-11-30"], D.gate) == ["post_cutoff", "ok", "ok", "post_cutoff", "ok"]
    assert column(spark, ["https://me@www.Globalvoices.org:80/2004/10/26/slug/", "x"], D.host) == ["globalvoices.org", ""]
    assert column(spark, ["https://a.org/2004/10/26/s/", "https://a.org/2004/2/s", "https://a.org/2004/13/1/"], D.in_url) == ["2004-10-26", "2004-02", None]


def test_licences(spark):
    values = ["Public Domain", "CC-BY-SA 3.0", "https://creativecommons.org/licenses/by-nc/4.0/", "Creative Commons Attribution", "cc0", "MIT", None, "see https://creativecommons.org/licenses/by/4.0/legal"]
    assert column(spark, values, L.canonical) == ["public-domain", "cc-by-sa-3.0", None, None, "cc0", "mit", None, "cc-by-4.0"]
    rows = spark.createDataFrame([("MIT", ["MIT", None]), ("MIT", ["bad", None]), (None, []), ("MIT", [])], "w string, p array<string>")
    assert [r[0] for r in rows.select(L.composite_reason(F.col("w"), F.col("p"))).collect()] == ["license_component_missing", "license", "license", None]
    assert column(spark, ["2011-04-07", "2011-04-08", "2018-05-02"], L.by_era) == ["cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0"]


def test_clean_up(spark):
    assert column(spark, ["é\r\na \t\r\n\n\n\n\nb\x00  ", "é", None, " x "], C.normalized) == ["é\na\n\nb", "é", None, "x"]
    assert column(spark, ["a\n| |\n|\nb | c", "||"], C.without_bars) == ["a\nb | c", ""]
    assert column(spark, ["see [here](http://x.org) **b** *i* `c`"], C.comment_text) == ["see here b i c"]
    assert column(spark, [" a \n\t b  `c` "], C.comment_text) == ["a b c"]
    assert column(spark, ["<|user|>x<think>", "plain", None], C.control_strings) == [2, 0, 0]
    text = "front\n\n" + "m" * 50 + "\n\nmiddle\n\n" + "n" * 50 + "\n\nback"
    assert column(spark, [text, "short", None, "é" * 40], lambda v: C.middle(v, 60)) == ["middle", "short", None, "é" * 30]


def greedy(rows):
    texts, ids, out = set(), set(), {}
    for at, t, i in sorted(rows):
        reason = "dup_exact" if t is not None and t in texts else "dup_id" if i is not None and i in ids else "kept"
        out[at] = reason
        if reason == "kept":
            texts.add(t)
            ids.add(i)
    return out


def test_greedy_scan(spark):
    draw = random.Random(2)
    rows = [(n, draw.choice(["a", "b", "c", "d", "e", None]), draw.choice(["1", "2", "3", "4", "5", "6", None])) for n in range(60)]
    got = dedup.greedy_reasons(spark.createDataFrame(rows, "at int, t string, i string"), ["at"], "t", "i")
    assert {r["at"]: r["reason"] for r in got.collect()} == greedy(rows)


def test_places_do_not_depend_on_partitions(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["hot", "hot", "hot", "x", None]), draw.randrange(50), n) for n in range(500)]
    want = {}
    for g in ("hot", "x", None):
        total = 0
        for at, (_, v, n) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            total += v
            want[n] = (at, total)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, v int, n int").repartition(parts)
        got = ordered.placed(df, "g", [F.col("v"), F.col("n")], "v").collect()
        assert {r.n: (r.place, r.running) for r in got} == want
    assert ordered.placed(df.limit(0), "g", [F.col("v")]).count() == 0


def test_tied_units_stay_together(spark):
    rows = [("s", 0.1, 10, 1), ("s", 0.2, 10, 2), ("s", 0.2, 10, 3), ("s", 0.3, 10, 4), ("t", 0.5, 100, 5)]
    df = spark.createDataFrame(rows, "g string, u double, b long, id long")
    got = {r.id: r.held_out for r in sampling.held_out_prefix(df, "g", "u", "b", F.lit(20.0), "id").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_plans(spark):
    def targets(rows, total, fill=False):
        groups = spark.createDataFrame(rows, "name string, supply double, share double")
        return {r.name: r.target for r in planning.group_targets(groups, total, fill).collect()}

    assert targets([("a", 50.0, 0.5), ("b", 100.0, 0.5)], 150.0) == pytest.approx({"a": 50.0, "b": 50.0})
    assert targets([("a", 50.0, 0.5), ("b", 500.0, 0.5)], 150.0, True) == {"a": 50.0, "b": 100.0}
    # one short group makes another one short; all short; no supply and no share
    assert targets([("a", 10.0, 0.5), ("b", 45.0, 0.3), ("c", 900.0, 0.2), ("d", 5.0, 0.0)], 100.0, True) == pytest.approx({"a": 10.0, "b": 45.0, "c": 45.0, "d": 0.0})
    assert targets([("a", 10.0, 0.5), ("b", 20.0, 0.5), ("c", None, None)], 100.0, True) == {"a": 10.0, "b": 20.0, "c": 0.0}
    assert targets([("a", 1000.0, 1.0), ("b", None, 1.0)], 100.0) == {"a": 0.0, "b": 0.0}
    assert planning.nearest_mix([("1", "B"), ("2", "A"), ("3", "C"), ("4", "B")], {"A": 0.5, "B": 0.5}, 3, "A") == ["2", "1", "3"]
    assert planning.nearest_mix([("1", "B")], {"B": 1.0}, 2, "A") is None


def test_packing(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([7, 3, 5, 5, 2, 8, 11, 0])], "id long, n int")
    every = packing.packed(rows, "id", "n", 10, 1).collect()
    assert {r["id"]: r["reason"] for r in every if r["reason"]} == {6: "too_long", 7: "empty"} and len(every) == 8
    got, held = [r for r in every if not r["reason"]], {}
    for r in got:
        held.setdefault(r["bin"], []).append((r["offset"], [7, 3, 5, 5, 2, 8][r["id"]]))
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4, 5] and len(held) == 3
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 10
    tokens = spark.createDataFrame([(0, [5, 4, 9, 9, 4, 4, 7])], "shard int, ids array<int>")
    assert [(r.start, r.tokens) for r in packing.documents_of(tokens, 4).orderBy("doc").collect()] == [(0, 2), (2, 3), (5, 1), (6, 1)]
    order = packing.loader_order([0.5, 0.5], [[10] * 5, [5] * 10], 9)
    assert order.count(1) == 2 * order.count(0) and packing.loader_order([1.0], [[1]], 3) == [0]


def test_first_fits_are_those_of_a_scan():
    import numpy as np

    sizes, room, want = np.sort(np.random.default_rng(2).integers(1, 50, 400))[::-1], [], []
    for n in sizes:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        room += [64] * (at == len(room))
        want.append((at, 64 - room[at]))
        room[at] -= n
    bins, offsets = packing.first_fits(sizes, 64)
    assert list(zip(bins.tolist(), offsets.tolist())) == want
    assert packing.first_fits(np.array([5]), 10)[0].tolist() == [0] and not len(packing.first_fits(np.array([], int), 10)[0])


def test_rows_that_share_a_key_keep_their_lines(spark):
    rows = [(1, "a\nbad\nb"), (1, "c\nbad"), (1, "c\nbad"), (None, "bad\nx"), (2, None), (3, "")]
    bad = spark.createDataFrame([("bad",)], "l string").select(F.sha2(F.col("l").cast("binary"), 256).alias("line_hash"))
    got = dedup.without_lines(spark.createDataFrame(rows, "doc_id long, text string"), bad).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "a\nb"), (1, "c"), (1, "c"), (None, "x"), (2, None), (3, "")]))


def test_templates_learn_assistants_only(spark):
    rows = spark.createDataFrame([([("user", [11, 12]), ("assistant", [13])],)], "t array<struct<role:string,ids:array<int>>>")
    got = rows.select(packing.templated(F.col("t"), {"user": 2, "assistant": 3}, 4).alias("x")).head().x
    assert [(p.id, p.target) for p in got] == [(2, False), (11, False), (12, False), (4, False), (3, False), (13, True), (4, True)]


def test_checks_find_planted_faults(spark):
    planted = {
        "EMPTY_TURN": " ", "DASH": "well -- no more of it", "DIGIT": "it was 5 of them", "MARKDOWN": "see\n- this and that", "EMOJI": "so good \U0001f600 to see", "THOUGHT_TAG": "<think> it is so",
        "ROLE_LABEL": "User: what is it", "STAGE_DIR": "*smiles warmly* and so on", "END_TOKEN": "that is it. END", "LEN": "no", "REPEAT_4GRAM": "we go to it and we go to it and we go to it",
        "CONSEC_REP": "so we go so we go so we go so we go", "NON_ENGLISH": "a café for us", "NO_STOPWORD": "xa xb xc xd xe xf xg xh", "AI_ISM": "Great question, that is it", "DEFLECT": "I don’t remember that at all", "ASSIST_CASE": "lower case is what it is",
    }
    rows = spark.createDataFrame([(code, "assistant", text) for code, text in planted.items()] + [("none", "assistant", "This is what we say to you."), ("null", "user", None)], "want string, role string, text string")
    found = {r.want: r.codes for r in checks.checked(rows).collect()}
    assert all(code in found[code] for code in planted) and found["none"] == [] and "EMPTY_TURN" in found["null"]


def test_long_turns_are_checked_in_time(spark):
    """Twenty thousand words: a regular expression inside a lambda would run once for each of them."""
    import time

    text = " ".join(f"w{'abcdefgh'[i % 8]}{'ijklmn'[i % 6]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))
    rows = spark.createDataFrame([("assistant", text)], "role string, text string")
    began = time.time()
    assert checks.code_table(checks.checked(rows)).count() > 0
    assert time.time() - began < 60


def test_trees_become_messages(spark, tmp_path):
    tree = {"message_tree_id": "t", "tree_state": "ready", "prompt": {"message_id": "a", "role": "prompter", "lang": "en", "text": "hi", "replies": [
        {"message_id": "b", "role": "assistant", "lang": "en", "text": "x", "rank": 1, "labels": {"spam": {"value": 0.9}}}, {"message_id": "c", "role": "assistant", "lang": "en", "text": "y", "rank": 0, "deleted": True}]}}
    (tmp_path / "t.jsonl").write_text(json.dumps(tree) + "\n\nnot json\n")
    got = {r.id: (r.parent, r.place, r.role, r.problem) for r in readers.usable(readers.message_trees(spark, str(tmp_path))).collect()}
    assert got["a"] == (None, 0, "user", None) and got["b"] == ("a", 0, "assistant", "spam") and got["c"] == ("a", 1, "assistant", "deleted") and None in got


def test_instruction_rows(spark):
    long = "the answer is what it is and that is all there is to say about it for now " * 4
    rows = [(1, "Say it", None, long), (2, "", "c", "x"), (3, "Say", " shared ", long), (4, "Do", "shared", "as an AI model " + long)]
    got = {r.id: (r.reason, r.split_key, len(r.turns)) for r in readers.instruction_rows(spark.createDataFrame(rows, "id long, instruction string, context string, response string")).collect()}
    assert got[1] == (None, "row:1", 2) and got[2][0] == "empty" and got[4][0] == "aiism" and got[3][1] == got[4][1]


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "in" / "web").mkdir(parents=True)
    (tmp_path / "in" / "web" / "a.txt").write_text("abc")
    (tmp_path / "in" / "b.txt").write_text("x")
    found = readers.discover(spark, str(tmp_path / "in"), {"web/": "web"}, "*.txt").collect()
    assert [(r.source, r.bytes) for r in found] == [("web", 3)]
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1" Body="&lt;p&gt;x" Score="3"/><row Id="2" PostTypeId="2" ParentId="1" Body="y"/></posts>')
    assert sorted((r.Id, r.PostTypeId, r.Body) for r in readers.posts(spark, str(tmp_path / "p.xml")).collect()) == [("1", "1", "<p>x"), ("2", "2", "y")]
    (tmp_path / "n.tsv").write_text('Porto\t5\n"q"\t6\n')
    assert sorted(tuple(r) for r in readers.tab_separated(spark, str(tmp_path / "n.tsv"), "name string, n int").collect()) == [('"q"', 6), ("Porto", 5)]
    counts = spark.createDataFrame([("a", 2)], "word string, n long")
    readers.write_counts(counts, str(tmp_path / "counts"), {"of": "test"})
    back, about = readers.read_counts(spark, str(tmp_path / "counts"))
    assert about == {"of": "test"} and [tuple(r) for r in back.collect()] == [("a", 2)]
    counts.write.parquet(str(tmp_path / "new"))
    assert readers.publish(spark, str(tmp_path / "new"), str(tmp_path / "final")) and (tmp_path / "final" / "_SUCCESS").exists()
    with pytest.raises(FileNotFoundError):
        readers.publish(spark, str(tmp_path / "new"), str(tmp_path / "final"))
    docs = spark.createDataFrame([(i, [i]) for i in range(20)], "id long, ids array<int>")
    readers.write_token_shards(docs, str(tmp_path / "shards"), 4, F.col("id"), "id")
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert again.where("shard <> id % 4").count() == 0 and len(list((tmp_path / "shards").glob("shard=*/*.parquet"))) == 4
    merged = readers.merged_counters(spark.createDataFrame([("n", 1), ("n", 2), ("max_x", 5), ("max_x", 3)], "name string, v int"), "name", "v")
    assert {r.name: r.v for r in merged.collect()} == {"n": 3, "max_x": 5}


def test_logs_lose_their_names(spark):
    log = "[12:01] <Anna> hi bob\n=== x joined\n<bob> anna: hello\n* anna waves\n<jo> jo is here\nserver note"
    want = "P1: hi P2\nP2: P1: hello\n* P1 waves\nP3: jo is here\nserver note"
    df = spark.createDataFrame([(1, log), (2, None), (3, "")], "id long, log string")
    assert {r.id: r.log for r in books.relabelled_logs(df, "id", "log").collect()} == {1: want, 2: None, 3: ""}


def test_values_are_masked_and_found(spark):
    values = {"red": "colour", "red hat": "thing", "Porto": "city"}
    assert column(spark, ["Red hats in Porto, not porto; bored reds"], lambda v: books.masked(v, values)) == [" <thing>  in  <city> , not porto; bored  <colour> "]
    spans = column(spark, ["red in Porto"], lambda v: books.value_spans(v, values))[0]
    assert [(s.start, s.end, s.type) for s in spans] == [(0, 3, "colour"), (7, 12, "city")]


def test_chains_are_cut_at_the_floor(spark):
    """Neighbours of a chain are alike, its ends are not: with a floor the far members form groups of their own."""
    words = [f"{a}{b}{c}" for a in "bdgklmnp" for b in "aeiou" for c in "lmnrst"]
    texts = [" ".join(words[i * 7 : i * 7 + 120]) for i in range(7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.lead for r in minhash.near_duplicates(docs, [], layout=minhash.bands(20, 3)).collect()}
    assert set(plain.values()) == {0}
    cut = {r.doc_id: (r.lead, r.kept) for r in minhash.near_duplicates(docs, [], layout=minhash.bands(20, 3), floor=0.8).collect()}

    def alike(a, b):
        a, b = minhash.shingles(texts[a]), minhash.shingles(texts[b])
        return len(a & b) / len(a | b)

    assert len({lead for lead, _ in cut.values()}) > 2 and all(alike(i, lead) >= 0.8 for i, (lead, _) in cut.items()) and all((i == lead) == kept for i, (lead, kept) in cut.items())
    rows = minhash.report(minhash.near_duplicates(docs, []), docs.withColumn("source", F.lit("s"))).collect()
    assert {(r.part, r.name): r.docs for r in rows if r.part != "size"} == {("kept", "s"): 1, ("dropped", "s"): 6} and [(r.name, r.docs) for r in rows if r.part == "size"] == [("5-8", 7)]


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 9, "x", 4), (1, "a b c d e f", 9, "x", 4), (2, "A B C D E F", 8, "y", 5), (None, "z", 7, "z", 6), (None, None, 7, "z", 6)], "doc_id long, text string, h1 int, H2 string, node int")
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.h1) for r in kept.collect()) == [(0, 7), (0, 7), (1, 9)]
    assert minhash.representatives(docs.limit(0)).count() == 0


def test_unclosed_elements_end_with_their_parent():
    assert page_text("<div><blockquote>q<p>r</div><p>s") == "> q\n> r\ns"
    assert page_text("<ol><li>a<li>b<ul><li>c</ul><li>d</ol>e") == "1. a\n2. b\n  - c\n3. d\ne"
    assert page_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1 | 2\n3"


def test_scratch_tables_go_by_name(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(3), "a")
    assert kept.count() == 3
    scratch.drop("a")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|exist"):
        spark.read.parquet(scratch.path("a")).count()


def test_books_are_read_and_split_once(spark):
    parts = spark.createDataFrame([(1, 0, "the cat and the dog are in the house"), (1, 1, "zzq xxv bbw ccr tty uuo ppl mmn"), (2, 0, "~~~~ the cat"), (3, 0, "")], "doc_id long, at int, p string")
    known = spark.createDataFrame([(w,) for w in "the cat and dog are in house".split()], "word string")
    found = books.book_reasons(parts, known)
    assert sorted(map(tuple, found.collect())) == [(1, 52, 28, None), (2, 6, 0, "ocr_mostly_junk"), (3, 0, 0, "ocr_low_words")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2
    docs = spark.createDataFrame([("version 1\nx\ny\nend",), (None,), ("",)], "text string")
    places = docs.select(books.matter_places(F.col("text"), lambda p: p.rlike("version|end"), "\n").alias("places"))
    assert [r.places for r in places.collect()] == [[0, 3], None, []]
    assert places._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_pages_go_to_python_by_rows(spark):
    from tamis.functions.html import html_text

    assert html_text.evalType == 100
    assert column(spark, ["<p>a</p><p>b", None], html_text) == ["a\nb", ""]
