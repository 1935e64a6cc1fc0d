"""Stems, windows and distribution functions against known values and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.functions import numeric
from tamis.functions.stems import stem, stems
from tamis.operators import windows


@pytest.mark.parametrize(
    "word,want",
    [w.split(":") for w in "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll".split()],
)
def test_published_examples(word, want):
    assert stem(word) == want


def test_stems_of_arrays(spark):
    rows = spark.createDataFrame([(["ponies", "A1", "of"],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(stems("w")).collect()] == [["poni", "A1", "of"], None, []]


def test_distributions():
    assert numeric.t_probability(0.0, 5) == 0.5
    for p, freedom, want in ((0.975, 1, 12.7062), (0.975, 10, 2.2281), (0.95, 30, 1.6973), (0.8, 24, 0.8569)):
        assert abs(numeric.t_quantile(p, freedom) - want) < 1e-4
    assert abs(numeric.upper_share(0, 10) - 0.308498) < 1e-6 and abs(numeric.upper_share(5, 20) - 0.491046) < 1e-5 and numeric.upper_share(3, 3) == 1.0


def test_windows_cover_the_text(spark):
    draw = random.Random(1)
    texts = ["", None, "x" * 500, "é" * 300, " ".join("abcdefg"[: draw.randrange(1, 8)] for _ in range(400)), "short"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = windows.text_windows(rows, 100, 150, 20).collect()
    for i, t in enumerate(texts):
        parts = sorted((r["at"], r.start, r.stop, r.context_start) for r in got if r.doc_id == i)
        assert [p[0] for p in parts] == list(range(len(parts))) and "".join(t[a:b] for _, a, b, _ in parts) == (t or "") if t else not parts
        for at, a, b, c in parts:
            assert len(t[a:b].encode()) <= 100 and len(t[c:a].encode()) <= 150
    spaced = [r for r in got if r.doc_id == 4]
    assert all(texts[4][r.stop - 1] == " " for r in spaced if r.stop < len(texts[4]))


def test_contexts_take_the_newest_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a" * 50), (1, 1, "assistant", "b" * 30), (1, 2, "user", "c" * 40), (1, 3, "assistant", "d" * 20), (1, 4, "user", None), (1, 5, "assistant", "e" * 200)], "conv_id long, turn int, role string, text string")
    got = {r.turn: (r.first, r.bytes) for r in windows.chat_windows(turns, 100).collect()}
    assert got == {1: (0, 80), 3: (1, 90), 5: (5, 200)}
    assert windows.chat_windows(turns.where(F.lit(False)), 100).count() == 0


def test_files_are_held_against_a_manifest(spark, tmp_path):
    import hashlib

    from tamis.sources import readers

    for name, text in (("a.txt", "abc"), ("b.txt", "abcd"), ("c.txt", "x"), ("e.txt", "y")):
        (tmp_path / name).write_text(text)
    digest = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("a.txt", 3, digest), ("b.txt", 3, digest), ("c.txt", 1, digest), ("d.txt", 1, digest)], "path string, bytes long, sha256 string")
    got = {r.path: r.state for r in readers.verified_files(spark, str(tmp_path), manifest).collect()}
    assert got == {"a.txt": "ok", "b.txt": "size", "c.txt": "hash", "d.txt": "missing", "e.txt": "unknown"}
