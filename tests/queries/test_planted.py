"""Checks of planned conversations, licences named by texts, and relabelled logs."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tamis.functions import licences
from tamis.operators import books, planted


def test_planned_conversations(spark):
    turns = spark.createDataFrame(
        [(1, 0, "My friend is Tall Bo."), (1, 1, "Not bob"), (1, 2, "TALL, bo"), (1, 3, "who?"), (1, 4, "It was ann; I count two"), (2, 0, None), (2, 3, "tall bo?"), (2, 4, "tall bo, once two, one")],
        "conv_id long, turn int, text string",
    )
    values = spark.createDataFrame([(1, "Tall Bo"), (1, "Ann"), (2, "Tall Bo"), (2, ""), (3, "Ann")], "conv_id long, value string")
    assert sorted(tuple(r) for r in planted.mentions(turns, values).collect()) == [(1, "Ann", 4), (1, "Tall Bo", 0), (1, "Tall Bo", 2), (2, "Tall Bo", 3), (2, "Tall Bo", 4)]
    schedule = spark.createDataFrame([(1, "Tall Bo", 1), (1, "Ann", 0)], "conv_id long, value string, turn int")
    events = spark.createDataFrame(
        [(1, "e", "Tall Bo", 1, 3, 4, ["Ann"]), (2, "e", "Tall Bo", 0, 3, 4, []), (3, "e", "Tall Bo", 0, 3, 4, ["x"])],
        "conv_id long, event string, answer string, last_set int, query int, answered int, stale array<string>",
    )
    found = planted.event_codes(turns, schedule, events).collect()
    assert sorted((r.code, r.conv_id, r.turn, r.event) for r in found) == [
        ("ANSWER_STALE", 1, 4, "e"), ("ANSWER_WRONG", 1, 4, "e"), ("DIST_LEAK", 1, 2, "e"), ("QUERY_RESTATES", 2, 3, "e"), ("VALUE_EARLY", 1, 0, None),
    ]
    changes = spark.createDataFrame([(1, "b", "x", 0, "add"), (1, "b", "y", 0, "add"), (1, "b", "y", 2, "remove"), (1, "b", "y", 2, "add"), (1, "b", "z", 3, "add"), (2, "b", "x", 0, "add")], "conv_id long, event string, item string, turn int, op string")
    asked = spark.createDataFrame([(1, "b", 3, 4), (2, "b", 3, 4), (3, "b", 3, 4)], "conv_id long, event string, query int, answered int")
    assert sorted(tuple(r) for r in planted.list_codes(turns, changes, asked).collect()) == [(1, "b", 4, 1, "LIST_STATE"), (2, "b", 4, 1, "LIST_STATE")]
    # an answer that isn't there breaks nothing, here conversation 3's
    assert planted.event_codes(turns.limit(0), schedule, events).count() == 0 == planted.list_codes(turns.limit(0), changes, asked).count()


def test_licences_that_texts_name(spark):
    texts = ["x\nLicensed under the Apache License, Version 2.0.\ny", "Released under the MIT License.", "This is licenced under CC BY-NC 4.0", "licensed under CC BY-SA 4.0.", "no", None, "licensed under "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", licences.in_text(F.col("t")).alias("own"), licences.canonical(licences.in_text(F.col("t"))).alias("c"))
    assert [(r.own, r.c) for r in rows.orderBy("i").collect()] == [
        ("Apache 2.0", "apache-2.0"), ("MIT", "mit"), ("CC BY-NC 4.0", None), ("CC BY-SA 4.0", "cc-by-sa-4.0"), (None, None), (None, None), (None, None),
    ]


def plain_log(log, common=()):
    """The published rules, line by line."""
    lines = [re.sub(r"^\[\d{1,2}:\d{2}(?::\d{2})?\]\s?", "", x).strip() for x in re.split("\r\n|\r|\n", log)]
    lines = [x for x in lines if x and not x.startswith("===")]
    marks = [re.match(r"^<([^>\s]{1,40})>\s?|^\*\s+([^\s*]{1,40})(?:\s|$)", x) for x in lines]
    who = [(m[1] or m[2]).lower() if m else None for m in marks]
    body = [x[m.end() :].strip() if m else x for x, m in zip(lines, marks)]
    spoke = Counter(w for w in who if w)
    label = {w: f"P{i}" for i, w in enumerate(dict.fromkeys(w for w in who if w), 1)}
    name = r"[A-Za-z0-9_\[\]\\`^{|}-]+"
    said = Counter(w.lower() for b in body for w in re.findall(name, b))
    hide = {w for w in label if len(w) > 2 and w not in common and said[w] <= 3 * spoke[w] + 5}
    body = [re.sub(name, lambda m: label[m[0].lower()] if m[0].lower() in hide else m[0], b) for b in body]
    return "\n".join(b if w is None else f"* {label[w]} {b}".rstrip() if x.startswith("*") else f"{label[w]}: {b}".rstrip() for b, w, x in zip(body, who, lines))


def test_logs_are_relabelled_as_the_rules_say(spark):
    logs = [
        "[10:00] <Ann> hi bob, ask ANN\r\n[10:01]  * bob waves at ann\n=== x is now y\n<al> al and help\nplain bob line\n<help> help bob_ [bob] bob",
        "<sudo> x\n" + "sudo sudo sudo\n" * 5, "* dot\n<q>\n<quiet>   ", "é <x> no", "<a\\b> hey a\\b {c}|d",
    ]
    df = spark.createDataFrame([*enumerate(logs), (None, logs[0])], "id long, log string")
    common = spark.createDataFrame([("help",), ("Help",)], "word string")
    for words in (None, common):
        got = [(r.id, r.log) for r in books.relabelled_logs(df, "id", "log", words).collect() if r.id is not None]
        assert dict(got) == {i: plain_log(x, ("help",) if words is not None else ()) for i, x in enumerate(logs)}


def test_mentions_are_made_once_and_nothing_is_broadcast(spark, sf_dir):
    from tamis.plans import turns

    query = turns.planned_events(spark, sf_dir)
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "lambda" not in query._jdf.queryExecution().optimizedPlan().toString()
