"""Line files by byte ranges and frames, with torn tails."""

import gzip
import json

import pytest
import zstandard

from tamis.sources import ranges


@pytest.fixture
def folder(tmp_path):
    rows = [{"doc_id": i, "text": f"line é {i} " + "x" * (i % 50), "extra": {"a": [i]}, "flag": i % 2 == 0} for i in range(300)]
    line = lambda r: json.dumps(r, ensure_ascii=False).encode() + b"\n"
    (tmp_path / "a.jsonl").write_bytes(b"".join(map(line, rows[:100])) + b"\n\n" + b"".join(map(line, rows[100:150])) + b'{"doc_id": 999, "te')
    (tmp_path / "b.jsonl.gz").write_bytes(b"".join(gzip.compress(b"".join(map(line, rows[at : at + 10]))) for at in range(150, 200, 10)))
    frames = b"".join(zstandard.compress(b"".join(map(line, rows[at : at + 10]))) for at in range(200, 250, 10))
    (tmp_path / "c.jsonl.zst").write_bytes(frames)
    cut = gzip.compress(b"".join(map(line, rows[250:300])))
    (tmp_path / "d.jsonl.gz").write_bytes(gzip.compress(line({"doc_id": 1000, "text": 5})) + cut[: len(cut) // 2])
    (tmp_path / "e.jsonl").write_bytes(b"[1]\nnot json\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no\n")
    return tmp_path, rows


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_every_line_once_whatever_the_ranges(spark, folder, size):
    path, rows = folder
    ranges.register(spark)
    read = spark.read.format("json_ranges").schema("doc_id long, text string, _state string, _file string, _at long").option("rangeBytes", size)
    if size == 1:  # a task for each byte: of one small file only
        assert [r._state for r in read.load(str(path / "e.jsonl")).collect()] == ["bad", "bad"]
        return
    found = read.load(f"file://{path}").collect() if size == 64 else read.load(str(path)).collect()
    got = {r.doc_id: r.text for r in found if r._state == "ok"}
    assert {i: got[i] for i in range(250)} == {r["doc_id"]: r["text"] for r in rows[:250]} and 999 not in got
    assert got[1000] == "5" and len([r for r in found if r._state == "ok"]) == len(got)
    torn = {r._file.rsplit("/", 1)[1] for r in found if r._state == "torn"}
    assert torn == {"a.jsonl", "d.jsonl.gz"} and sum(r._state == "bad" for r in found) == 2


def test_only_named_fields_and_errors_without_a_state(spark, folder):
    path, _ = folder
    ranges.register(spark)
    first = spark.read.format("json_ranges").schema("extra string, flag boolean, doc_id double").load(str(path / "b.jsonl.gz")).orderBy("doc_id").head()
    assert tuple(first) == ('{"a": [150]}', True, 150.0)
    with pytest.raises(Exception, match="torn line"):
        spark.read.format("json_ranges").schema("doc_id long").load(str(path / "a.jsonl")).collect()
    assert spark.read.format("json_ranges").schema("doc_id long").load(str(path / "empty.jsonl")).count() == 0
