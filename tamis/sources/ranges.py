"""Line files of any size as a Spark data source: plain files are read by byte ranges, packed ones frame by frame.

`spark.read.format("json_ranges").schema("doc_id long, text string").load(folder)` after `register(spark)`. A plain file is cut into ranges of
`rangeBytes`; a line belongs to the range in which it begins, so ranges need not be cut at line ends. Files that end in .gz or .zst are any number of
frames one after another, and one task each, as a frame doesn't say where the next one begins. Only the fields that the schema names are taken.
A last line without its end, or a frame that breaks off, is a torn tail: writers that append whole lines leave it when they die.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: Fields about a line rather than of it: its file, the byte at which it begins (of the unpacked file), and ok, bad (no JSON object) or torn.
FILE, AT, STATE = "_file", "_at", "_state"
RANGE_BYTES, CHUNK = 64 << 20, 1 << 20
ENDINGS = tuple(f".{kind}{packed}" for kind in ("jsonl", "json") for packed in ("", ".gz", ".zst"))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _unpacked(chunks: Iterator[bytes], packed: str) -> Iterator[bytes | None]:
    """Bytes of concatenated frames; None at the end if the last frame breaks off."""
    if packed == ".gz":
        fresh = lambda: zlib.decompressobj(31)
    else:
        import zstandard

        fresh = lambda: zstandard.ZstdDecompressor().decompressobj()
    frame, begun = fresh(), False
    for chunk in chunks:
        while chunk:
            begun = True
            try:
                yield frame.decompress(chunk)
            except Exception:  # what isn't a frame ends the file like one that breaks off
                yield None
                return
            if not frame.eof:
                break
            chunk, frame, begun = frame.unused_data, fresh(), False
    if begun:
        yield None


def lines(source: Iterator[bytes | None], at: int, end: int | None) -> Iterator[tuple[int, bytes, bool]]:
    """(place, line, torn) of the lines that begin before `end`; a torn one has lost its end."""
    rest, broken = b"", False
    for chunk in source:
        if chunk is None:
            broken = True
            break
        rest += chunk
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if end is not None and at >= end:
                return
            yield at, line, False
            at += len(line) + 1
    if (rest or broken) and (end is None or at < end):
        yield at, rest, True


def _fits(value: object, kind: object) -> object:
    """The value as Spark takes it for a field; null where it is of another type."""
    if isinstance(kind, StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (IntegerType, LongType)):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, (FloatType, DoubleType)):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    raise TypeError(f"json_ranges reads strings, numbers and truth values, not {kind}")


class JsonRangesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.path.endswith(ENDINGS):
                continue
            if f.path.endswith((".jsonl", ".json")):
                out += [Range(f.path, at, min(at + self.size, f.size)) for at in range(0, f.size, self.size)]
            else:
                out.append(Range(f.path, 0, -1))
        return out or [Range("", 0, 0)]

    def _lines(self, part: Range) -> Iterator[tuple[int, bytes, bool]]:
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as file:
            chunks = iter(lambda: file.read(CHUNK), b"")
            if part.end < 0:
                yield from lines(_unpacked(chunks, part.path[part.path.rindex(".") :]), 0, None)
                return
            at = part.start
            if at:  # a line that begins before belongs to the range before
                file.seek(at - 1)
                while chunk := file.read(CHUNK):
                    cut = chunk.find(b"\n")
                    if cut >= 0:
                        at = file.tell() - len(chunk) + cut + 1
                        break
                else:
                    return
                file.seek(at)
            yield from lines(chunks, at, part.end)

    def read(self, part: Range) -> Iterator[tuple]:
        names = {n for n, _ in self.fields}
        if not part.path:
            return
        for at, line, torn in self._lines(part):
            if not line and not torn:
                continue
            state, found = "torn" if torn else "ok", None
            if not torn:
                try:
                    found = json.loads(line)
                except ValueError:
                    pass
                if not isinstance(found, dict):
                    state, found = "bad", None
            if state != "ok" and STATE not in names:
                raise ValueError(f"{part.path} has a {state} line at byte {at}; ask for {STATE} to read on")
            own = {FILE: part.path, AT: at, STATE: state}
            yield tuple(own[n] if n in own else None if found is None else _fits(found.get(n), kind) for n, kind in self.fields)


class JsonRanges(DataSource):
    """Empty lines are skipped; missing fields, and values of another type, are null; nested values are strings of JSON. Torn and bad lines are rows
    of nulls where the schema has `_state`, and an error where it hasn't."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return f"{FILE} string, {AT} long, {STATE} string"

    def reader(self, schema: StructType) -> JsonRangesReader:
        return JsonRangesReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonRanges)
