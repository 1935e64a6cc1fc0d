"""Fill-in-middle documents: every text is cut at two token boundaries and its parts are put into another order.

Tokens are runs of ASCII letters and single other characters. All rows of an Arrow batch are cut together on the batch's
UTF-8 buffer: a table gives each byte's class, neighbouring classes mark where tokens start, running sums of those marks, less
their value at a document's start, number the tokens, and one binary search finds the byte of every cut. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle, and the percentages of texts that change and that put the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes of text that are cut at a time, one row at least.
BLOCK = 1 << 22

#: Classes of bytes: inside a character, ASCII letter, start of another character.
INSIDE, LETTER, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x80:0xC0] = INSIDE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER

CUT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
FIELDS = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def draws(key: Column, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key; a null key counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _running(marks: np.ndarray) -> np.ndarray:
    """Sums of the marks before each place, and of all of them at the end."""
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def _marked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running count of marks (<P>, <S> or <M>) by the place at which they end; none reaches over a document's end."""
    found = np.zeros(len(data), bool)
    if len(data) > 2:
        name = data[1:-1]
        found[2:] = (data[:-2] == 60) & (data[2:] == 62) & ((name == 80) | (name == 83) | (name == 77))
        for over in (0, 1):  # a match that would end at a document's first or second byte lies over its start
            at = ends + over
            found[at[at < len(data)]] = False
    return _running(found)


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, form (0 plain, 1 psm, 2 spm), places of both cuts in bytes, and characters of prefix and middle, of all rows of a buffer.

    data: the bytes of all texts; offsets: where each begins, and the end; h: four numbers for each row.
    """
    begin, end = offsets[:-1], offsets[1:]
    kind = _CLASS[data]
    starts = kind != INSIDE
    characters = _running(starts)
    if len(data) > 1:
        starts[1:] &= (kind[1:] != LETTER) | (kind[:-1] != LETTER)
    first = begin[begin < end]
    starts[first] = True  # of two texts side by side the second starts a token
    tokens = _running(starts)
    n = tokens[end] - tokens[begin]
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    units = np.stack([np.minimum(one, two), np.maximum(one, two)])
    # the place before which a text has so many tokens: the first one whose running sum is larger is one byte on
    places = np.searchsorted(tokens, (tokens[begin] + units + 1).ravel(), "left").reshape(units.shape) - 1
    places = np.where(units == n, end, places)
    marks = _marked(data, begin)
    plain = (begin == end) | (marks[end] > marks[begin]) | (h[:, 2] % 100 >= CHANGED)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < SUFFIX_FIRST, 2, 1))
    prefix = characters[places[0]] - characters[begin]
    return n, form, places[0], places[1], prefix, characters[places[1]] - characters[places[0]]


def _assembled(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    view, parts = memoryview(data), []
    sizes = (offsets[1:] - offsets[:-1]) + np.where(form == 0, 0, len(PREFIX + SUFFIX + MIDDLE))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for kind, i, x, y, j in zip(form.tolist(), offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist()):
        if kind == 0:
            parts.append(view[i:j])
        elif kind == 1:
            parts += (p, view[i:x], s, view[y:j], m, view[x:y])
        else:
            parts += (s, view[y:j], p, view[i:x], m, view[x:y])
    return pa.Array.from_buffers(pa.large_string(), len(form), [None, pa.py_buffer(_running(sizes)), pa.py_buffer(b"".join(parts))])


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of at most BLOCK bytes, one row at least: first and last, bytes and offsets from 0."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def transformed(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
    """The kernel: a struct for each text of an Arrow batch."""
    h = np.stack([x.to_numpy(zero_copy_only=False) for x in (h1, h2, h3, h4)], 1) if len(texts) else np.zeros((0, 4), np.int64)
    names, found = np.array(["plain", "psm", "spm"]), []
    for at, upto, data, offsets in _blocks(texts):
        n, form, a, b, prefix, middle = cut(data, offsets, h[at:upto])
        plain = form == 0
        columns = [pa.array(n), pa.array(names[form]), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), _assembled(data, offsets, form, a, b)]
        found.append(pa.StructArray.from_arrays(columns, fields=list(CUT)))
    out = pa.concat_arrays(found) if found else pa.array([], CUT)
    return out.cast(pa.struct([*list(CUT)[:-1], ("output", pa.string())]))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n (tokens), form, prefix_chars, middle_chars and output of every row.

    Null and empty texts: no tokens, form plain, empty output. Texts that hold a mark stay plain, as they couldn't be restored.
    Null keys draw as the empty string does; repeated rows come out alike, each; other columns are ignored, whatever their names;
    an empty table gives no rows. A text goes through in one row, however long.
    """
    kernel = F.arrow_udf(transformed, FIELDS)
    return docs.select(key, kernel(F.col(text), *draws(F.col(key))).alias("cut")).select(key, "cut.*")


def restored(output: Column, form: Column) -> Column:
    """The text of which `output` was made. Texts that are cut hold no marks, so the marks part it into three."""
    parts = F.split(output, "<[PSM]>")
    prefix, suffix, middle = F.when(form == "psm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))), F.when(form == "psm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))), F.get(parts, F.lit(3))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    done = transform(docs, key, text)
    return done.select(key, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
