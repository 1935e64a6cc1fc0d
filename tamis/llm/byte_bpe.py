"""Byte-level BPE by a lazily determinised finite-state transducer.

A tokenization is the encoder's own if and only if every two neighbouring tokens stay as they are when their bytes are
encoded alone, so the encoding of a prefix extends by exactly one token that ends at the new byte and suits the token
before it. A state is the set of trie nodes that are open: one for each place from which some token may still reach past the present
byte. A move gives the next state and the tokens that end with its byte, the longest first; the first of them that suits the
last token at the place where it begins is the prefix's last token. Going back from the end along those tokens gives the encoding. Tokens
have a longest length, so what the prefixes that may still be extended share is certain, and is emitted after a bounded lookahead. States,
moves and pairs that suit are made when first met, in bounded tables.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States and token pairs beyond which a worker starts those tables anew, and cached strings (240 bytes each with their ids) beyond which it lets the older half go.
MOST_STATES, MOST_PAIRS, MOST_CACHED = 100_000, 500_000, 300_000
#: Rows whose texts are Python strings at a time.
ROWS = 256
#: Pieces that are encoded at a time, so that a very long text is never held as one list of ids.
BLOCK = 1 << 16
NONE, NEVER = -1, 1 << 62
#: Bytes of a piece after which what is certain is emitted.
LOOK = 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        nodes = 1
        for token, rank in ranks.items():
            node = 0
            for b in token:
                below = self.child.get((node, b))
                if below is None:
                    self.child[node, b] = below = nodes
                    self.inner.add(node)
                    nodes += 1
                node = below
            self.token_at[node] = rank
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.size.values(), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.suits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.moves = _Made(self._determinise)
        self._state((0,))

    def _state(self, places: tuple[int, ...]) -> int:
        at = self.number.get(places)
        if at is None:
            at = self.number[places] = len(self.states)
            self.states.append(places)
        return at

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens of which the encoder makes this one last; (NONE, NONE) for a byte, or for one it never makes."""
        found = self.parts.get(token)
        if found is None:
            found = (NONE, NONE)
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                if len(parts) == 2:
                    found = (self.ranks[parts[0]], self.ranks[parts[1]])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.parts[token] = found
        return found

    def _made(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._halves(token) != (NONE, NONE)

    def _suits(self, left: int, right: int) -> bool:
        """Whether the boundary of two tokens outlives the encoding of their joined bytes; before the first token only whether that is ever made."""
        if len(self.suits) >= MOST_PAIRS:
            self.suits.clear()
        found = self.suits[(left << 32) + right] = self._made(right) and (left == NONE or self._outlives(left, right))
        return found

    def _outlives(self, left: int, right: int) -> bool:
        """Runs the encoder's merges backwards: the merge of the higher rank is undone first (of equals the right one, which
        was done last), and at each step no pair over the boundary may be due before the merge undone last."""
        of = self.bytes_of
        undone, by_right = NEVER, False
        while True:
            pair = self.ranks.get(of[left] + of[right], NEVER)
            # an equal rank is due first if it stands to the left of what was undone
            if pair < undone or pair == undone != NEVER and by_right:
                return False
            left_rank = left if len(of[left]) > 1 else NONE
            right_rank = right if len(of[right]) > 1 else NONE
            if left_rank == right_rank == NONE:
                return True
            by_right = right_rank >= left_rank
            undone = max(left_rank, right_rank)
            if by_right:
                right = self._halves(right)[0]
            else:
                left = self._halves(left)[1]

    def _determinise(self, at: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Next state of a move, and the (token, size) that end with it, those that begin first before the others."""
        state, b = at >> 8, at & 255
        kept, ends = [], []
        for node in self.states[state]:
            below = self.child.get((node, b))
            if below is None:
                continue
            token = self.token_at.get(below, NONE)
            if token != NONE:
                ends.append((token, self.size[token]))
            if below in self.inner:
                kept.append(below)
        return self._state((*kept, 0)), tuple(ends)

    def _back(self, last: list[int], at: int) -> list[int]:
        """Tokens of the prefix that ends at a place, from where the list begins."""
        out = []
        while at > 0:
            out.append(last[at])
            at -= self.size[last[at]]
        out.reverse()
        return out

    def _certain(self, last: list[int]) -> int:
        """The place that the encodings of all prefixes that may still be extended have in common: the one where their ways back meet."""
        ways = set(range(max(0, len(last) - self.longest), len(last)))
        while len(ways) > 1:
            at = max(ways)
            ways.discard(at)
            ways.add(at - self.size[last[at]])
        return ways.pop()

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > MOST_STATES:
            self.forget()
        moves, known, state, last, out = self.moves, self.suits.get, 0, [NONE], []
        for begin in range(0, len(piece), LOOK):
            at = len(last)
            for b in piece[begin : begin + LOOK]:
                state, ends = moves[state << 8 | b]
                for token, size in ends:
                    left = last[at - size]
                    fits = known((left << 32) + token)
                    if fits is None:
                        fits = self._suits(left, token)
                    if fits:
                        last.append(token)
                        break
                at += 1
            if begin + LOOK < len(piece):
                cut = self._certain(last)
                out += self._back(last, cut)
                del last[:cut]
        return (*out, *self._back(last, len(last) - 1))


class _Made(dict):
    """Values made when first asked for."""

    def __init__(self, make: Callable[[int], tuple]):
        super().__init__()
        self.make = make

    def __missing__(self, key: int) -> tuple:
        value = self[key] = self.make(key)
        return value


class _Ids(dict):
    """Ids of short strings as bytes, made when first met. Of a bounded number, half are new and half are those of before; what is met again is new."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.pop(part, None)
        if ids is None:
            ids = self.make(part)
        if len(part) <= 32:
            if len(self) > MOST_CACHED // 2:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids


#: Characters below this one have the letters, numbers and white space of every Unicode version since 5.0.
STABLE = 0x250
SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def narrow_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of stable characters alone, with its properties spelt out; None if it uses others."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(STABLE) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, spaces = of("L"), of("N"), "".join(map(re.escape, SPACES))
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, chars in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
        spelt = spelt.replace(name, chars)
    return None if r"\p" in spelt else re.compile(spelt)


def _array(parts: Iterable[bytes]) -> array:
    out = array("I")
    out.frombytes(b"".join(parts))
    return out


class Codec:
    """Encoder and decoder of one vocabulary.

    Texts of stable characters are cut by the standard library, others by the pattern as it is; ids of pieces are looked up.
    """

    OTHER = re.compile(f"[^\\x00-{chr(STABLE - 1)}]")

    def __init__(self, path: str, pattern: str):
        self.fst = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.narrow = narrow_pattern(pattern) or self.pattern
        self.pieces = _Ids(lambda piece: array("I", self.fst.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes())

    def blocks(self, text: str) -> Iterator[array]:
        """Ids of a text, a bounded number of parts at a time."""
        cut, ids = (self.pattern if self.OTHER.search(text) else self.narrow), self.pieces
        if len(text) <= BLOCK:
            yield _array(map(ids.__getitem__, cut.findall(text)))
            return
        found = (m[0] for m in cut.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield _array(map(ids.__getitem__, block))

    def encode(self, text: str) -> array:
        out = array("I")
        for block in self.blocks(text):
            out.extend(block)
        return out

    def raw(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.fst.bytes_of.__getitem__, ids))

    def stream(self, blocks: Iterable[Iterable[int]], errors: str = "replace") -> Iterator[str]:
        """Text of id blocks as it becomes certain, by an incremental UTF-8 state machine: a character split over blocks waits for
        its last byte. `errors` as in bytes.decode; with "surrogateescape" bytes that aren't UTF-8 survive encoding the text again."""
        machine = codecs.getincrementaldecoder("utf-8")(errors)
        for ids in blocks:
            if known := machine.decode(self.raw(ids)):
                yield known
        if rest := machine.decode(b"", True):
            yield rest


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids; null counts as the empty text, which has none."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        coder = codec(path, pattern)
        return pd.Series([coder.encode(t or "") for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Text of an array of token ids; null ids give null, bytes that aren't UTF-8 give the replacement character."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        coder = codec(path, pattern)
        return pd.Series([None if row is None else "".join(coder.stream([row])) for row in rows], dtype=object)

    return text(ids)


class _Seen:
    """Count and hash of the ids that pass."""

    def __init__(self):
        self.n, self.hash = 0, hashlib.sha256()

    def note(self, block: array) -> array:
        self.n += len(block)
        little = block
        if sys.byteorder == "big":
            little = array("I", block)
            little.byteswap()
        self.hash.update(little)
        return block


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256 and decoded_sha256 of every row, without holding a text's ids whole; blocks are decoded as they come.

    Null and empty texts: no tokens, hashes of nothing. Repeated rows are kept; other columns are ignored.
    """

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: pa.Array) -> pa.Array:
        coder = codec(path, pattern)
        rows = []
        for at in range(0, len(texts), ROWS):
            for t in texts.slice(at, ROWS).to_pylist():
                seen, back = _Seen(), hashlib.sha256()
                for known in coder.stream(map(seen.note, coder.blocks(t or "")), "surrogateescape"):
                    back.update(known.encode("utf-8", "surrogateescape"))
                rows.append({"n_tokens": seen.n, "ids_sha256": seen.hash.hexdigest(), "decoded_sha256": back.hexdigest()})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return docs.select(key, digest(F.col(text)).alias("d")).select(key, "d.*")


def tokenise(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids, and whether the ids decode to the text, of every row; null and empty texts have no ids.

    By rows, not Arrow batches: those hold up to 10,000 texts and all their ids at a time, in the executor and in Python.
    """

    def coded(t: str | None) -> tuple[array, bool]:
        coder, ids = codec(path, pattern), array("i")
        for block in coder.blocks(t or ""):
            ids.frombytes(block.tobytes())
        back = coder.stream((memoryview(ids)[at : at + BLOCK] for at in range(0, len(ids), BLOCK)), "surrogateescape")
        return ids, "".join(back) == (t or "")

    codes = F.udf(coded, "struct<ids:array<int>,exact:boolean>", useArrow=False)
    return docs.select(key, codes(F.col(text)).alias("c")).select(key, F.size("c.ids").cast("long").alias("n_tokens"), "c.ids", "c.exact")
