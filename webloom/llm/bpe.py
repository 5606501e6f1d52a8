"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary.

The vocabulary's bytes are mapped to Latin-1, so that an Aho-Corasick automaton
over str finds, in one pass over a piece, the longest token from each position.
The encoder takes longest matches from the left; where a token may not follow
its left neighbour it takes the next shorter prefix, and where none is left it
steps back. Whether two tokens may stand side by side (that is, whether merging
by rank would leave the border between them alone) is found by undoing their
merges and is memoised. The result is that of merging by rank, in time linear
in the piece. A place that led nowhere is never tried again.

Pieces are the matches of the vocabulary's pattern; each is encoded by itself.
ASCII texts are cut by the pattern's ASCII form, which the standard library runs
in half the time. Encoded pieces are memoised per task, two generations of up to
``MEMO_PIECES`` short ones, so a piece is encoded about once; ids of a text are
one array, and bytes and decimal forms of its ids are gathered from tables.

Null and empty texts have no tokens. Special tokens are ordinary text. Repeated
rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import free, plus, tidy

MEMO_PIECES = 200_000
#: Rows go out when their ids take so many bytes.
OUT_BYTES = 4 << 20
MEMO_LENGTH = 40
MEMO_PAIRS = 500_000


def ascii_form(pattern: str) -> re.Pattern | None:
    """The pattern with character properties written out for ASCII texts; None if the standard library does not know the rest of it."""

    def members(m: regex.Match) -> str:
        found = "".join(re.escape(chr(c)) for c in range(128) if regex.fullmatch(m.group(2), chr(c)))
        return m.group(1) + (found if m.group(1) else f"[{found}]")

    # group 1: what a bracket has before the property
    inside = regex.compile(r"(\[[^\]]*?)(\\[pP]\{\w+\})")
    while inside.search(pattern):
        pattern = inside.sub(members, pattern, count=1)
    pattern = regex.sub(r"()(\\[pP]\{\w+\})", members, pattern)
    try:
        return re.compile(pattern)
    except re.error:
        return None


class Table:
    """The bytes of each token, or any others, one after another."""

    def __init__(self, values: dict[int, bytes]):
        self.length = np.zeros(max(values, default=-1) + 1, np.int64)
        self.length[list(values)] = [len(v) for v in values.values()]
        self.start = np.zeros(len(self.length), np.int64)
        self.start[list(values)] = np.cumsum([0, *map(len, values.values())])[:-1]
        self.raw = np.frombuffer(b"".join(values.values()), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        end = np.cumsum(n)
        return self.raw[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - end + n, n)].tobytes()


class Memo(dict):
    """Packed ids of pieces. Two generations: what was not asked for since the last change of generations is forgotten."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, p: str) -> bytes:
        known = self.older.get(p)
        if known is None:
            known = array("i", self.encode(p if p.isascii() else p.encode().decode("latin-1"))).tobytes()
        if len(p) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.older = dict(self)
                self.clear()
            self[p] = known
        return known


class Encoder:
    def __init__(self, lines: Iterable[bytes], pattern: str):
        whole = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.any_pieces = regex.compile(whole).findall
        plain = ascii_form(whole)
        self.ascii_pieces = plain.findall if plain else self.any_pieces
        pairs = [line.split() for line in lines if line.strip()]
        self.token = {int(rank): base64.b64decode(raw).decode("latin-1") for raw, rank in pairs}
        self.rank = {t: r for r, t in self.token.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, (r, len(t)))
        self.automaton.make_automaton()
        self.shorter = {r: next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1) for r, t in self.token.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo = Memo(self.piece)
        self.bytes_of = Table({r: t.encode("latin-1") for r, t in self.token.items()})
        self.digits_of = Table({r: b"%d " % r for r in self.token})

    def pieces(self, text: str) -> list[str]:
        return self.ascii_pieces(text) if text.isascii() else self.any_pieces(text)

    def undo(self, r: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token r; None for a single byte."""
        if r not in self.halves:
            t = self.token[r]
            parts = list(t)
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
                if self.rank.get(parts[best] + parts[best + 1], 1 << 60) >= r:
                    raise ValueError(f"no merges make token {r}")
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[r] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.halves[r]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the border between two tokens outlives all merges on both sides of it."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MEMO_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Back in time: the later of the two merges is undone, and a merge across
        # the border that was possible before that moment would have come first.
        now = 1 << 60
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < now:
                return False
            a, b = self.undo(left), self.undo(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                now, left = left, a[1]
            else:
                # Of equal ranks the left one merges first, so at that moment the border was still tried.
                now, right = right + 1, b[0]

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        for end, (r, length) in self.automaton.iter(s):
            longest[end - length + 1] = r  # later ends are longer
        ids: list[int] = []
        open_at = bytearray(b"\1") * (n + 1)
        at, take = 0, longest[0]
        while at < n:
            left = ids[-1] if ids else -1
            while take >= 0:
                end = at + len(self.token[take])
                if open_at[end] and (left < 0 or self.may_follow(left, take)):
                    break
                take = self.shorter[take]
            if take >= 0:
                ids.append(take)
                at = end
                take = longest[at] if at < n else -1
            else:
                if not ids:
                    raise ValueError("a byte is missing from the vocabulary")
                open_at[at] = 0
                take = ids.pop()
                at -= len(self.token[take])
        return ids

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pieces(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.bytes_of.joined(np.asarray(ids, np.int64).reshape(-1))


def _with_encoder(shared, work: Callable[[Encoder, Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` with this worker's encoder, whose memos go when the task ends."""

    def run(batches: Iterator) -> Iterator:
        e = _encoder(*shared.value)
        try:
            yield from work(e, batches)
        finally:
            e.memo = Memo(e.piece)
            e.compatible.clear()

    return run


@cache
def _encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder(raw.splitlines(), pattern)


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[str, str]:
    """The file of ranks and its pattern; a public vocabulary installed beside Python unless named."""
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    """The vocabulary (about 1 MB, whatever the data) as a broadcast, so that executors need no file."""
    path, pattern = vocabulary(path, pattern)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def encoded(docs: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the text's token ids, and the text replaced by what they decode to."""
    shared, name = _shared(docs.sparkSession, path, pattern), free(docs, ids)

    def work(e: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at, begin = whole.schema.get_field_index(text), 0
            while begin < whole.num_rows:
                ids_, back, size, rows = [], [], 0, 0
                while begin + rows < whole.num_rows and size < OUT_BYTES:
                    t = whole.column(at)[begin + rows]
                    got = e.ids(t.as_py() or "")
                    ids_.append(got)
                    back.append(e.decode(got).decode() if t.is_valid else None)
                    size += got.nbytes
                    rows += 1
                b = whole.slice(begin, rows)
                begin += rows
                ends = np.cumsum([0, *map(len, ids_)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids_)))
                cols = [pa.array(back, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays([*cols, tokens], names=[*b.schema.names, name])

    return docs.mapInArrow(tidy(_with_encoder(shared, work)), plus(docs.schema, **{name: T.ArrayType(T.IntegerType())}))


def decoded(df: DataFrame, ids: str = "token_ids", text: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the bytes that its token ids stand for, as a binary column."""
    shared, name = _shared(df.sparkSession, path, pattern), free(df, text)

    def work(e: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [e.decode(x or ()) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, name])

    return df.mapInArrow(tidy(_with_encoder(shared, work)), plus(df.schema, **{name: T.BinaryType()}))


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """For each document the number of its tokens and digests of their ids and of what they decode to."""
    shared = _shared(docs.sparkSession, path, pattern)

    def work(e: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(1):
                got = e.ids(t.as_py() or "")
                n.append(len(got))
                ids.append(sha(e.digits_of.joined(got)[:-1]).hexdigest())
                back.append(sha(e.decode(got)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(_with_encoder(shared, work)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
