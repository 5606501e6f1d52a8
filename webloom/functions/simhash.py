"""FNV-1a and SimHash, natively and as an Arrow UDF."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from .udf import arrow_function

# Fixed values of 64-bit FNV-1a.
_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
_HI, _LO = _OFFSET >> 32, _OFFSET & 0xFFFFFFFF
_LOW32 = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as a signed bigint. Two limbs of 32 bits keep every product in range."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    codes = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.lit(_HI).cast("bigint").alias("hi"), F.lit(_LO).cast("bigint").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b)
        m = x * 435
        carry = F.shiftright(m, 32) + F.shiftleft(x, 8)
        return F.struct((h["hi"] * 435 + carry).bitwiseAND(F.lit(_LOW32)).alias("hi"), m.bitwiseAND(F.lit(_LOW32)).alias("lo"))

    return F.aggregate(codes, start, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"]))


def hex16(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fnv1a_py(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _PRIME) & _MASK
    return h


def _hash_words(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            if len(memo) > 200_000:
                memo.clear()
            h = memo[w] = fnv1a_py(w)
        out[i] = h
    return out


_BITS = np.arange(64, dtype=np.uint64)


def simhash_py(words: list[bytes], memo: dict[bytes, int] | None = None) -> int:
    """Signed 64-bit SimHash: a bit is set if more words have it than not; 0 for none."""
    h = _hash_words(words, {} if memo is None else memo)
    if not len(h):
        return 0
    votes = ((h[:, None] >> _BITS) & np.uint64(1)).sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int((votes.astype(np.uint64) << _BITS).sum(dtype=np.uint64).view(np.int64))


_memo: dict[bytes, int] = {}
# Python also splits at the four separators U+001C to U+001F, which are no white space in Unicode.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    """What stands between Unicode white space."""
    return _WORD.findall(text) if _SEPARATORS.search(text) else text.split()



@arrow_function("bigint")
def simhash(text: pa.Array) -> pa.Array:
    """SimHash of the words between white space."""
    return pa.array([None if t is None else simhash_py([w.encode() for w in split_words(t)], _memo) for t in text.to_pylist()], pa.int64())
