"""Packed blocks of numbers, and a bounded filter on ids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCS_PER_BLOCK = 1000
#: Bits of a filter for each id, and the fewest and most bits of one (8 kB to 16 MB).
BITS_PER_ID = 16
FILTER_LEAST, FILTER_MOST = 1 << 16, 1 << 27


def block_bits(n_docs: int) -> int:
    """So many blocks (as a power of two) that one of them holds what about DOCS_PER_BLOCK documents give."""
    return min(20, max(4, int(np.ceil(np.log2(max(1, n_docs) / DOCS_PER_BLOCK)))))


def pack(block: np.ndarray, cols: dict[str, np.ndarray], **same: int) -> pa.RecordBatch:
    """A row for each block with each column's values as bytes; the order within a block stays."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    at = np.flatnonzero(np.diff(block, prepend=-1))
    cut = np.append(at, len(block))
    out = {"block": pa.array(block[at], pa.int32())}
    out |= {k: pa.array(np.full(len(at), v), pa.int32()) for k, v in same.items()}
    for k, v in cols.items():
        v = v[order]
        out[k] = pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def unpack(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in t.column(name).to_pylist() if x), kind)


@dataclass(frozen=True)
class IdFilter:
    """A broadcast bitmap of hashed ids: it passes all of them and, by chance, some others.

    Its size goes with the number of ids, up to FILTER_MOST bits; some 6 % of the
    other ids pass up to 8 million ids, more beyond. It only saves work: what passes
    is joined on the ids themselves, so a filter that passes all costs a shuffle of
    what it was to keep back, and no row.
    """

    bits: int
    bitmap: Broadcast

    @classmethod
    def of(cls, ids: DataFrame) -> IdFilter:
        """The filter of the only column of a stored table."""
        n = max(1, ids.count())
        bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (BITS_PER_ID * n - 1).bit_length()))
        at = cls._place(F.col(ids.columns[0]), bits)
        words = ids.groupBy(F.floor(at / 32768).alias("k")).agg(F.bitmap_construct_agg(at % 32768).alias("m")).collect()
        bitmap = np.zeros(bits // 8, np.uint8)
        for r in words:
            bitmap[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)[: bits // 8]
        return cls(bits, ids.sparkSession.sparkContext.broadcast(bitmap))

    @staticmethod
    def _place(id_: Column, bits: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(id_.cast("bigint"), F.lit(0))), F.lit(bits)).cast("bigint")

    def may_have(self, id_: Column) -> Column:
        """Whether an id may be one of them. Only its place in the bitmap goes to Python, no other column of the row."""
        shared = self.bitmap

        def test(at: pa.Array) -> pa.Array:
            x = at.to_numpy(zero_copy_only=False)
            return pa.array((shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1).cast(pa.bool_())

        return F.arrow_udf(test, "boolean")(self._place(id_, self.bits))

    def passing(self, df: DataFrame, id_: Column) -> DataFrame:
        return df.where(self.may_have(id_))
