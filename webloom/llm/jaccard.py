"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are sets of distinct shingles of five words; two link when 100 x
intersection >= 75 x union. Steps:

1. Columns of the incidence matrix are counted over all documents, in blocks by
   hash. Columns with more than ``HOT_LEAST`` documents are hot. The ``HOT_MOST`` or
   fewer most frequent of them are broadcast; if there are others, rows get the
   counts of theirs by a join in blocks instead, with the same result.
2. Documents with equal sets form a class; its smallest id stands for it.
3. A row keeps only the columns that a partner must share one of: of its n
   columns, ordered by (count if hot, hash), the first n - ceil(0.75 n) + 1.
4. Cold columns are multiplied block by block: each block adds up, for every
   pair of rows that meet in it, the overlap; sums over blocks are the overlap
   counts of the kept part. A pair stays if its sizes allow the similarity and
   its count plus all that the parts not kept could add reaches
   ceil(3/7 (n + m)).
5. Hot columns would give a pair for every two of thousands of near copies.
   Their rows are first compared with a pivot per column, the row with the
   fewest cold columns, which is the least changed copy. After the components of
   the links found so far are known, rows of a hot column that lie in different
   components are compared with one another; rows in the same component need not
   be. So no link between components is lost. Pairs that share a cold column are
   in the product of step 4 already; for the others, the first column they share
   is hot, and at its ranks in both rows enough columns must be left for the
   overlap that their sizes ask for. From its rank a row knows which sizes can be
   enough, and it meets only rows in the buckets of those sizes.
6. Pairs that are left are verified on the whole sets.

Null and empty texts and texts without words have an empty set and link with
nothing; fewer than five words are one shingle. Documents of equal text are one
class. Rows that share an id are taken as one document; a null id gets a null
component. Other columns are not looked at, whatever their names. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import IdFilter, block_bits, pack, unpack
from .common import free, quoted, stored, tidy
from .components import components
from .tokens import U64, mix, shingle_sets, words

SIZE = 5
HOT_LEAST = 20
HOT_MOST = 1 << 20
#: Parts that the rows of a hot column are dealt to when they meet its pivot.
SALTS = 16
#: Sizes in a bucket differ by at most this factor.
STEP = 1.05
#: Columns that are handled at once, per task.
BUFFER = 1 << 19


def least_shared(n: np.ndarray) -> np.ndarray:
    """ceil(0.75 n) without rounding errors: the fewest columns a row of n shares with a partner."""
    return (3 * n + 3) // 4


def _sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    for w in words(column, lower=True):
        yield shingle_sets(w, SIZE)


def _column_counts(docs: DataFrame, bits: int) -> DataFrame:
    """fp (block and 32 further bits) and n of each column that more than HOT_LEAST rows have."""
    shift = U64(64 - bits - 32)

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp, n = np.unique(np.concatenate(parts) >> shift, return_counts=True)
        block = (fp >> U64(32)).astype(np.int64)
        low = (fp & U64(0xFFFFFFFF)).astype(np.uint32)
        at = np.flatnonzero(np.diff(block, prepend=-1))
        cut = np.append(at, len(block))
        ones, many, counts = [], [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            one = n[a:b] == 1
            ones.append(low[a:b][one].tobytes())
            many.append(low[a:b][~one].tobytes())
            counts.append(n[a:b][~one].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(block[at], pa.int32()), *(pa.array(x, pa.binary()) for x in (ones, many, counts))], names=["block", "ones", "many", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for sets in _sets(b.column(0)):
                parts += [s for s in sets if len(s)]
                held += sum(map(len, sets))
                if held >= BUFFER:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ones, many, counts = (unpack(t, c, np.uint32) for c in ("ones", "many", "counts"))
        low, n = np.concatenate([ones, many]), np.concatenate([np.ones(len(ones), np.int64), counts.astype(np.int64)])
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        at = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        total = np.add.reduceat(n, at) if len(at) else n
        hot = total > HOT_LEAST
        return pa.table({"fp": pa.array((low[at][hot].astype(np.int64)) | (key[0].as_py() << 32), pa.int64()), "n": pa.array(total[hot], pa.int64())})

    rows = docs.select("text").mapInArrow(tidy(count), "block int, ones binary, many binary, counts binary")
    return rows.groupBy("block").applyInArrow(add, "fp bigint, n bigint")


class Hot(NamedTuple):
    """The most frequent hot columns, sorted, at most HOT_MOST; their counts; a table (fp, n) of the other hot ones, if any."""

    fp: np.ndarray
    n: np.ndarray
    others: DataFrame | None


def _hot_columns(docs: DataFrame, bits: int) -> Hot:
    counts, least, others = stored(_column_counts(docs, bits)), HOT_LEAST, None
    if counts.count() > HOT_MOST:
        level = F.floor(F.log2("n") * 8)
        steps = sorted(((r["l"], r["c"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
        held, lowest = 0, steps[0][0] + 1
        for l, c in steps:  # noqa: E741
            if held + c > HOT_MOST:
                break
            held, lowest = held + c, l
        counts, others = counts.where(level >= lowest), counts.where(level < lowest)
    t = counts.where(F.col("n") > least).toArrow()
    fp, n = t.column("fp").to_numpy().astype(np.uint64), t.column("n").to_numpy()
    order = np.argsort(fp)
    return Hot(fp[order], n[order], others)


def _counts_of(fp: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The count of each column in a sorted list, 0 for others."""
    if not len(known):
        return np.zeros(len(fp), np.int64)
    at = np.minimum(np.searchsorted(known, fp), len(known) - 1)
    return np.where(known[at] == fp, n[at], 0)


def _looked_up(docs: DataFrame, bits: int, hot: Hot, shared: Broadcast) -> DataFrame:
    """(i, fps, ns): the columns of each document that ``hot.others`` has, with their counts.

    Each block of columns meets the same block of hot ones; none of these is among the most frequent, so no block is held up by one column.
    """
    shift = U64(64 - bits - 32)

    def flush(ids: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp = np.concatenate(parts)
        yield pack((fp >> U64(32)).astype(np.int64), {"low": (fp & U64(0xFFFFFFFF)).astype(np.uint32), "ids": np.repeat(np.array(ids, np.int64), [len(p) for p in parts])})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for b in batches:
            column, at = b.column(0).to_pylist(), 0
            for sets in _sets(b.column(1)):
                for x in sets:
                    x = x >> shift
                    x = x[_counts_of(x, *shared.value) == 0]
                    if len(x):
                        ids.append(column[at])
                        parts.append(x)
                        held += len(x)
                    at += 1
                if held >= BUFFER:
                    yield from flush(ids, parts)
                    ids, parts, held = [], [], 0
        if parts:
            yield from flush(ids, parts)

    def meet(key: tuple[pa.Scalar, ...], entries: pa.Table, listed: pa.Table) -> pa.Table:
        low, ids = unpack(entries, "low", np.uint32), unpack(entries, "ids", np.int64)
        fp = low.astype(np.int64) | (key[0].as_py() << 32)
        order = np.argsort(listed.column("fp").to_numpy())
        n = _counts_of(fp, listed.column("fp").to_numpy()[order], listed.column("n").to_numpy()[order])
        some = n > 0
        place = (mix(ids[some].view(U64)) >> U64(64 - bits)).astype(np.int64)
        return pa.Table.from_batches([pack(place, {"ids": ids[some], "fps": fp[some], "ns": n[some]})])

    def gather(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, fps, ns = (unpack(t, c, np.int64) for c in ("ids", "fps", "ns"))
        order = np.lexsort((fps, ids))
        ids, fps, ns = ids[order], fps[order], ns[order]
        cut = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else [], len(ids)).astype(np.int64)
        rows = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table({"i": pa.array(ids[cut[:-1]], pa.int64()), "fps": rows(fps), "ns": rows(ns)})

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    dealt = known.mapInArrow(tidy(deal), "block int, low binary, ids binary")
    listed = hot.others.select(F.shiftright("fp", 32).cast("int").alias("block"), "fp", "n")
    met = dealt.groupBy("block").cogroup(listed.groupBy("block")).applyInArrow(meet, "block int, ids binary, fps binary, ns binary")
    return met.groupBy("block").applyInArrow(gather, "i bigint, fps binary, ns binary")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest (k1, k2) of each document's set; null digests for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys = [], []
            for sets in _sets(b.column(1)):
                n += map(len, sets)
                keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            k = [np.frombuffer(x, np.int64).tolist() if x else (None, None) for x in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64())], names=["doc_id", "n_shingles", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(work), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint")


def _kept_columns(docs: DataFrame, bits: int, hot: Hot) -> DataFrame:
    """For each class its id, size, kept cold columns and kept hot columns."""
    shift, shared = U64(64 - bits - 32), docs.sparkSession.sparkContext.broadcast((hot.fp, hot.n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            own = [[np.frombuffer(x or b"", np.int64) for x in c.to_pylist()] for c in b.columns[2:]]
            at = 0
            for sets in _sets(b.column(1)):
                every = np.concatenate(sets) >> shift
                n_of = _counts_of(every, *shared.value)
                end = 0
                for s in sets:
                    begin, end = end, end + len(s)
                    if len(s) and ids[at] is not None:
                        keep = len(s) - int(least_shared(np.int64(len(s)))) + 1
                        n, fp = n_of[begin:end], every[begin:end]
                        if own:
                            n = n + _counts_of(fp, own[0][at].view(U64), own[1][at])
                        order = np.argsort(n, kind="stable")[:keep] if n.any() else slice(0, keep)
                        n, fp = n[order], fp[order]
                        k = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                        rows.append((int(k[0]), int(k[1]), ids[at], len(s), fp[n == 0].tobytes(), fp[n > 0].tobytes()))
                    at += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["k1", "k2", "id", "n", "cold", "hot"])

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    if hot.others is not None:
        known = known.join(stored(_looked_up(docs, bits, hot, shared)), F.col("doc") == F.col("i"), "left").drop("i")
    rows = known.mapInArrow(tidy(work), "k1 bigint, k2 bigint, id bigint, n bigint, cold binary, hot binary")
    return rows.groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "cold", "hot")).alias("c")).select("c.*")


def _cold_pairs(kept: DataFrame) -> DataFrame:
    """The sparse product over cold columns: a, b, their sizes and hot columns, and the overlap count c."""

    def flush(ids, ns, hs, parts) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        fp = np.concatenate(parts)
        cols = {"low": (fp & U64(0xFFFFFFFF)).astype(np.uint32), "ids": np.array(ids, np.int64)[row], "ns": np.array(ns, np.int32)[row], "hs": np.array(hs, np.int32)[row]}
        yield pack((fp >> U64(32)).astype(np.int64), cols)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, hs, parts, held = [], [], [], [], 0
        for b in batches:
            for i, n, cold, hot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cold:
                    ids.append(i)
                    ns.append(n)
                    hs.append(len(hot) // 8)
                    parts.append(np.frombuffer(cold, np.uint64))
                    held += len(parts[-1])
                if held >= BUFFER:
                    yield from flush(ids, ns, hs, parts)
                    ids, ns, hs, parts, held = [], [], [], [], 0
        if parts:
            yield from flush(ids, ns, hs, parts)

    def multiply(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        low, ids, ns, hs = (unpack(t, c, k) for c, k in (("low", np.uint32), ("ids", np.int64), ("ns", np.int32), ("hs", np.int32)))
        order = np.argsort(low, kind="stable")
        low = low[order]
        # Only columns that two rows share make a product.
        same = low[1:] == low[:-1]
        both = np.zeros(len(low), bool)
        both[1:] |= same
        both[:-1] |= same
        order, low = order[both], low[both]
        left, right = [], []
        for d in range(1, len(low)):
            i = np.flatnonzero(low[d:] == low[:-d])
            if not len(i):
                break
            x, y = order[i], order[i + d]
            fits = (100 * np.minimum(ns[x], ns[y]) >= 75 * np.maximum(ns[x], ns[y])) & (ids[x] != ids[y])
            x, y = x[fits], y[fits]
            swap = ids[x] > ids[y]
            left.append(np.where(swap, y, x))
            right.append(np.where(swap, x, y))
        if not left or not sum(map(len, left)):
            return empty
        x, y = np.concatenate(left), np.concatenate(right)
        _, at, count = np.unique(np.stack([ids[x], ids[y]]), axis=1, return_index=True, return_counts=True)
        x, y = x[at], y[at]
        return pa.table({"a": ids[x], "b": ids[y], "na": ns[x], "nb": ns[y], "ha": hs[x], "hb": hs[y], "c": count.astype(np.int64)})

    kinds = {"a": pa.int64(), "b": pa.int64(), "na": pa.int32(), "nb": pa.int32(), "ha": pa.int32(), "hb": pa.int32(), "c": pa.int64()}
    empty = pa.table({k: pa.array([], v) for k, v in kinds.items()})
    dealt = kept.select("id", "n", "cold", "hot").mapInArrow(tidy(deal), "block int, low binary, ids binary, ns binary, hs binary")
    parts = dealt.groupBy("block").applyInArrow(multiply, "a bigint, b bigint, na int, nb int, ha int, hb int, c bigint")
    sums = parts.groupBy("a", "b", "na", "nb", "ha", "hb").agg(F.sum("c").alias("c"))
    rest = F.greatest(*(F.floor((3 * F.col(n) + 3) / 4) - 1 for n in ("na", "nb")))
    return sums.where(F.col("c") + F.least("ha", "hb") + rest >= _needed(F.col("na"), F.col("nb"))).select("a", "b")


def _hot_rows(kept: DataFrame) -> DataFrame:
    """(fp, id, n, cold, left): kept hot columns, with the row's size, its cold columns and how many columns follow in its order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            ids, n, cold = (b.column(i).to_numpy() for i in range(3))
            size = np.array([len(p) for p in parts], np.int64)
            rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            cols = {"fp": np.concatenate(parts), "id": np.repeat(ids, size), "n": np.repeat(n, size), "cold": np.repeat(cold, size)}
            cols["left"] = cols["n"] - cols["cold"] - rank - 1
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})

    rows = kept.where(F.octet_length("hot") > 0).select("id", "n", (F.octet_length("cold") / 8).cast("bigint").alias("cold"), "hot")
    return rows.mapInArrow(tidy(work), "fp bigint, id bigint, n bigint, cold bigint, left bigint")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _needed(n: Column, m: Column) -> Column:
    """The overlap at which two sizes are similar enough."""
    return F.ceil(3 * (n + m) / 7)


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """Each row of a hot column with that of its rows that has the smallest share of cold columns."""
    rank = F.floor(F.col("cold") * 1000 / F.col("n"))
    pivots = rows.groupBy("fp").agg(F.min(F.struct(rank.alias("r"), F.xxhash64("id").alias("h"), F.col("id").alias("p"), F.col("n").alias("m"))).alias("p"))
    # a pivot goes to each part of its column's rows, so rows of a column that a third of all rows have are not one task
    pivots = pivots.select(F.col("fp").alias("f"), "p.p", "p.m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    fits = 100 * F.least("n", "m") >= 75 * F.greatest("n", "m")
    met = rows.withColumn("own", part).join(pivots, (F.col("fp") == F.col("f")) & (F.col("own") == F.col("part")))
    met = met.where((F.col("id") != F.col("p")) & fits & (F.col("n") - F.col("cold") >= _needed(F.col("n"), F.col("m"))))
    return met.select(*_ordered(F.col("id"), F.col("p"))).distinct()


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(STEP)))


def _crossing_pairs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of rows of a hot column in different components that may be similar; found: (id, component_id).

    The larger of two rows looks for the smaller one, in the buckets of the sizes that
    its rank leaves: from 3/4 of its own to where the columns left would no longer be
    enough. Rows of a column's largest component meet only rows outside it.
    """
    found = found.select(F.col("id").alias("i"), "component_id")
    known = rows.join(found, F.col("id") == F.col("i"), "left").select("fp", "id", "n", "left", F.coalesce("component_id", "id").alias("comp"))
    sizes = known.groupBy("fp", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("fp").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("fp").alias("f"), F.col("m.comp").alias("main"))
    split = stored(known.join(main, F.col("fp") == F.col("f")).select("fp", "id", "n", "left", "comp", (F.col("comp") != F.col("main")).alias("away")))
    least, most = F.ceil(3 * F.col("n") / 4), F.least(F.col("n"), F.floor(7 * (F.col("left") + 1) / 3) - F.col("n"))
    asking = split.withColumn("least", least).withColumn("most", most).where("most >= least")
    asking = asking.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("least")), _bucket(F.col("most")))))
    asked = split.select(F.col("fp").alias("f"), F.col("id").alias("p"), F.col("n").alias("m"), F.col("left").alias("l"), F.col("comp").alias("q"), F.col("away").alias("out"), _bucket(F.col("n")).alias("at"))
    enough = F.least("left", "l") + 1 >= _needed(F.col("n"), F.col("m"))
    meets = (F.col("fp") == F.col("f")) & (F.col("bucket") == F.col("at")) & (F.col("comp") != F.col("q")) & F.col("m").between(F.col("least"), F.col("most")) & enough
    met = asking.where("away").join(asked, meets).select(*_ordered(F.col("id"), F.col("p")))
    return met.union(asking.where("NOT away").join(asked.where("out"), meets).select(*_ordered(F.col("id"), F.col("p")))).distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough. pairs: stored."""
    ids = stored(pairs.select(F.col("a").alias("i")).union(pairs.select(F.col("b").alias("i"))).distinct())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for part in _sets(b.column(1)) for s in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared_ = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared_ >= 75 * (len(x) + len(y) - shared_))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("i"), "text")
    sets = IdFilter.of(ids).passing(rows, F.col("i")).mapInArrow(tidy(gather), "id bigint, s binary")
    x, y = sets.toDF("ia", "sa"), sets.toDF("ib", "sb")
    both = pairs.join(x, F.col("a") == F.col("ia")).join(y, F.col("b") == F.col("ib")).select("a", "b", "sa", "sb")
    return both.mapInArrow(tidy(compare), "a bigint, b bigint").distinct()


def linked(docs: DataFrame) -> DataFrame:
    """(id, component_id) of the classes of equal documents that have a link."""
    bits = block_bits(docs.count())
    kept = stored(_kept_columns(docs, bits, _hot_columns(docs, bits)))
    hot = stored(_hot_rows(kept))
    pairs = stored(_cold_pairs(kept).union(_pivot_pairs(hot)).distinct())
    found = stored(_verified(docs, pairs))
    comps = components(found)
    crossing = stored(_crossing_pairs(hot, comps).join(pairs, ["a", "b"], "left_anti"))
    if crossing.isEmpty():
        return comps
    return components(found.union(_verified(docs, crossing)))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    meta = stored(described(docs))
    classes = meta.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    comps = linked(docs).select(F.col("id").alias("rep"), "component_id")
    classes = classes.join(comps, "rep", "left").select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.coalesce("component_id", "rep").alias("component_id"))
    out = meta.join(classes, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the ids of ``gone``. Only rows that a bounded filter cannot rule out are joined, so most texts are not shuffled."""
    may_go = IdFilter.of(gone).may_have(F.col("doc_id"))
    cols = [F.col(quoted(c)) for c in docs.columns]
    some = docs.where(may_go).join(gone.withColumnRenamed("doc_id", free(docs, "gone_id")), F.col("doc_id") == F.col(free(docs, "gone_id")), "left_anti")
    return docs.where(~may_go).select(*cols).union(some.select(*cols))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of linked documents: that with the smallest id. Columns as they were.

    Documents without words stay, each for itself. Where rows share an id, one row of the id that stays is kept.
    """
    found = stored(join(docs))
    gone = stored(found.where("n_shingles > 0 and component_id <> doc_id").select("doc_id").distinct())
    left = _without(docs, gone)
    repeated = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return left
    twice = repeated.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return left.join(twice, "doc_id", "left_anti").select(*left.columns).union(left.join(twice, "doc_id", "left_semi").select(*left.columns).dropDuplicates(["doc_id"]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (SELECT g, count(*) AS f FROM s GROUP BY g
), o AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM s JOIN n USING (doc_id) JOIN f USING (g)
), k AS (SELECT * FROM o WHERE r <= n - ceil(0.75 * n) + 1
), c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM k x JOIN k y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
), l AS (
  SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 75 * (na + nb - count(*))
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r(id, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""
