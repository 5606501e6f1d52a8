"""Substring deduplication with a log-structured index of window fingerprints.

A word goes if a window of 20 consecutive words that covers it has the same
words as a window that starts earlier (in an earlier batch, at a smaller id, or
in the same document at an earlier start).

The index holds windows of eight words: of the thirteen in each window of 20,
that with the least hash (the leftmost of equals). Equal windows of 20 have the
same one at the same place, so looking those up finds all candidates with about
a seventh of the entries. An entry is the fingerprint of its window, a hash of
the 12 words on either side, the document and the place; of entries that agree
in both hashes one is kept, as any window of 20 around the one is around the
other too. A document has one entry more, the digest of all its words.

Entries lie in immutable runs, sorted within blocks by hash, in one table in the
shared folder that is partitioned by run and bucketed by block. A batch is hashed
and sorted, and its blocks are merge-joined with those of all runs, bucket by
bucket: only the batch is shuffled, history is read where it lies. The batch's
entries then become a run themselves. When ``FANOUT`` runs of a level have come
together they are compacted to one of the next level, without a shuffle, so an
entry is rewritten once for each level and not once for each batch. A manifest
names the runs that count; it is written after them, so what a lost driver left
behind is passed over. ``Index.open`` goes on where an earlier session ended.

What meets an equal fingerprint is a candidate. Candidates are verified: all
windows of 20 around them, in the batch and in the earlier documents that they
met, are compared by two independent hashes of their words (at least 100 bits), and only
then is anything cut. Texts of earlier documents are taken from a table that the
caller names; the index keeps none. Documents of equal words are known by their
digests, so copies cost one entry. Repeats are folded in each task before they
are dealt out, so a passage that a third of all rows have meets in one place only
once for each task, not once for each row.

Null and empty texts have no words; documents of fewer than 20 words keep all.
Null ids are compared with nothing. Rows that share an id are taken as one
document; an id that the index has already is that document again. Other columns
are not looked at, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import IdFilter, block_bits, pack, unpack
from .common import checkpoint_dir, folder, stored, tidy
from .tokens import U64, Words, mix, runs_of, words

WINDOW = 20
INDEXED = 8
BATCHES = 3
FANOUT = 2
BUFFER = 1 << 19
_LOW = U64(0xFFFFFFFF)
_EMPTY = hashlib.sha256(b"").hexdigest()
#: The place of a document's digest among its entries.
WHOLE = -1


def joined(w: Words) -> Iterator[bytes]:
    """Each row's words joined by one space."""
    inside = np.zeros(len(w.raw) + 1, np.int32)
    inside[w.start] = 1
    inside[w.start + w.length] -= 1
    keep = np.cumsum(inside)[:-1] > 0
    out = np.where(keep, w.raw, 32).astype(np.uint8)
    after = np.zeros(len(w.raw), bool)
    end = w.start + w.length
    after[end[end < len(w.raw)]] = True
    after &= ~keep
    keep |= after
    for i in range(len(w.first) - 1):
        lo, hi = w.row_bytes[i], w.row_bytes[i + 1]
        yield out[lo:hi][keep[lo:hi]].tobytes().rstrip(b" ")


def _digest(w: Words, row: int) -> np.ndarray:
    """Two 64-bit numbers of all words of a row."""
    return np.frombuffer(hashlib.blake2b(w.hashes[w.first[row] : w.first[row + 1]].tobytes(), digest_size=16).digest(), U64)


def described(docs: DataFrame) -> DataFrame:
    """id, n_words, a digest of the words (k1, k2) and the SHA-256 of the words joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k, sha = [], [], []
            for w in words(b.column(1)):
                n += np.diff(w.first).tolist()
                k += [_digest(w, i).view(np.int64).tolist() for i in range(len(w.first) - 1)]
                sha += [hashlib.sha256(x).hexdigest() for x in joined(w)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array(sha, pa.string())], names=["id", "n_words", "k1", "k2", "sha"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(work), "id bigint, n_words bigint, k1 bigint, k2 bigint, sha string")


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of WINDOW words its first word and its indexed window's; hashes of indexed windows; the row of each word."""
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    n = len(w.hashes) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), row
    r = runs_of(w.hashes, INDEXED)
    best, at = r[:n].copy(), np.arange(n)
    for k in range(1, WINDOW - INDEXED + 1):
        other = r[k : k + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    start = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    return start, at[start], r, row


def surroundings(w: Words, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A hash of the words up to WINDOW - INDEXED before and after the indexed windows that begin at ``at``, as far as the row has them."""
    reach = WINDOW - INDEXED
    lo, hi = w.first[row[at]], w.first[row[at] + 1]
    total = np.zeros(len(at), U64)
    for k, odd in enumerate(mix(np.arange(2 * reach + INDEXED, dtype=U64) + U64(1 << 20)) | U64(1)):
        i = at - reach + k
        has = (i >= lo) & (i < hi)
        total += np.where(has, w.hashes[np.where(has, i, 0)] + U64(1), U64(0)) * odd
    return mix(total)


def _doc_block(ids: np.ndarray, bits: int) -> np.ndarray:
    """Rows about documents come after the 2 ** bits blocks of fingerprints."""
    return (mix(ids.astype(np.int64).view(U64)) >> U64(64 - bits)).astype(np.int64) + (1 << bits)


_ROWS = "block int, old int, low binary, more binary, ids binary, at binary"
_MERGED = "part string, block int, low binary, more binary, ids binary, at binary"


def _rows(block: np.ndarray, ids: np.ndarray, at: np.ndarray, low: np.ndarray | None = None, more: np.ndarray | None = None, old: int = 0) -> pa.RecordBatch:
    none = np.zeros(len(ids), np.uint8)[:, None][:, :0]
    packed = pack(block, {"low": none if low is None else low, "more": none if more is None else more, "ids": ids.astype(np.int64), "at": at.astype(np.int32)}, old=old)
    return packed.select(["block", "old", "low", "more", "ids", "at"])


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpack(t, "low", np.uint32), unpack(t, "more", U64), unpack(t, "ids", np.int64), unpack(t, "at", np.int32)


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal rows begins."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _differs(begin: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows are at another place than the first of their group; a row given twice is not a repeat of itself."""
    head = np.repeat(begin, np.diff(np.append(begin, len(ids))))
    return (ids != ids[head]) | (at != at[head])


class Entries(NamedTuple):
    """What a set of entries says of itself: the entries to keep, and those that meet others (as numbers of rows)."""

    kept: np.ndarray
    met: np.ndarray


def _examined(fp: np.ndarray, more: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Entries:
    """Kept is the first of those that agree in both hashes. An entry with an equal fingerprint elsewhere is met; of digests, all but the first."""
    order = np.lexsort((at, ids, more, fp))
    if not len(order):
        return Entries(order, order)
    f, m, i, a = fp[order], more[order], ids[order], at[order]
    whole = a == WHOLE
    both = _heads(f, m, whole)
    later = _differs(both, i, a)
    alike = _heads(f)
    size = np.diff(np.append(alike, len(f)))
    several = np.repeat(np.logical_or.reduceat(_differs(alike, i, a) & ~whole, alike), size)
    return Entries(order[both], order[np.where(whole, later, several)])


def _entries(docs: DataFrame, bits: int) -> DataFrame:
    """A batch's entries, dealt by block. Those that a task sees to meet one another already go to the blocks of documents."""
    shift = U64(64 - bits - 32)

    def fold(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        fp, more, ids, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        kept, met = _examined(fp, more, ids, at)
        if len(met):
            yield _rows(_doc_block(ids[met], bits), ids[met], at[met], more=more[met])
        yield _rows((fp[kept] >> U64(32)).astype(np.int64), ids[kept], at[kept], (fp[kept] & _LOW).astype(np.uint32), more[kept])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in words(b.column(1)):
                _, at, r, row = anchors(w)
                if len(at):
                    at = at[np.diff(at, prepend=-1) != 0]
                    parts.append((r[at] >> shift, surroundings(w, at, row), ids[w.rows][row[at]], at - w.first[row[at]]))
                    held += len(at)
                long = np.flatnonzero(np.diff(w.first) >= WINDOW)
                if len(long):
                    k = np.stack([_digest(w, i) for i in long])
                    parts.append((k[:, 0] >> shift, k[:, 1], ids[w.rows][long], np.full(len(long), WHOLE, np.int64)))
                    held += len(long)
                if held >= BUFFER:
                    yield from fold(parts)
                    parts, held = [], 0
        if parts:
            yield from fold(parts)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(work), _ROWS)


def _members(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values of x a sorted array has."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def _in_history(low: np.ndarray, more: np.ndarray, old_low: np.ndarray, old_more: np.ndarray) -> np.ndarray:
    """Which entries agree in both hashes with one of the history."""
    out, n = np.zeros(len(low), bool), len(old_low)
    if n and len(low):
        f, m = np.concatenate([old_low, low]), np.concatenate([old_more, more])
        order = np.lexsort((m, f))  # stable: of equals, those of the history come first
        begin = _heads(f[order], m[order])
        known = np.repeat(order[begin] < n, np.diff(np.append(begin, len(order))))
        new = order >= n
        out[order[new] - n] = known[new]
    return out


class Index:
    """Sorted runs of entries in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self.table = f"webloom_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (block INT, low BINARY, more BINARY, ids BINARY, at BINARY, part STRING) USING parquet "
            f"PARTITIONED BY (part) CLUSTERED BY (block) SORTED BY (block) INTO {self.buckets} BUCKETS LOCATION '{path}/entries'"
        )

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, n_docs: int = 1 << 20) -> Index:
        """An empty index, in a new folder unless one is named. ``n_docs``: about how many documents it is to hold; it sets the number of blocks."""
        path = path or f"{checkpoint_dir(spark)}/webloom-index-{uuid.uuid4().hex}"
        folder(spark, f"{path}/entries").mkdirs()
        index = cls(spark, path, {"bits": block_bits(n_docs), "next": 0, "runs": []})
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """An index that this or another session made."""
        manifests = folder(spark, f"{path}/manifest")
        index = cls(spark, path, json.loads(manifests.read(max(n for n in manifests.names() if n.isdigit()))))
        spark.sql(f"ALTER TABLE {index.table} RECOVER PARTITIONS")
        return index

    @property
    def bits(self) -> int:
        return self.state["bits"]

    @property
    def buckets(self) -> int:
        return 1 << max(3, self.bits - 4)

    def _save(self) -> None:
        manifests = folder(self.spark, f"{self.path}/manifest")
        n = max((int(n) for n in manifests.names() if n.isdigit()), default=-1) + 1
        manifests.write(f"{n:012d}", json.dumps(self.state))

    def _parts(self, *names: str) -> DataFrame:
        return self.spark.table(self.table).where(F.col("part").isin([*names, ""]))

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").option("compression", "zstd").partitionBy("part").bucketBy(self.buckets, "block").sortBy("block").saveAsTable(self.table)

    def _drop(self, parts: list[str]) -> None:
        for p in parts:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (part = '{p}')")
            folder(self.spark, f"{self.path}/entries/part={p}").delete()

    def add(self, batch: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merge-joins a batch with all runs and makes it one itself.

        Gives its copies (id and k2, the second half of their digest) and its windows that start earlier too (id, at).
        """
        self._compact()
        n, bits = self.state["next"], self.bits
        kinds = ("run", "found", "copy", "met")
        self._drop([f"{k}-{n}" for k in kinds])  # of an attempt that did not end
        self._append(self._merged(batch, n))
        places = stored(_by_document(self._parts(f"found-{n}", f"met-{n}").withColumn("old", F.col("part").startswith("met").cast("int"))))
        copies = stored(_copies(self._parts(f"copy-{n}")))
        found, met = (places.where(c).select("id", "at") for c in ("old = 0 AND NOT whole", "old = 1"))
        repeats = stored(_repeats(batch, found, corpus, met, bits))
        self.state = {**self.state, "next": n + 1, "runs": [*self.state["runs"], [n, 0]]}
        self._save()
        self._drop([f"{k}-{n}" for k in kinds[1:]])
        return copies, repeats

    def _merged(self, batch: DataFrame, n: int) -> DataFrame:
        bits = self.bits

        def named(name: str, rows: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{n}"] * rows.num_rows, pa.string()), *(rows.column(c) for c in ("block", "low", "more", "ids", "at"))], names=["part", "block", "low", "more", "ids", "at"])

        def to_documents(ids: np.ndarray, at: np.ndarray, more: np.ndarray) -> list[pa.RecordBatch]:
            block, whole = _doc_block(ids, bits), at == WHOLE
            return [named("found", _rows(block, ids, at)), named("copy", _rows(block[whole], ids[whole], at[whole], more=more[whole]))]

        def merge(key: tuple[pa.Scalar, ...], new: pa.Table, history: pa.Table) -> pa.Table:
            block = key[0].as_py()
            low, more, ids, at = _unpacked(new)
            if block >> bits:
                return pa.Table.from_batches(to_documents(ids, at, more))
            if not len(ids):
                return empty
            kept, met = _examined(low, more, ids, at)
            old_low, old_more, old_ids, old_at = _unpacked(history)
            same = _in_history(low, more, old_low, old_more)
            found = np.zeros(len(low), bool)
            found[met] = True
            found |= np.where(at == WHOLE, same, _members(low, np.unique(old_low)))
            found = np.flatnonzero(found)
            back = np.flatnonzero(_members(old_low, np.unique(low[at != WHOLE])) & (old_at != WHOLE))
            fresh = kept[~same[kept]]
            out = []
            if len(fresh):
                out.append(named("run", _rows(np.full(len(fresh), block), ids[fresh], at[fresh], low[fresh], more[fresh])))
            if len(found):
                out += to_documents(ids[found], at[found], more[found])
            if len(back):
                out.append(named("met", _rows(_doc_block(old_ids[back], bits), old_ids[back], old_at[back])))
            return pa.Table.from_batches(out) if out else empty

        empty = pa.table({c: pa.array([], pa.string() if c == "part" else pa.int32() if c == "block" else pa.binary()) for c in ("part", "block", "low", "more", "ids", "at")})
        runs = self._parts(*(f"run-{r}" for r, _ in self.state["runs"]))
        dealt = _entries(batch, bits).repartition(self.buckets, "block")
        return dealt.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(merge, _MERGED)

    def _compact(self) -> None:
        """Merges the runs of a level if there are FANOUT of them; before a batch is added, so that no batch waits for what only the next one needs."""
        while True:
            levels: dict[int, list[int]] = {}
            for r, level in self.state["runs"]:
                levels.setdefault(level, []).append(r)
            full = [(level, runs) for level, runs in sorted(levels.items()) if len(runs) >= FANOUT]
            if not full:
                return
            level, runs = full[0]
            n = self.state["next"]
            self._drop([f"run-{n}"])
            self._append(self._compacted(runs, n))
            self.state = {**self.state, "next": n + 1, "runs": [*([r, x] for r, x in self.state["runs"] if r not in runs), [n, level + 1]]}
            self._save()
            self._drop([f"run-{r}" for r in runs])

    def _compacted(self, runs: list[int], n: int) -> DataFrame:
        def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            low, more, ids, at = _unpacked(t)
            kept = _examined(low, more, ids, at).kept
            rows = _rows(np.full(len(kept), key[0].as_py()), ids[kept], at[kept], low[kept], more[kept])
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([f"run-{n}"] * rows.num_rows, pa.string()), *(rows.column(c) for c in names)], names=["part", *names])])

        names = ("block", "low", "more", "ids", "at")
        return self._parts(*(f"run-{r}" for r in runs)).groupBy("block").applyInArrow(merge, _MERGED)

    def deduplicate(self, batch: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """doc_id, n_words, n_removed and kept_sha256 of a batch's documents, which come after all that the index has; then the index has them too.

        ``corpus``: a table with the texts of the earlier documents (others in it do no harm); not needed for the first batch.
        """
        copies, repeats = self.add(batch, batch if corpus is None else corpus)
        return _judged(batch, copies, repeats)

    def close(self) -> None:
        """Forgets the table's name; the folder stays and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def delete(self) -> None:
        self.close()
        folder(self.spark, self.path).delete()


def _by_document(rows: DataFrame) -> DataFrame:
    """(old, id, at, whole): the sorted distinct places of each document, and whether it is a copy of another."""

    def work(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids, at = unpack(t, "ids", np.int64), unpack(t, "at", np.int32)
        order = np.lexsort((at, ids))
        ids, at = ids[order], at[order]
        new = _heads(ids, at)
        ids, at = ids[new], at[new]
        begin = _heads(ids)
        cut = np.append(begin, len(ids))
        return pa.table(
            {
                "old": pa.array(np.full(len(begin), key[0].as_py()), pa.int32()),
                "id": pa.array(ids[begin], pa.int64()),
                "at": pa.array([at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                "whole": pa.array(at[begin] == WHOLE, pa.bool_()),
            }
        )

    return rows.groupBy("old", "block").applyInArrow(work, "old int, id bigint, at binary, whole boolean")


def _copies(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            yield pa.RecordBatch.from_arrays([pa.array(unpack(t, "ids", np.int64)), pa.array(unpack(t, "more", np.int64))], names=["id", "k2"])

    return rows.select("ids", "more").mapInArrow(tidy(work), "id bigint, k2 bigint").distinct()


def _with_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, z, at): compressed texts of the documents of ``places`` (stored: id, at)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze.compress((t.as_py() or "").encode()) for t in b.column(1)], pa.binary())], names=["doc", "z"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    some = IdFilter.of(places.select("id")).passing(known, F.col("doc")).mapInArrow(tidy(work), "doc bigint, z binary")
    return some.join(places, F.col("doc") == F.col("id")).select("id", "z", "at")


def _plain(column: pa.Array) -> pa.Array:
    expand = zstandard.ZstdDecompressor()
    return pa.array([expand.decompress(z) for z in column.to_pylist()], pa.large_binary())


def _repeats(batch: DataFrame, found: DataFrame, corpus: DataFrame, met: DataFrame, bits: int) -> DataFrame:
    """(id, at): the starts of the batch's windows that start earlier too. found, met: (id, at), stored."""
    shift = U64(64 - bits - 32)

    def fold(parts: list[tuple[np.ndarray, ...]], old: int) -> Iterator[pa.RecordBatch]:
        fp, more, ids, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, ids, more, fp))
        f, m, i, a = fp[order], more[order], ids[order], at[order]
        begin = _heads(f, m)
        if not old:
            later = _differs(begin, i, a)
            if later.any():
                yield _rows(_doc_block(i[later], bits), i[later], a[later])
        yield _rows((f[begin] >> U64(32)).astype(np.int64), i[begin], a[begin], (f[begin] & _LOW).astype(np.uint32), m[begin], old)

    def dealing(old: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, held = [], 0
            for b in batches:
                ids, places = b.column(0).to_numpy(), b.column(2).to_pylist()
                for w in words(_plain(b.column(1))):
                    start, at, _, row = anchors(w)
                    if not len(start):
                        continue
                    marked = np.zeros(len(row), bool)
                    for i, p in enumerate(places[w.rows]):
                        x = np.frombuffer(p, np.int32) + w.first[i]
                        marked[x[(x >= w.first[i]) & (x < w.first[i + 1])]] = True
                    start = start[marked[at]]
                    one, two = runs_of(w.hashes, WINDOW)[start], runs_of(w.hashes, WINDOW, seed=1)[start]
                    parts.append((one >> shift, two, ids[w.rows][row[start]], start - w.first[row[start]]))
                    held += len(start)
                    if held >= BUFFER:
                        yield from fold(parts, old)
                        parts, held = [], 0
            if held:
                yield from fold(parts, old)

        return deal

    def find(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        block = key[0].as_py()
        low, more, ids, at = _unpacked(t)
        if block >> bits:
            return pa.Table.from_batches([_rows(np.full(len(ids), block), ids, at)])
        new = 1 - np.repeat(t.column("old").to_numpy(), [len(x) // 8 for x in t.column("ids").to_pylist()])
        order = np.lexsort((at, ids, new, more, low))
        ids, at = ids[order], at[order]
        later = _differs(_heads(low[order], more[order]), ids, at) & (new[order] == 1)
        return pa.Table.from_batches([_rows(_doc_block(ids[later], bits), ids[later], at[later])])

    dealt = _with_texts(batch, found).mapInArrow(tidy(dealing(0)), _ROWS).union(_with_texts(corpus, met).mapInArrow(tidy(dealing(1)), _ROWS))
    return _by_document(dealt.groupBy("block").applyInArrow(find, _ROWS)).select("id", "at")


def _cut(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(id, x1, x2, n, s): for each document that loses words how many, and the SHA-256 of the others joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, ids, n, s, k = b.column(2).to_pylist(), b.column(0), [], [], []
            for w in words(_plain(b.column(1))):
                for i, p in enumerate(places[w.rows]):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    edge = np.zeros(hi - lo + WINDOW + 1, np.int32)
                    x = np.frombuffer(p, np.int32)
                    x = x[x < hi - lo]
                    edge[x] += 1
                    edge[x + WINDOW] -= 1
                    keep = np.cumsum(edge)[: hi - lo] == 0
                    left = np.flatnonzero(keep) + lo
                    n.append(hi - lo - len(left))
                    s.append(hashlib.sha256(b" ".join([w.raw[a : a + c].tobytes() for a, c in zip(w.start[left].tolist(), w.length[left].tolist(), strict=True)])).hexdigest())
                    k.append(_digest(w, i).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.string())], names=["id", "x1", "x2", "n", "s"])

    return _with_texts(docs, repeats).mapInArrow(tidy(work), "id bigint, x1 bigint, x2 bigint, n bigint, s string").dropDuplicates(["id", "x1", "x2"])


def _judged(docs: DataFrame, copies: DataFrame, repeats: DataFrame) -> DataFrame:
    """The result for ``docs``, of which ``copies`` (id, k2) lose all words and ``repeats`` (id, at) those of the windows that begin there."""
    known = described(docs)
    cut = _cut(docs, repeats).withColumnRenamed("id", "j")
    out = known.join(cut, (F.col("id") == F.col("j")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")), "left")
    out = out.join(copies.select(F.col("id").alias("c"), F.col("k2").alias("c2")), (F.col("id") == F.col("c")) & (F.col("k2") == F.col("c2")), "left")
    copy = F.col("c").isNotNull() & (F.col("n_words") >= WINDOW)
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0)))
    return out.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("s", "sha")).alias("kept_sha256"))


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document: in batches in order of id, through an index of their own."""
    spark, doc = docs.sparkSession, F.col("doc_id").cast("bigint")
    edge = docs.agg(F.count(F.lit(1)), F.min(doc), F.max(doc)).first()
    if edge[1] is None:
        return _judged(docs, *(spark.createDataFrame([], s) for s in ("id bigint, k2 bigint", "id bigint, at binary")))
    index = Index.create(spark, n_docs=edge[0])
    lo, size = edge[1], edge[2] - edge[1] + 1
    copies = repeats = None
    for k in range(batches):
        begin, end = lo + size * k // batches, lo + size * (k + 1) // batches - 1
        if begin > end:
            continue
        c, r = index.add(docs.where(doc.between(begin, end)), docs)
        copies, repeats = (c, r) if copies is None else (copies.union(c), repeats.union(r))
    index.delete()
    return _judged(docs, copies, repeats)


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w
), g AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM p
), f AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM g) WHERE r > 1
), c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM f
), r AS (SELECT doc_id, count(*) AS n, list(i) AS l FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN r.l IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(r.l, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
