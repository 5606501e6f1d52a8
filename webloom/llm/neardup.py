"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Vectors are scaled to length 1 in double precision; equal ones form a class.
2. Centroids are fitted to a bounded sample (``PER_CELL`` vectors a cell, at most ``SAMPLE``); every vector
   goes to its ``OVERLAP`` nearest cells, so cells overlap. A cell above ``SHARD``
   vectors gets up to ``FINE`` centroids of its own, fitted to ``FIT`` of its
   vectors, and a vector goes to the nearest ones of all its cells; only a cell
   where over a share ``DENSE`` of sampled pairs link is left as it is. Cells still above
   ``SHARD`` are split into parts by hash, and every two parts of a cell
   make a shard, so that no task holds an unbounded cell.
3. In each shard a graph is built: candidates are a vector's nearest ones and
   robust pruning keeps those that no kept one makes redundant (factor
   ``ALPHA``), up to ``DEGREE``; edges run both ways. A group of more near copies
   than candidates may fall into pieces without an edge between them: each vector
   of a piece gets an edge to its nearest one within the range outside it, until
   no link leaves a piece.
4. The adjacency lists of all shards are united for each vector.
5. Each shard is searched on the united graph for each vector from itself and
   from the medoid: greedy, with a beam; from what it finds within the range the search expands over the
   neighbours of hits until it finds no more.
6. Hits are verified in double precision: cosine >= 0.9. A pair counts in the
   first shard that holds both, for both its ends, whichever of them found it, so counts add up without listing pairs. Of the
   links a shard keeps a spanning forest; components come from the forests.
7. Vectors drawn by a hash are compared with all rows by brute force, ``AUDIT``
   at first and more until ``LINKED`` of them have links; then the same outside
   groups of over a share ``LARGE`` of all, which would hide losses elsewhere. If
   for either draw the mean share of links that the search found of a vector is
   less than ``RECALL`` it is repeated with more overlap, and if that does not do,
   all pairs are compared.

Vectors that are null, zero or hold null or non-finite components link with
nothing; vectors of other dimensions link only with their like. Equal vectors
link with one another. Rows that share an id count as further vectors of that id:
each row has its own vector's links, and their components are one. A null id gets
a null component. Other columns are not looked at, whatever their names. An empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .components import components

log = logging.getLogger(__name__)

THRESHOLD = 0.9
SAMPLE = 65_536
PER_CELL = 32
CELL = 1024
CELLS_MOST = 16_384
#: Centroids within a large cell, vectors they are fitted to, and vectors assigned to them at once.
FINE = 256
FIT = 8192
ASSIGN = 16_384
DENSE = 1 / 64
#: Numbers in a block of cosines between vectors and centroids.
BLOCK = 1 << 22
OVERLAP = 4
SHARD = 4096
DEGREE = 24
NEAREST = 64
ALPHA = 1.2
BEAM = 16
AUDIT = 256
LINKED = 64
#: Vectors that one draw of the audit compares at once and at most.
AUDIT_BLOCK = 4096
AUDIT_MOST = 65_536
LARGE = 1 / 64
RECALL = 0.95
_EPS = 1e-12


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's unit vector, or None where it links with nothing."""
    out = []
    for v in column.to_pylist():
        x = None if v is None or not len(v) or any(c is None for c in v) else np.array(v, np.float64)
        if x is not None:
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
            if x is not None:
                x = x / np.linalg.norm(x)
        out.append(x)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """id, key (a digest of the unit vector; null: links with nothing), dimension and unit vector as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if x is None else x.tobytes() for x in _vectors(b.column(1))]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array([len(r or b"") // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "key", "dim", "v"])

    return rows.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(tidy(work), "vec_id bigint, key binary, dim int, v binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centroids of each vector, in no order; block by block, as both may be many."""
    step = max(1, BLOCK // len(c))
    parts = [np.argpartition(-(x[a : a + step] @ c.T), m - 1, axis=1)[:, :m] for a in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, m), np.int64)


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means with fixed starts."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > _EPS, total / np.maximum(norm, _EPS)[:, None], c)
    return c


def _near(reps: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(id, cells): each class's nearest cells. Cells of a dimension have numbers of their own, multiples of FINE."""
    shared = reps.sparkSession.sparkContext.broadcast(centres)  # at most CELLS_MOST vectors for each dimension

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = {}, 0
        for d in sorted(shared.value):
            base[d] = at
            at += len(shared.value[d])
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                c, x = shared.value[d], _matrix(part.column(2))
                m = min(overlap, len(c))
                cells = (nearest(x, c, m).astype(np.int64) + base[d]) * FINE
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "cells"])

    return reps.select("id", "dim", "v").mapInArrow(tidy(work), "id bigint, cells array<bigint>")


def _refined(reps: DataFrame, near: DataFrame, overlap: int) -> DataFrame:
    """(id, cells): large cells replaced by the nearest of their own finer ones, at most ``overlap`` cells for each class."""
    placed = near.select("id", F.explode("cells").alias("c"))
    sizes = stored(placed.groupBy("c").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD))
    if sizes.isEmpty():
        return near
    # at most CELLS_MOST rows for each dimension
    copies = placed.join(F.broadcast(sizes), "c").join(reps.select("id", "v"), "id")

    def fit(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        c, size = (k.as_py() for k in key)
        x = _matrix(t.take(pa.array(np.argsort(t.column("id").to_numpy()))).column("v"))
        some = x[:: max(1, len(x) // 1024)]
        dense = len(some) > 1 and ((some @ some.T >= THRESHOLD).sum() - len(some)) / (len(some) * (len(some) - 1)) > DENSE
        k = min(FINE, -(-size // CELL), len(x))
        rows = [] if dense or k < 2 else [centroids(x, k).tobytes()]
        return pa.table({"c": pa.array([c] * len(rows), pa.int64()), "size": pa.array([size] * len(rows), pa.int64()), "centres": pa.array(rows, pa.binary())})

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("id").to_numpy(), _matrix(left.column("v"))
        if not len(x):
            return pa.table({"id": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        c = np.frombuffer(right.column("centres")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        m = min(overlap, len(c))
        at = nearest(x, c, m)
        sims = np.stack([np.einsum("rd,rd->r", x, c[at[:, j]]) for j in range(m)], axis=1)
        return pa.table({"id": np.repeat(ids, m), "cell": right.column("c")[0].as_py() + at.ravel().astype(np.int64), "sim": sims.ravel()})

    sample = copies.where(F.pmod(F.xxhash64("id", F.lit(5)), F.col("size")) < FIT)  # about FIT of each cell
    fine = stored(sample.groupBy("c", "size").applyInArrow(fit, "c bigint, size bigint, centres binary"))
    split = F.broadcast(fine.select("c"))
    blocks = F.ceil(F.col("size") / ASSIGN).cast("int")
    left = copies.join(split, "c").select("c", F.pmod(F.xxhash64("id", F.lit(6)), blocks).cast("int").alias("s"), "id", "v")
    right = fine.withColumn("s", F.explode(F.sequence(F.lit(0), blocks - 1)))
    picked = left.groupBy("c", "s").cogroup(right.groupBy("c", "s")).applyInArrow(pick, "id bigint, cell bigint, sim double")
    whole = placed.join(split, "c", "left_anti").select("id", F.col("c").alias("cell"), F.lit(2.0).alias("sim"))
    # at most overlap * overlap entries for each class
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "cell"))), 1, overlap)
    return stored(whole.union(picked).groupBy("id").agg(best["cell"].alias("cells")))


def _assigned(reps: DataFrame, near: DataFrame) -> DataFrame:
    """(cell, id, cells, n, v): each class in its cells."""
    return reps.select("id", "n", "v").join(near, "id").select(F.explode("cells").alias("cell"), "id", "cells", "n", "v")


def _sharded(reps: DataFrame, near: DataFrame) -> DataFrame:
    """Adds the shard (cell, x, y): a cell of at most SHARD is one; else every two of its parts are one."""
    sizes = near.select(F.explode("cells").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD)
    sizes = stored(sizes.select("c", F.ceil(F.col("size") / (SHARD / 2)).cast("int").alias("k")))
    df = _assigned(reps, near).join(sizes, F.col("cell") == F.col("c"), "left").withColumn("big", F.col("c").isNotNull())
    part = F.when(F.col("big"), F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).otherwise(F.lit(0))
    df = df.withColumn("part", part)
    others = F.when(F.col("big"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.lit(0)))
    df = df.withColumn("o", F.explode(others))
    return df.select("cell", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y"), "id", "cells", "part", "n", "v")


def robust_prune(x: np.ndarray, near: np.ndarray, sims: np.ndarray) -> list[np.ndarray]:
    """Of each row's candidates (nearest first) those that no kept one is closer to by the factor ALPHA."""
    rows, width = near.shape
    alive = np.ones((rows, width), bool)
    kept = np.zeros((rows, width), bool)
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
    some = np.arange(rows)
    for _ in range(DEGREE):
        open_ = alive & ~kept
        has = open_.any(axis=1)
        if not has.any():
            break
        r = some[has]
        pick = np.argmax(open_[r], axis=1)  # the nearest of those left
        kept[r, pick] = True
        chosen = x[near[r, pick]]
        between = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("rwd,rd->rw", x[near[r]], chosen)))
        alive[r] &= ALPHA * between > dist[r]
    return [near[i][kept[i]] for i in range(rows)]


def build(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of one shard, both ways."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    width, out = min(NEAREST, n - 1), []
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), a + np.arange(len(sims))] = -2.0
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        s = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        out += robust_prune(x, np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1))
    src = np.repeat(np.arange(n), [len(o) for o in out])
    dst = np.concatenate(out)
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src, *_bridges(x, src, dst)]))
    cut = np.searchsorted(pairs, np.arange(n + 1) * n)
    return [pairs[a:b] % n for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _pieces(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after the edges a-b join theirs: the least of each piece."""
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for ends in (a, b):
            np.minimum.at(new, label[ends], low)
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _bridges(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    """Edges (from * n + to) between pieces of links that no edge joins.

    In each of at most log2(n) rounds one out of each vector, and back the nearest of each piece.
    """
    n, out = len(x), []
    near = np.concatenate([np.einsum("rd,rd->r", x[src[a : a + 8192]], x[dst[a : a + 8192]]) >= THRESHOLD for a in range(0, len(src), 8192)])
    label = _pieces(np.arange(n), src[near], dst[near])
    while True:
        to, high = np.full(n, -1, np.int64), np.zeros(n)
        for a in range(0, n, 512):
            sims = x[a : a + 512] @ x.T
            sims[label[a : a + 512, None] == label[None, :]] = -2.0
            best = np.argmax(sims, axis=1)
            high[a : a + 512] = sims[np.arange(len(sims)), best]
            to[a : a + 512] = np.where(high[a : a + 512] >= THRESHOLD, best, -1)
        some = np.flatnonzero(to >= 0)
        if not len(some):
            return out
        some = some[np.argsort(-high[some], kind="stable")]
        back = some[np.unique(to[some] * n + label[some], return_index=True)[1]]
        out += [some * n + to[some], to[back] * n + back]
        label = _pieces(label, some, to[some])


def compare(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each vector and those within THRESHOLD, by brute force."""
    for a in range(0, len(x), 256):
        for i, near in enumerate(x[a : a + 256] @ x.T >= THRESHOLD):
            yield a + i, np.flatnonzero(near)


def search(x: np.ndarray, graph: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each vector and those that a range-expanding greedy search from itself and the medoid finds within THRESHOLD."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    width = max(1, max(map(len, graph)))
    padded = np.full((n, width), -1, np.int64)
    for i, g in enumerate(graph):
        padded[i, : len(g)] = g
    for a in range(0, n, 256):
        q = x[a : a + 256]
        found = _beam(x, padded, q, medoid, a + np.arange(len(q)))
        for i in range(len(q)):
            yield a + i, _expand(x, graph, q[i], found[i])


def _beam(x: np.ndarray, padded: np.ndarray, q: np.ndarray, medoid: int, own: np.ndarray) -> list[np.ndarray]:
    """The beams of all queries at once: the best vectors met by following the best not yet followed."""
    rows, n = len(q), len(x)
    seen = np.zeros((rows, n), bool)
    best = np.full((rows, BEAM), -1, np.int64)
    sims = np.full((rows, BEAM), -9.0)
    done = np.ones((rows, BEAM), bool)
    best[:, 0], sims[:, 0], done[:, 0] = medoid, q @ x[medoid], False
    seen[:, medoid] = True
    r = np.flatnonzero(own != medoid)
    best[r, 1], sims[r, 1], done[r, 1] = own[r], np.einsum("rd,rd->r", q[r], x[own[r]]), False
    seen[r, own[r]] = True
    while True:
        r = np.flatnonzero(~done.all(axis=1))
        if not len(r):
            return [b[s > -9.0] for b, s in zip(best, sims, strict=True)]
        at = np.argmax(np.where(done[r], -9.0, sims[r]), axis=1)
        done[r, at] = True
        near = padded[best[r, at]]
        ok = (near >= 0) & ~seen[r[:, None], near]
        seen[np.repeat(r, ok.sum(axis=1)), near[ok]] = True
        s = np.where(ok, np.einsum("rwd,rd->rw", x[near], q[r]), -9.0)
        every, score, flag = np.hstack([best[r], near]), np.hstack([sims[r], s]), np.hstack([done[r], ~ok])
        top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
        best[r], sims[r], done[r] = (np.take_along_axis(z, top, axis=1) for z in (every, score, flag))
        done[r] |= sims[r] <= -9.0


def _expand(x: np.ndarray, graph: list[np.ndarray], q: np.ndarray, start: np.ndarray) -> np.ndarray:
    known = np.zeros(len(x), bool)
    known[start] = True
    front = start[x[start] @ q >= THRESHOLD]
    hits = [front]
    while len(front):
        near = np.unique(np.concatenate([graph[i] for i in front]))
        near = near[~known[near]]
        known[near] = True
        front = near[x[near] @ q >= THRESHOLD]
        hits.append(front)
    return np.concatenate(hits)


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a symmetric matrix that join each of its pieces without a ring."""
    left, a, b = np.ones(len(links), bool), [], []
    for begin in range(len(links)):
        open_ = [begin] if left[begin] else []
        left[begin] = False
        while open_:
            i = open_.pop()
            new = np.flatnonzero(links[i] & left)
            left[new] = False
            open_ += new.tolist()
            a.append(np.full(len(new), i))
            b.append(new)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _graph(shards: DataFrame) -> DataFrame:
    """(i, near): the united adjacency list of each class."""

    def work(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        graph = build(_matrix(t.column("v")))
        return pa.table({"i": pa.array(ids, pa.int64()), "near": pa.array([ids[g].tolist() for g in graph], pa.list_(pa.int64()))})

    built = shards.groupBy("cell", "x", "y").applyInArrow(work, "i bigint, near array<bigint>")
    # at most OVERLAP lists of bounded length for each class
    return built.groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _found(shards: DataFrame, graph: DataFrame | None) -> DataFrame:
    """Rows (a, b, n): with b null, vectors found for class a in a shard; else a link of a spanning forest. Without a graph by brute force."""
    exact = graph is None

    def work(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cell, px, py = (k.as_py() for k in key)
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        ids, counts, part = (t.column(c).to_numpy() for c in ("id", "n", "part"))
        x, cells = _matrix(t.column("v")), t.column("cells").to_pylist()
        lists = []
        for near in [] if exact else t.column("near").to_pylist():
            g = np.array(near, np.int64)
            at = np.minimum(np.searchsorted(ids, g), len(ids) - 1)
            lists.append(at[ids[at] == g])
        most = max(map(len, cells))
        cells = np.array([c + c[:1] * (most - len(c)) for c in cells], np.int64)  # a cell given twice changes nothing
        links = np.zeros((len(ids), len(ids)), bool)
        for i, hits in compare(x) if exact else search(x, lists, counts):
            links[i, hits] = True
        links |= links.T  # what either end finds both have
        np.fill_diagonal(links, False)
        total = np.zeros(len(ids), np.int64)
        for i in np.flatnonzero(links.any(axis=1)):
            hits = np.flatnonzero(links[i])
            # A pair counts in the first cell that has both, and there in the shard of their two parts.
            both = (cells[hits][:, :, None] == cells[i][None, None, :]).any(axis=2)
            first = np.where(both, cells[hits], np.iinfo(np.int64).max).min(axis=1)
            parts = np.minimum(part[hits], part[i]), np.maximum(part[hits], part[i])
            own = (first == cell) & (((parts[0] == px) & (parts[1] == py)) if px != py else ((parts[0] == px) & (parts[1] == px)))
            total[i] = counts[hits[own]].sum()
        a, b = _forest(links)
        some = np.flatnonzero(total)
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], ids[a]]), pa.int64()),
                "b": pa.array([None] * len(some) + ids[b].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([total[some], np.zeros(len(a), np.int64)]), pa.int64()),
            }
        )

    both = shards if exact else shards.join(graph, F.col("id") == F.col("i")).drop("i")
    return both.groupBy("cell", "x", "y").applyInArrow(work, "a bigint, b bigint, n bigint")


class Audit(NamedTuple):
    """Of the vectors compared: how many, how many have links, how many of those found none, and the mean recall of those with links."""

    drawn: int
    linked: int
    none: int
    recall: float


def _true_links(reps: DataFrame, chosen: DataFrame) -> dict[int, int]:
    """The number of links of each chosen class that has some, by brute force over all rows."""
    own = reps.join(F.broadcast(chosen), F.col("id") == F.col("i")).select("id", "dim", "v").collect()  # at most AUDIT_BLOCK ids
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["dim"] for r in own}:
        some = [r for r in own if r["dim"] == d]
        by_dim[d] = (np.array([r["id"] for r in some]), np.stack([np.frombuffer(r["v"], np.float64) for r in some]))
    shared = reps.sparkSession.sparkContext.broadcast(by_dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in shared.value.items()}
        for b in batches:
            dims = b.column(2).to_numpy()
            for d, (ids, q) in shared.value.items():
                part = b.filter(pa.array(dims == d))
                if part.num_rows:
                    hit = (q @ _matrix(part.column(3)).T >= THRESHOLD) & (ids[:, None] != part.column(0).to_numpy()[None, :])
                    row, col = np.nonzero(hit)
                    np.add.at(total[d], row, part.column(1).to_numpy()[col])
        for d, (ids, _) in shared.value.items():
            some = np.flatnonzero(total[d])
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(total[d][some], pa.int64())], names=["i", "t"])

    return {r["i"]: r["t"] for r in reps.select("id", "n", "dim", "v").mapInArrow(tidy(work), "i bigint, t bigint").groupBy("i").agg(F.sum("t").alias("t")).collect()}


def _drawn(reps: DataFrame, found: DataFrame, pool: DataFrame) -> Audit:
    """Compares classes of the pool (column id) in order of a hash until LINKED of them have links."""
    pool, after, take, drawn, shares = pool.select("id", F.xxhash64("id", F.lit(3)).alias("h")), None, AUDIT, 0, []
    while len(shares) < LINKED and drawn < AUDIT_MOST:
        rows = (pool if after is None else pool.where(F.col("h") > after)).orderBy("h", "id").limit(take).collect()
        if not rows:
            break
        chosen = reps.sparkSession.createDataFrame([(i,) for i in {r["id"] for r in rows}], "i bigint")
        true = _true_links(reps, chosen)
        got = {r["a"]: r["n"] for r in found.where("b is null").join(F.broadcast(chosen), F.col("a") == F.col("i")).groupBy("a").agg(F.sum("n").alias("n")).collect()}
        shares += [min(t, got.get(i, 0)) / t for i, t in true.items()]
        after, drawn, take = rows[-1]["h"], drawn + len(rows), min(4 * take, AUDIT_BLOCK)
    return Audit(drawn, len(shares), sum(x == 0 for x in shares), sum(shares) / len(shares) if shares else 1.0)


def audit(reps: DataFrame, found: DataFrame, comps: DataFrame) -> list[Audit]:
    """What the search found of the links of vectors drawn from all, and of those outside large groups if there are some."""
    sizes = comps.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE * reps.count())
    large = [r["component_id"] for r in sizes.collect()]  # fewer than 1 / LARGE
    ids = reps.select("id")
    pools = [ids]
    if large:
        pools.append(ids.join(comps.where(F.col("component_id").isin(large)).select(F.col("id").alias("c")), F.col("id") == F.col("c"), "left_anti"))
    out = [_drawn(reps, found, p) for p in pools]
    for name, a in zip(("all", "outside large groups"), out):
        log.log(logging.INFO if a.linked >= LINKED else logging.WARNING, "audit, %s: %d vectors compared, %d with links, %d of them found none, mean recall %.4f", name, *a)
    return out


def near_duplicates(vectors: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    rows = stored(_classes(vectors))
    usable = rows.where("key is not null and vec_id is not null")
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    # A class has a number of its own: an id that several different vectors have stands for each of them.
    reps = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    named = usable.select("vec_id", "key").join(reps.select(F.col("key").alias("k"), "id"), F.col("key") == F.col("k")).groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    shared = stored(named.where("a < z").select("vec_id", F.col("a").alias("b")))
    same = usable.join(shared, "vec_id").join(reps.select(F.col("key").alias("k"), F.col("id").alias("a")), F.col("key") == F.col("k")).select("a", "b").where("a <> b")
    centres = {}
    for d, size in sorted((r["dim"], r["count"]) for r in reps.groupBy("dim").count().collect()):
        cells = max(1, min(CELLS_MOST, -(-size * overlap // CELL)))
        sample = reps.where(F.col("dim") == d).orderBy(F.xxhash64("key", F.lit(2)), "id").limit(min(SAMPLE, PER_CELL * cells)).select("v").toArrow()
        x = _matrix(sample.column("v"))
        centres[d] = centroids(x, min(cells, len(x)))
    while True:
        shards = stored(_sharded(reps, _refined(reps, stored(_near(reps, centres, overlap)), overlap)))
        found = stored(_found(shards, _graph(shards)))
        comps = components(found.where("b is not null").select("a", "b").union(same))
        if min(a.recall for a in audit(reps, found, comps)) >= RECALL:
            break
        if overlap >= min(4 * OVERLAP, max(map(len, centres.values()), default=0)):
            # One cell a dimension: every two parts of all vectors are a shard, so that no pair is left out.
            log.warning("links are missing at overlap %d: comparing all pairs", overlap)
            found = stored(_found(_sharded(reps, stored(_near(reps, {d: c[:1] for d, c in centres.items()}, 1))), None))
            comps = components(found.where("b is not null").select("a", "b").union(same))
            break
        overlap *= 2
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("m"))
    placed = reps.select("id", "key", "n", "least").join(comps.select(F.col("id").alias("c"), F.col("component_id").alias("root")), F.col("id") == F.col("c"), "left").withColumn("root", F.coalesce("root", "id"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    known = placed.join(least, F.col("root") == F.col("r")).join(counts, F.col("id") == F.col("a"), "left")
    known = known.select(F.col("key").alias("k"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, F.when(F.col("vec_id").isNotNull(), F.col("key")) == F.col("k"), "left")
    component = F.coalesce("component_id", "vec_id").alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component, F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9
), r(id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m.c, vec_id) AS component_id, vec_id = coalesce(m.c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.id = vec_id
"""
