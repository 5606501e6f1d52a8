"""Toxicity as logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text are its distinct words and their stems (beginnings of
``STEMS`` bytes), pairs of neighbours and pairs with one word between,
lower-cased and hashed to ``2 ** BITS`` coordinates. FTRL-proximal has a learning rate for each coordinate and an
L1 term that leaves most weights exactly zero; only the others are broadcast
(at most 2 ** BITS, in practice some thousands).

Training uses at most about ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of their
features, chosen by a hash of their id, in one task; both bounds are documented and
do not grow with the corpus. A row with more features than a 64th of that is not
learnt from (it is scored as a whole like any other). Ids may be of any type.
Labels of a document given twice: the larger counts; null labels count for
nothing. Without labels every score is 0.5 to the prior's side (logistic of the
bias alone). Null and empty texts are scored by the bias. Repeated rows give
repeated results, an empty table an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .quality import fold
from .tokens import LETTERS_ONLY, U64, Words, mix, starts_of, words

BITS = 20
SAMPLE = 20_000
SAMPLE_BYTES = 256 << 20
EPOCHS = 4
#: Beginnings of words, in bytes, that count as their stems: forms of a word that training did not show are known by them.
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 0.15, 1.0, 3.0, 0.5
#: How much a toxic training row counts, as they are few.
POSITIVE = 2.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
_BIAS = 0


def coordinates(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every feature, with repeats."""
    h = w.hashes
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    parts = [(row, mix(h))]
    for gap in (1, 2):
        same = row[gap:] == row[:-gap]
        parts.append((row[gap:][same], mix(h[:-gap] * U64(3) + mix(h[gap:] + U64(gap)))[same]))
    for size in STEMS:
        longer = w.length > size
        parts.append((row[longer], starts_of(w, longer, size)))
    return np.concatenate([r for r, _ in parts]), (np.concatenate([x for _, x in parts]) >> U64(64 - BITS)).astype(np.int64)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def features(batch_column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct coordinates of each row, in order of rows."""
    for w in words(_lowered(batch_column), separator=LETTERS_ONLY):
        row, x = coordinates(w)
        both = np.unique((row << BITS) | x)
        cut = np.searchsorted(both, np.arange(len(w.first)) << BITS)
        x = (both & ((1 << BITS) - 1)).astype(np.int32)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield x[a:b]


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero; coordinate 0 is the bias, which has no L1."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        pull = np.where(i == _BIAS, 0.0, L1)
        return np.where(np.abs(zi) <= pull, 0.0, -(zi - np.sign(zi) * pull) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in rows:
            i = np.concatenate([[_BIAS], x[x != _BIAS]])
            w = weight(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - y) * (POSITIVE if y else 1.0)
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    i = np.flatnonzero(n)
    w = weight(i)
    return i[w != 0], w[w != 0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    known = labels.where(F.col(label).isNotNull() & (F.lit(True) if usable is None else usable)).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = sample / max(1, known.count())
    known = known.withColumn("place", F.xxhash64(F.col("doc_id"), F.lit(5)))
    bound = lambda part: int(min(1.0, part) * 2.0**64 - 2.0**63)
    chosen = known.where(F.col("place") < bound(share)) if share < 1 else known

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array([x.tobytes() for x in got], pa.binary())], names=["place", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, np.frombuffer(x, np.int32)) for b in batches for i, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(U64))[0]), r[1]))
        i, w = train([(x, int(y > 0)) for _, y, x in rows])
        yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["i", "w"])

    # chosen has at most about SAMPLE rows of three numbers, whatever the corpus
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "text", "y").mapInArrow(tidy(gather), "place bigint, y int, x binary")
    rows = stored(rows).where(F.octet_length("x") <= SAMPLE_BYTES // 64)
    size = rows.agg(F.sum(F.octet_length("x").cast("bigint"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        rows = rows.where(F.xxhash64("place") < bound(SAMPLE_BYTES / size))
    got = rows.repartition(1).mapInArrow(tidy(learn), "i binary, w binary").collect()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.frombuffer(got[0]["i"], np.int32).astype(np.int64), np.frombuffer(got[0]["w"], np.float64)


def scores(column: pa.Array, i: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic of the weights of each row's distinct features."""
    dense = np.zeros(1 << BITS)
    dense[i] = w
    bias, dense[_BIAS] = dense[_BIAS], 0.0
    out = []
    for part in words(_lowered(column), separator=LETTERS_ONLY):
        row, x = coordinates(part)
        hit = dense[x] != 0
        both = np.unique((row[hit] << BITS) | x[hit])
        z = np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=len(part.first) - 1)
        out.append(1.0 / (1.0 + np.exp(-np.clip(z + bias, -35.0, 35.0))))
    return np.concatenate(out) if out else np.zeros(0)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    i, w = fit(docs, labels.select("doc_id", "toxic"), usable=~held)
    weights = docs.sparkSession.sparkContext.broadcast((i, w))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), *weights.value))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(tidy(work), f"doc_id {kind}, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
