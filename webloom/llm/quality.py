"""Quality as a regularised quadratic discriminant over transformed document statistics.

For each class (label 0 and 1) a mean and a covariance are fitted to statistics
of the text: shares of capitals, digits, symbols and other bytes, word lengths,
repetition, line breaks and length. The class covariance is shrunk towards the
pooled one and towards a multiple of the identity, so that it can always be
factored. A document's score is the logistic of the difference of log densities
(Mahalanobis distances through the cached Cholesky factors) plus the log prior.

The sufficient statistics are sums over all labelled rows, so the fit needs no
sample and only two rows reach the driver. Labels of a document given twice:
the larger counts; null labels count for nothing. With fewer than two labelled
documents in either class the score is the share of label 1 (1 if there are no
labels). Null and empty texts have statistics of zero and are scored like
others. Repeated rows give repeated results and their statistics count once for
each row. An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, plus, quoted, stored, tidy
from .tokens import Words, words

THRESHOLD = 0.3
TO_POOLED = 0.1
TO_IDENTITY = 0.02
FOLDS, HELD_OUT = 5, 0
NAMES = ("log_words", "word_length", "length_spread", "capitals", "digits", "symbols", "other_bytes", "symbol_ends", "symbol_words", "same_as_last", "distinct", "long_words", "breaks", "shouted")

_UPPER, _LOWER, _DIGIT, _SYMBOL, _OTHER, _BREAK = range(6)
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[10] = _UPPER, _LOWER, _DIGIT, _OTHER, _BREAK
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"()-?"]] = _SYMBOL


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def statistics(w: Words) -> np.ndarray:
    """(rows, len(NAMES)): square roots of shares, logarithms of counts."""
    n = np.diff(w.first).astype(np.float64)
    kinds = _CLASS[w.raw]
    share = [_sums(kinds == k, w.row_bytes) for k in range(6)]
    size = np.maximum(1.0, np.diff(w.row_bytes))
    per_word = np.maximum(1.0, n)
    length = w.length.astype(np.float64)
    end = w.start + w.length - 1
    is_symbol = kinds == _SYMBOL
    last = is_symbol[end]
    upper = (kinds == _UPPER).astype(np.int64)
    ups = np.concatenate([[0], np.cumsum(upper)])
    in_word = ups[end + 1] - ups[w.start] if len(end) else np.zeros(0, np.int64)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.first[:-1][w.first[:-1] < len(same)]] = False
    mean = _sums(length, w.first) / per_word
    spread = np.sqrt(np.maximum(0.0, _sums(length**2, w.first) / per_word - mean**2))
    distinct = np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)], np.float64)
    root = lambda x, over: np.sqrt(x / over)
    return np.column_stack(
        [
            np.log1p(n),
            np.log1p(mean),
            np.log1p(spread),
            root(share[_UPPER], size),
            root(share[_DIGIT], size),
            root(share[_SYMBOL], size),
            root(share[_OTHER], size),
            root(_sums(last, w.first), per_word),
            root(_sums(last & is_symbol[w.start] if len(end) else last, w.first), per_word),
            root(_sums(same, w.first), per_word),
            np.log1p(distinct) / np.maximum(1.0, np.log1p(n)),
            root(_sums(length > 24, w.first), per_word),
            root(share[_BREAK], size),
            root(_sums(in_word >= 2, w.first), per_word),
        ]
    )


def with_statistics(docs: DataFrame, name: str, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with the statistics as an array column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [statistics(w) for w in words(b.column(b.schema.get_field_index(text)))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, flat], names=[*kept, name])

    kept = list(keep if keep is not None else docs.columns)
    schema = plus(docs.select(*(F.col(quoted(c)) for c in kept)).schema, **{name: T.ArrayType(T.DoubleType())})
    return docs.mapInArrow(tidy(work), schema)


@dataclass(frozen=True)
class Model:
    prior: float  # log odds of label 1; used alone if there are no classes
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None  # inverse Cholesky factors
    log_dets: tuple[float, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.means is not None:
            d = [(((x - m) @ f.T) ** 2).sum(axis=1) + ld for m, f, ld in zip(self.means, self.factors, self.log_dets, strict=True)]
            z += (d[0] - d[1]) / 2
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))


def fit(stats: DataFrame, labels: DataFrame, label: str, features: str, usable: Column) -> Model:
    """``stats``: doc_id and features of all documents. ``usable``: which ids' labels may be learnt."""
    d = len(NAMES)
    known = labels.where(F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = stats.select("doc_id", F.col(features).alias("x")).join(known, "doc_id")
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]
    found = {int(r["y"] > 0): r for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s")).collect()}
    n = [found[k]["n"] if k in found else 0 for k in (0, 1)]
    if min(n) < 2:
        return Model(float(np.log((n[1] + 1e-9) / (n[0] + 1e-9))) if n[0] else 500.0)
    means, covs = [], []
    low = np.tril_indices(d)
    for k in (0, 1):
        s = np.array(found[k]["s"])
        mean, second = s[:d] / n[k], np.zeros((d, d))
        second[low] = s[d:] / n[k]
        second = second + second.T - np.diag(second.diagonal())
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    factors, dets = [], []
    scale = np.diag(np.maximum(pooled.diagonal(), 1e-6))
    for c in covs:
        shrunk = (1 - TO_POOLED - TO_IDENTITY) * c + TO_POOLED * pooled + TO_IDENTITY * scale
        chol = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(chol))
        dets.append(2 * float(np.log(chol.diagonal()).sum()))
    return Model(float(np.log(n[1] / n[0])), tuple(means), tuple(factors), tuple(dets))


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def scored(stats: DataFrame, model: Model, features: str, name: str) -> DataFrame:
    """``stats`` with its statistics replaced by a score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(features)
            flat = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(flat))], names=[*others, name])

    others = [c for c in stats.columns if c != features]
    return stats.mapInArrow(tidy(work), plus(stats.drop(features).schema, **{name: T.DoubleType()}))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    stats = stored(with_statistics(docs.select("doc_id", "text"), "x", keep=("doc_id",)))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    model = fit(stats, labels.select("doc_id", "quality"), "quality", "x", ~held)
    out = scored(stats, model, "x", "score")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject; columns as they were."""
    x, s = free(docs, "x"), free(docs, "score")
    full = stored(with_statistics(docs, x))  # with its texts, so that statistics are computed once
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    model = fit(full.select("doc_id", x), labels.select("doc_id", "quality"), "quality", x, ~held)
    return scored(full, model, x, s).where(F.col(s) >= THRESHOLD).drop(s)
