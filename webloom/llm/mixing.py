"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document has an exponential key, -ln(u) / w: u is a uniform number from
its id, w its quality weight. In order of that key, documents of a source are a
weighted sample without replacement, whatever the budget. A source takes whole
epochs while they fit its target, then documents in key order until the rest of
its budget is used up; the document on the border gives only as many words as
are left (or, with ``split_border=False``, all or none, whichever is nearer).

Sources are in code-point order, null last; their weights repeat. They share
``share`` times all words, no source more than ``cap`` times its own, and what
a full source cannot take goes to the others by weight. In closed form: a source
gets the lesser of its cap and weight x level. Taking sources by cap / weight,
the level is the largest value of (words not yet given) / (weights not yet
served).

No source is ever one task: keys fall into cells by the logarithm of the key,
cells are counted, and between the counts of its cell a key finds its quantile, so
whatever the weights every bucket of quantiles has about ``BUCKET_ROWS`` documents.
Prefix sums within a bucket are added to those of the buckets before it. Sources
are put in order in parts too, so that they may be as many as hosts.

Null texts have no words and nothing taken. Null ids, repeated rows and equal
keys are ordered by id and a hash of the text; rows alike in both are
interchangeable. Rows of one id (and all rows without one) have one key, so within
a source they are one bucket. Columns with names used here do no harm. An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, quoted, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
BUCKET_ROWS = 4_000
#: Cells of keys for each factor of two.
CELLS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """Near 1 where words have about six characters with their space, down to 0.25 far from it."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.25), F.lit(1.0) / (F.lit(1.0) + F.abs(F.coalesce(mean, F.lit(0.0)) - F.lit(6.0)) / F.lit(4.0)))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    digest = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary")), 1, 12)
    u = (F.conv(digest, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df``, stored, with the sums over the rows that come before in a total order.

    Rows are dealt out by ranges of the order; within a part a window adds them up, and the
    sums of whole parts, of which there are as many as shuffle partitions, are added before.
    """
    part, at, keys = free(df, "part"), free(df, "at"), [free(df, f"key{i}") for i in range(len(order))]
    dealt = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)), *(v.alias(free(df, "of_" + n)) for n, v in sums.items()))
    placed = stored(dealt.repartitionByRange(*(F.col(k).asc_nulls_last() for k in keys)).withColumn(part, F.spark_partition_id()))
    own = {n: F.col(free(df, "of_" + n)) for n in sums}
    ahead = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col(part).alias(at)).agg(*(F.sum(v).alias("all_" + n) for n, v in own.items()))
    totals = totals.select(at, *(F.coalesce(F.sum("all_" + n).over(ahead), F.lit(0)).alias("before_" + n) for n in sums))
    within = Window.partitionBy(part).orderBy(*(F.col(k).asc_nulls_last() for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(totals), F.col(part) == F.col(at))  # one row a part
    return out.select(*(F.col(quoted(c)) for c in df.columns), *((F.col("before_" + n) + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(n) for n, v in own.items()))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``totals`` (source, source_size, n_docs; one row a source) with the column ``target``."""
    df = _running(totals, [F.col("source")], {"o": F.lit(1).cast("bigint")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("o") % len(weights)).cast("int") + 1)
    df = df.select("*", weight.alias("w")).select("*", (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    df = stored(_running(df, [F.col("most") / F.col("w"), F.col("o")], {"full": F.col("most"), "served": F.col("w")}))
    words, weighed = df.agg(F.sum("source_size"), F.sum("w")).first()
    if words is None:
        return df.select("source", "source_size", "n_docs", F.lit(0.0).alias("target"))
    level = (F.lit(float(words)) * F.lit(float(share)) - F.col("full")) / (F.lit(float(weighed)) - F.col("served"))
    most = df.agg(F.max(level)).first()[0]
    return df.select("source", "source_size", "n_docs", F.least(F.col("most"), F.lit(float(most)) * F.col("w")).alias("target"))


def bucketed(df: DataFrame, source: str, key: str, bucket: str) -> DataFrame:
    """``df`` with a bucket of about BUCKET_ROWS rows of a source, rising with the key: where it stands among its source's, from the counts of cells."""
    src, place = F.col(quoted(source)), F.log2(F.greatest(F.col(quoted(key)), F.lit(1e-300))) * CELLS
    at, own, found, n, ahead = (free(df, "mix_" + x) for x in ("cell", "cell_source", "cell_at", "cell_n", "cell_ahead"))
    filled = df.groupBy(src.alias(own), F.floor(place).alias(found)).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(own).orderBy(found).rowsBetween(Window.unboundedPreceding, -1))
    cells = stored(filled.withColumn(ahead, F.coalesce(before, F.lit(0))))
    dealt = df.withColumn(at, F.floor(place)).join(cells, src.eqNullSafe(F.col(own)) & (F.col(at) == F.col(found)))
    rank = F.col(ahead) + F.least(F.col(n) - 1, F.floor((place - F.col(at)) * F.col(n)))
    return dealt.withColumn(bucket, F.floor(rank / BUCKET_ROWS)).drop(at, own, found, n, ahead)


def taken(df: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", key: str = "key", tie: str = "tie", split_border: bool = True) -> DataFrame:
    """``df`` with the columns source_size, target and taken.

    ``df`` must give the same rows each time it is read; ``size``, ``key`` and
    ``tie`` are columns of it.
    """
    names = {n: free(df, "mix_" + n) for n in ("source", "source_size", "n_docs", "target", "bucket", "offset", "before")}
    c = {n: F.col(quoted(x)) for n, x in names.items()}
    src, col = F.col(quoted(source)), lambda n: F.col(quoted(n))
    totals = df.groupBy(src.alias("source")).agg(F.sum(col(size)).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = stored(targets(totals)).select(*(F.col(n).alias(names[n]) for n in ("source", "source_size", "n_docs", "target")))
    dealt = bucketed(df, source, key, names["bucket"]).join(goals, src.eqNullSafe(c["source"]))
    sums = dealt.groupBy(c["source"], c["bucket"]).agg(F.sum(col(size)).alias(names["before"]))
    earlier = Window.partitionBy(c["source"]).orderBy(c["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    at, bk = free(df, "mix_at"), free(df, "mix_bk")
    offsets = sums.select(c["source"].alias(at), c["bucket"].alias(bk), F.coalesce(F.sum(c["before"]).over(earlier), F.lit(0)).alias(names["offset"]))
    dealt = dealt.join(offsets, c["source"].eqNullSafe(col(at)) & (c["bucket"] == col(bk)))
    within = Window.partitionBy(c["source"], c["bucket"]).orderBy(col(key), col(doc_id), col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    before = (c["offset"] + F.coalesce(F.sum(col(size)).over(within), F.lit(0))).alias(names["before"])
    epochs = F.when(c["source_size"] > 0, F.floor(c["target"] / c["source_size"])).otherwise(F.lit(0))
    rest = F.floor(c["target"] + F.lit(0.5)) - epochs * c["source_size"]
    part = F.greatest(F.lit(0), F.least(col(size), rest - c["before"]))
    if not split_border:
        part = F.when(2 * part >= col(size), col(size)).otherwise(F.lit(0))
    total = (epochs * col(size) + part).cast("bigint")
    return dealt.select("*", before).select(*(F.col(quoted(n)) for n in df.columns), c["source_size"].alias(free(df, "source_size")), c["target"].alias(free(df, "target")), total.alias(free(df, "taken")))


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with size, key and tie under free names; returned with those names in ``.mix_names``."""
    size, key, tie = free(docs, "size"), free(docs, "key"), free(docs, "tie")
    df = docs.withColumn(size, n_words(F.col("text")))
    df = df.withColumn(key, sampling_key(F.col("doc_id"), quality_weight(F.col("text"), F.col(quoted(size))), seed))
    return df.withColumn(tie, F.xxhash64(F.col("text")))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    slim = stored(keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    return taken(slim).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as the mix takes it whole; columns as they were.

    Only ids, sizes and keys are sorted. What a source gives beyond its whole
    epochs ends at one document in key order, so documents are compared with
    that border and texts are not shuffled. Rows alike in key, id and text go
    together.
    """
    slim = stored(keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    first = -(1 << 63)
    place = lambda i, k, t: F.struct(k.alias("k"), F.coalesce(i.cast("bigint"), F.lit(first)).alias("i"), t.alias("t"))
    found = taken(slim, split_border=False)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    chosen = F.when(F.col("taken") > epochs * F.col("size"), place(F.col("doc_id"), F.col("key"), F.col("tie")))
    src, times, border = (free(docs, n) for n in ("mix_source", "mix_times", "mix_border"))
    goals = stored(found.groupBy(F.col("source").alias(src)).agg(F.max(epochs).alias(times), F.max(chosen).alias(border)))
    size, key, tie = (free(docs, n) for n in ("size", "key", "tie"))
    col = lambda n: F.col(quoted(n))
    df = keyed(docs, seed).join(goals, F.col("source").eqNullSafe(col(src)))
    more = F.coalesce(place(F.col("doc_id"), col(key), col(tie)) <= col(border), F.lit(False)).cast("int")
    count = F.when(col(size) > 0, col(times) + more).otherwise(F.lit(0))
    once = free(df, "mix_copy")
    repeated = df.withColumn(once, F.explode(F.array_repeat(F.lit(1), count)))
    return repeated.select(*(col(n) for n in docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / greatest(0.25, 1.0 / (1.0 + abs(coalesce(length(text)::DOUBLE / greatest(size, 1), 0.0) - 6.0) / 4.0)) AS key
  FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), o AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS o FROM s
), w AS (SELECT *, [3.0, 1.0, 2.0][(o % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM o
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS l
  FROM w WINDOW r AS (ORDER BY most / w, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, least(most, max(l) OVER () * w) AS target FROM l
), p AS (
  SELECT k.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
