"""Near-duplicate pages by SimHash: keyed pairs and greedy acceptance."""

from __future__ import annotations

from itertools import combinations, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import simhash as S
from ..functions.text import strip_dom
from ..storage import stored


def _counted(words: Column) -> Column:
    """Array of (w, c): how often each word stands in an array, within the row: no key crosses the network, and a task holds one row's words at a time."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda p: F.transform(p, lambda i, j: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(p, j + 1), F.size(s)) - i).alias("c"))))[0]

    # arrays of one element bind what lambdas use, so that it is computed once
    return F.transform(F.array(F.sort_array(F.filter(words, lambda w: w.isNotNull()))), runs)[0]


def native_simhash(df: DataFrame, id_col: str, words: str) -> DataFrame:
    """(id, simhash) by votes per bit, in built-in functions; ``words`` is an array column. No words give 0."""
    # one row for each word of a row, none for each bit; the votes are folded by id before the shuffle
    hashed = df.select(id_col, F.explode_outer(_counted(F.col(words))).alias("x")).select(id_col, "x.c", S.fnv1a(F.col("x.w")).alias("h"))
    votes = hashed.groupBy(id_col).agg(*[F.sum(F.col("c") * (2 * F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) - 1)).alias(f"b{b}") for b in range(64)])
    bits = F.lit(0).cast("bigint")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return votes.select(id_col, bits.alias("simhash"))


def page_state(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with the signature of its stripped page."""
    return df.withColumn("simhash", S.simhash(strip_dom(F.col(html))))


def classes(df: DataFrame, id_col: str = "id", sig: str = "simhash") -> DataFrame:
    """(simhash, rep, n): equal signatures stand together under their smallest id."""
    return df.groupBy(sig).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))


def _block_keys(k: int) -> Column:
    """Array of keys, one of which two signatures share if they differ in at most ``k`` bits; see pairs."""
    edges = [64 * i // max(1, 2 * k) for i in range(2 * k + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(some) for some in combinations(blocks, k)] if k else [(1 << 64) - 1]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.col("simhash").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for i, m in enumerate(signed)])


def pairs(reps: DataFrame, k: int = 3) -> DataFrame:
    """(a, b, distance, n_pairs) of class representatives whose signatures differ in at most ``k`` bits.

    A signature is cut into 2k blocks. Two such signatures agree in k of them at
    least, so they share one of the C(2k, k) keys of k blocks, each 32 bits: few
    signatures meet by chance, however many there are. Only distinct signatures
    are joined, so copies make no pairs of their own; ``n_pairs`` is how many pairs
    of members a pair of classes stands for.
    """
    reps = stored(reps)  # read twice below; signatures are computed once
    rows = reps.select("simhash", "rep", "n", F.explode(_block_keys(k)).alias("key"))
    x = rows.select(F.col("simhash").alias("sx"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("key").alias("kx"))
    y = rows.select(F.col("simhash").alias("sy"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("key").alias("ky"))
    met = x.join(y, (F.col("kx") == F.col("ky")) & (F.col("x") < F.col("y")) & (S.hamming(F.col("sx"), F.col("sy")) <= k))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"), S.hamming(F.col("sx"), F.col("sy")).alias("distance"), (F.col("nx") * F.col("ny")).alias("n_pairs")).distinct()


#: Cells that greedy acceptance finishes in one task for each group.
LOCAL_CELLS = 1 << 20


def _cells(first: DataFrame, k: int) -> DataFrame:
    """(grp, seq, n, cell) for distinct signatures of a group: two of them share a cell if and only if they differ in at most ``k`` bits.

    For two bits a cell is a value at most one bit away: 65 for each signature, none
    with more than 65 signatures, so the work is in proportion to the rows however
    the signatures lie. For other ``k`` each near pair is a cell of its own.
    """
    if k == 2:
        flips = [0, *(1 << b for b in range(63)), -(1 << 63)]
        return first.select("grp", "seq", "n", F.explode(F.array(*[F.col("simhash").bitwiseXOR(F.lit(m).cast("bigint")) for m in flips])).alias("cell"))
    rows = first.select("grp", "seq", "n", "simhash", F.explode(_block_keys(k)).alias("key"))
    x = rows.select("grp", F.col("seq").alias("sx"), F.col("n").alias("x"), F.col("simhash").alias("hx"), "key")
    y = rows.select(F.col("grp").alias("g"), F.col("seq").alias("sy"), F.col("n").alias("y"), F.col("simhash").alias("hy"), F.col("key").alias("k"))
    met = x.join(y, F.col("grp").eqNullSafe(F.col("g")) & (F.col("key") == F.col("k")) & (F.col("x") < F.col("y")) & (S.hamming(F.col("hx"), F.col("hy")) <= k))
    met = stored(met.select("grp", "sx", "x", "sy", "y").distinct().withColumn("cell", F.monotonically_increasing_id()))
    ends = F.array(F.struct(F.col("sx").alias("seq"), F.col("x").alias("n")), F.struct(F.col("sy").alias("seq"), F.col("y").alias("n")))
    return met.select("grp", "cell", F.explode(ends).alias("e")).select("grp", "e.seq", "e.n", "cell")


def _lost_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Signatures of a group that share a cell with an accepted one before them."""
    pdf = pdf.sort_values(["seq", "n"])
    taken: set[int] = set()
    lost = []
    for n, some in groupby(zip(pdf["n"].tolist(), pdf["cell"].tolist(), strict=True), key=itemgetter(0)):
        cells = [c for _, c in some]
        if taken.isdisjoint(cells):
            taken.update(cells)
        else:
            lost.append(n)
    return pd.DataFrame({"n": lost}, dtype="int64")


def greedy_accept(df: DataFrame, group: str, seq: str = "seq", k: int = 2) -> DataFrame:
    """(group, seq, accepted): in order, a signature is accepted if no accepted one of its group is within ``k`` bits.

    Of equal signatures only the first can be accepted. A distinct one that is the
    first of all its cells is accepted, and the others of these cells are not; this
    is repeated with what is left until it is at most LOCAL_CELLS, and then done in order.
    A null signature is near nothing; a null ``seq`` comes last.
    """
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(seq).cast("bigint").alias("seq"), "simhash")
    rows = stored(rows.withColumn("n", F.monotonically_increasing_id()))  # signatures are computed once, n tells rows apart
    at = F.struct(F.coalesce("seq", F.lit((1 << 63) - 1)).alias("seq"), "n")
    first = rows.where("simhash IS NOT NULL").groupBy("grp", "simhash").agg(F.min(at).alias("at")).select("grp", "simhash", "at.seq", "at.n")
    first = stored(first)
    left, lost, cell = _cells(first, k) if k else None, [], Window.partitionBy("grp", "cell")
    while left is not None:
        met = left.withColumn("low", F.min(F.struct("seq", "n")).over(cell)["n"]).withColumn("size", F.count(F.lit(1)).over(cell))
        met = stored(met.where("size > 1").drop("size"))  # alone in a cell is near nothing there
        if met.count() <= LOCAL_CELLS:
            lost.append(met.select("grp", "seq", "n", "cell").groupBy("grp").applyInPandas(_lost_of_group, "n bigint"))
            break
        kept = stored(met.groupBy("n").agg(F.min(F.col("n") == F.col("low")).alias("lowest")).where("lowest").select("n"))
        near = stored(met.where("n <> low").join(kept.select(F.col("n").alias("low")), "low", "left_semi").select("n").distinct())
        lost.append(near)
        left = met.drop("low").join(kept.union(near), "n", "left_anti")
    accepted = first.select("n")
    for some in lost:
        accepted = accepted.join(some, "n", "left_anti")
    accepted = rows.join(accepted.withColumn("first", F.lit(True)), "n", "left")
    return accepted.select("grp", "seq", (F.col("simhash").isNull() | F.col("first").isNotNull()).alias("accepted"))
