"""Adaptive path tries: positions of a path with too many different values become ``{param}``.

Set mode sees all rows at once and is independent of order: below each
normalised prefix of a host, a position with more than ``threshold`` different
segments is a parameter for all rows. Exact mode replays arrival order per host:
values seen before a position is promoted stay as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..storage import stored

PARAM = "{param}"
THRESHOLD = 10


def _folded(df: DataFrame, wide: DataFrame, i: int) -> DataFrame:
    """Position i of __s as a parameter below the hosts and prefixes of ``wide`` (__wh, __wp)."""
    below = (F.col("__h") == F.col("__wh")) & (_prefix(i) == F.col("__wp")) & (F.size("__s") > i)
    rest = F.slice("__s", i + 2, F.greatest(F.size("__s") - (i + 1), F.lit(0)))
    done = F.when(F.col("__wh").isNotNull(), F.concat(F.slice("__s", 1, i), F.array(F.lit(PARAM)), rest)).otherwise(F.col("__s"))
    return df.join(wide, below, "left").withColumn("__s", done).drop("__wh", "__wp")


def _prefix(i: int) -> Column:
    return F.array_join(F.slice("__s", 1, i), "/") if i else F.lit("")


def with_set_mode(df: DataFrame, url: str, name: str, threshold: int = THRESHOLD) -> DataFrame:
    """``df`` with the fingerprint under which parameters are folded, in column ``name``.

    Children are counted over the distinct paths of each host, which are written
    after each position that has wide ones, so that scans grow with the depth and
    not faster; ``df`` is read once for them and once for the result, and meets only
    the positions that are wide. Positions are folded down to the last that more than
    ``threshold`` paths of one host reach; no later one can be wide.
    """
    u = F.col(url)
    df = df.withColumn("__h", urls.host(u)).withColumn("__s", urls.segments(u))
    paths = stored(df.select("__h", "__s").distinct())
    sizes = paths.groupBy("__h", F.size("__s").alias("__k")).agg(F.count(F.lit(1)).alias("__c"))
    reach = sizes.withColumn("__c", F.sum("__c").over(Window.partitionBy("__h").orderBy(F.desc("__k"))))
    deepest = reach.where(F.col("__c") > threshold).agg(F.max("__k")).first()[0] or 0
    for i in range(deepest):
        wide = paths.where(F.size("__s") > i).groupBy(F.col("__h").alias("__wh"), _prefix(i).alias("__wp")).agg(F.count_distinct(F.get("__s", F.lit(i))).alias("__n"))
        wide = stored(wide.where(F.col("__n") > threshold).drop("__n"))
        if wide.isEmpty():
            continue
        paths = stored(_folded(paths, wide, i).distinct())
        df = _folded(df, wide, i)
    return df.withColumn(name, urls.fingerprint(u, F.col("__s"))).drop("__h", "__s")


class Trie:
    """The trie of one host. A node is a dict of children, or a list with the one child of a promoted position."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold, self.root = threshold or THRESHOLD, {}

    def walk(self, segments: list[str]) -> list[str]:
        out, node, hold = [], self.root, None
        for s in segments:
            if isinstance(node, dict) and s not in node and len(node) >= self.threshold:
                promoted = [{}]
                if hold is None:
                    self.root = promoted
                else:
                    hold[0][hold[1]] = promoted
                node = promoted
            if isinstance(node, list):
                out.append(PARAM)
                hold, node = (node, 0), node[0]
            else:
                out.append(s)
                hold, node = (node, s), node.setdefault(s, {})
        return out


def exact_mode(df: DataFrame, url: str = "url", seq: str = "seq", threshold: int = THRESHOLD) -> DataFrame:
    """(seq, host, segments): rows of each host in order of ``seq``, through the host's trie."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Trie(threshold)
        pdf = pdf.sort_values("seq", kind="stable")
        pdf["segments"] = [t.walk(list(s)) for s in pdf["segments"]]
        return pdf

    rows = df.select(F.col(seq).cast("bigint").alias("seq"), urls.host(F.col(url)).alias("host"), urls.segments(F.col(url)).alias("segments"))
    return rows.groupBy("host").applyInPandas(work, "seq bigint, host string, segments array<string>")
