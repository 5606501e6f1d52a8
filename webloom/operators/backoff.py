"""Per-host backoff and request-rate analysis over an ordered event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_MS, MAX_MS = 1000, 30000


def schedule(df: DataFrame, host: str, order: list[str], throttled: Column) -> DataFrame:
    """``df`` with ``consecutive`` (throttles up, successes down, never below 0) and ``delay_ms`` (null for none; no jitter).

    A sum that may not fall below zero is the plain running sum less its running minimum (if negative).
    """
    w = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__s", F.sum(F.when(throttled, 1).otherwise(-1)).over(w))
    n = F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))
    df = df.withColumn("consecutive", n).drop("__s")
    # beyond 2 ** 5 the cap holds, so the exponent is bounded before it is used
    delay = F.least(F.lit(MAX_MS), F.lit(BASE_MS) * F.pow(F.lit(2.0), F.least(F.col("consecutive") - 1, F.lit(10)))).cast("bigint")
    return df.withColumn("delay_ms", F.when(F.col("consecutive") > 0, delay))


def rate_windows(df: DataFrame, ts: str, seconds: int, allowed: int) -> DataFrame:
    """(window_start, n, over): requests per window and how many exceed what is allowed."""
    start = F.window(F.col(ts), f"{seconds} seconds")["start"].alias("window_start")
    return df.groupBy(start).agg(F.count(F.lit(1)).alias("n")).withColumn("over", F.greatest(F.lit(0), F.col("n") - allowed))
