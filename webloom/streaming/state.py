"""Keyed state over streams: visited sets, backoff counters, tries and page states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.backoff import BASE_MS, MAX_MS
from ..operators.trie import THRESHOLD, Trie


def unique(stream: DataFrame, key: list[str], ts: str | None = None, watermark: str | None = None) -> DataFrame:
    """First arrival of each key; with a watermark the state is bounded by time."""
    if ts and watermark:
        return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def rate_windows(stream: DataFrame, ts: str, seconds: int, allowed: int, watermark: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark(ts, watermark).groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - allowed).alias("over"))


def _kind(minutes: int) -> str:
    """No timeout for 0 minutes: a bounded run would otherwise wait for timeouts for ever."""
    return GroupStateTimeout.ProcessingTimeTimeout if minutes else GroupStateTimeout.NoTimeout


def _timeout(state: GroupState, minutes: int) -> None:
    if minutes:
        state.setTimeoutDuration(minutes * 60_000)


def backoff(stream: DataFrame, host: str, seq: str, throttled: str, idle_minutes: int = 60) -> DataFrame:
    """(host, seq, consecutive, delay_ms) for each event; a host's counter goes after ``idle_minutes``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        counts = []
        for t in rows["throttled"]:
            n = n + 1 if t else max(0, n - 1)
            counts.append(n)
        state.update((n,))
        _timeout(state, idle_minutes)
        delays = [min(BASE_MS * 2 ** min(c - 1, 10), MAX_MS) if c > 0 else None for c in counts]
        yield pd.DataFrame({"host": key[0], "seq": rows["seq"].to_numpy(), "consecutive": counts, "delay_ms": pd.array(delays, "Int64")})

    rows = stream.select(F.col(host).cast("string").alias("host"), F.col(seq).cast("bigint").alias("seq"), F.col(throttled).alias("throttled"))
    return rows.groupBy("host").applyInPandasWithState(step, "host string, seq bigint, consecutive int, delay_ms bigint", "n int", "append", _kind(idle_minutes))


def _dump(node) -> list | dict:
    return {"*": _dump(node[0])} if isinstance(node, list) else {"c": {k: _dump(v) for k, v in node.items()}}


def _load(x: dict):
    return [_load(x["*"])] if "*" in x else {k: _load(v) for k, v in x["c"].items()}


def trie(stream: DataFrame, host: str, seq: str, segments: str, threshold: int = THRESHOLD, idle_minutes: int = 24 * 60) -> DataFrame:
    """(host, seq, segments) through each host's trie; its size is bounded by the threshold per position."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t = Trie(threshold)
        if state.exists:
            t.root = _load(json.loads(state.get[0]))
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = [t.walk(list(s)) for s in rows["segments"]]
        state.update((json.dumps(_dump(t.root)),))
        _timeout(state, idle_minutes)
        yield pd.DataFrame({"host": key[0], "seq": rows["seq"].to_numpy(), "segments": out})

    rows = stream.select(F.col(host).alias("host"), F.col(seq).cast("bigint").alias("seq"), F.col(segments).alias("segments"))
    return rows.groupBy("host").applyInPandasWithState(step, "host string, seq bigint, segments array<string>", "t string", "append", _kind(idle_minutes))


def new_states(stream: DataFrame, group: str, seq: str, k: int = 2, idle_minutes: int = 24 * 60) -> DataFrame:
    """(grp, seq, accepted): a page state is new if no accepted one of its group is within ``k`` bits."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for h in rows["simhash"].astype("int64").tolist():
            new = all(((h ^ int(o)) & 0xFFFFFFFFFFFFFFFF).bit_count() > k for o in kept)
            if new:
                kept.append(h)
            out.append(new)
        state.update((kept,))
        _timeout(state, idle_minutes)
        yield pd.DataFrame({"grp": key[0], "seq": rows["seq"].to_numpy(), "accepted": out})

    rows = stream.select(F.col(group).cast("string").alias("grp"), F.col(seq).cast("bigint").alias("seq"), F.col("simhash"))
    return rows.groupBy("grp").applyInPandasWithState(step, "grp string, seq bigint, accepted boolean", "kept array<bigint>", "append", _kind(idle_minutes))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and writes it as Parquet."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
