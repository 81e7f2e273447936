"""ST1, ST2: the counters on a stream, with keyed state that expires.

The order of arrival counts, as on a server: an event older than the last one accepted of
its key is compared with that and rejected. Within a micro-batch events are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.counters import THROTTLE_SECONDS


def accept(events: DataFrame, key: str, ts: str = "ts", seconds: int = THROTTLE_SECONDS, keep_ms: int | None = None) -> DataFrame:
    """ST1: (key, ts) of the events that count. A key's state is one time; it goes when the
    key has been silent for ``keep_ms``, if that is given. Such a query runs a batch at each
    trigger, with or without data, so it needs a trigger that goes on."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, kept = state.get[0] if state.exists else None, []
        for t in sorted(t for pdf in batches for t in pdf["t"].dropna().tolist()):
            if last is None or t - last >= seconds * 1_000_000:
                last = t
                kept.append(t)
        if last is not None:
            state.update((last,))
            if keep_ms is not None:
                state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"key": [k[0]] * len(kept), "t": kept})

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    out = rows.groupBy("key").applyInPandasWithState(fold, "key string, t bigint", "last bigint", "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return out.select("key", F.timestamp_micros("t").alias(ts))


def likes(events: DataFrame, key: str, delta: str, order: str) -> DataFrame:
    """ST2: the likes of each key after each micro-batch, never below 0."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for _, d in sorted((o, d) for pdf in batches for o, d in zip(pdf["o"].tolist(), pdf["d"].tolist(), strict=True)):
            n = max(0, n + d)
        state.update((n,))
        yield pd.DataFrame({"key": [k[0]], "likes": [n]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(delta).cast("bigint").alias("d"), F.col(order).cast("bigint").alias("o"))
    return rows.groupBy("key").applyInPandasWithState(fold, "key string, likes bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)
