"""Visit and like counters as ordered folds: W1, A14, A15."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

THROTTLE_SECONDS = 180


#: A key's times are looked at by spans of so many limits, so that a busy key is many tasks' work.
SPAN = 4096


def runs(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """The keys, t (microseconds), first (whether it begins a run) and run of each event. A run ends where
    ``seconds`` pass without an event, and the event after that counts whatever came before: so
    runs don't depend on each other."""
    limit = seconds * 1_000_000
    rows = events.filter(F.col(ts).isNotNull()).select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).withColumn("span", F.floor(F.col("t") / (SPAN * max(limit, 1))))
    inside, across = Window.partitionBy(*keys, "span").orderBy("t"), Window.partitionBy(*keys).orderBy("span")

    def joined(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
        same = reduce(lambda x, k: x & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")), [*keys, "span"], F.lit(True))
        return left.alias("l").join(right.alias("r"), same).select(*(F.col(f"l.`{c}`") for c in left.columns), F.col(f"r.{value}"))

    ends = rows.groupBy(*keys, "span").agg(F.max("t").alias("end")).withColumn("prior", F.lag("end").over(across))
    rows = joined(rows, ends, "prior").withColumn("gap", F.col("t") - F.coalesce(F.lag("t").over(inside), "prior"))
    rows = rows.withColumn("first", F.coalesce(F.col("gap") >= limit, F.lit(True))).drop("gap", "prior")
    rows = rows.withColumn("own", F.last(F.when(F.col("first"), F.col("t")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    starts = rows.groupBy(*keys, "span").agg(F.max("own").alias("start")).withColumn("carried", F.last("start", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    return joined(rows, starts, "carried").select(*keys, "t", "first", F.coalesce("own", "carried").alias("run"))


def accepted(events: DataFrame, keys: list[str], ts: str = "ts", seconds: int = THROTTLE_SECONDS) -> DataFrame:
    """(keys, ts) of the events that count: the first of each key and every one that
    comes at least ``seconds`` after the last that counted. A lag is no help, since what was
    rejected doesn't matter: each run is folded in the order of time, and of a run no more
    than the last time that counted is held. Events without a time don't count; no two at one
    time count, unless ``seconds`` is 0."""
    limit = seconds * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0
        for pdf in batches:
            t, first, took = pdf["t"].to_numpy(), pdf["first"].to_numpy(), []
            for start, stop in pairwise(np.unique((0, *np.flatnonzero(first), len(pdf))).tolist()):
                at = start if first[start] else start + int(np.searchsorted(t[start:stop], last + limit))
                while at < stop:
                    took.append(at)
                    last = int(t[at])
                    at = max(at + 1, start + int(np.searchsorted(t[start:stop], last + limit)))
            yield pdf.iloc[took].drop(columns="first")

    found = runs(events, keys, ts, seconds).repartition(*keys, "run").sortWithinPartitions(*keys, "run", "t", F.desc("first"))
    found = found.select(*keys, "t", "first")
    schema = T.StructType([f for f in found.schema if f.name != "first"])
    return found.mapInPandas(fold, schema).select(*keys, F.timestamp_micros("t").cast("timestamp_ntz").alias(ts))


def per_day(visits: DataFrame, ts: str = "ts") -> DataFrame:
    """Accepted visits of each day."""
    return visits.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count("*").alias("n"))


def likes(events: DataFrame, key: str, delta: str, order: list[str]) -> DataFrame:
    """The likes of each key, never below 0 after any event. With partial sums p the
    floored walk ends at p_n - min(0, p_1..p_n), so it is two windows, not a loop."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = events.withColumn("__p", F.sum(delta).over(w))
    return walk.groupBy(key).agg((F.sum(delta) - F.least(F.lit(0), F.min("__p"))).cast("bigint").alias("likes"))
