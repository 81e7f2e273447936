"""Connected components of a link table, for the operators that group by similarity.

Alternating large-star and small-star rounds: every round hangs each node's neighbours on
the least node known around it, until nothing changes, in a logarithmic number of rounds.
Each partition first reduces its links to a spanning forest, so a dense group shrinks to
its nodes before any shuffle. Least neighbours are found by a minimum with partial sums and
joined back, so no neighbour list is ever collected, and Spark may split a hot node's join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, tidy

_PAIR = "a bigint, b bigint"


@tidy
def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def out() -> pa.RecordBatch:
        nodes = list(root)
        tops = [find(x) for x in nodes]
        rows = [(x, t) for x, t in zip(nodes, tops, strict=True) if x != t]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 1_000_000:
            yield out()
            root.clear()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (a, b)."""
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    stars = scratch.keep(pairs.mapInArrow(_forest, _PAIR).distinct())  # a > b
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        small = scratch.keep(small.distinct())
        changed = small.join(stars, ["a", "b"], "left_anti").limit(1).count() or stars.join(small, ["a", "b"], "left_anti").limit(1).count()
        scratch.drop(large)
        scratch.drop(stars)
        stars = small
        if not changed:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
