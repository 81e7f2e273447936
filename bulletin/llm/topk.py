"""Exact top-k search by an impact-ordered index, score at a time (operator 7).

Vectors become integers and lie in index blocks. In a block every component, less the least
of its dimension, is cut in its binary digits: a posting segment holds the vectors that have
one digit set in one dimension, as a bitmap, and the digit's place is its quantised impact.
Segments are processed by descending impact for a block of queries at a time and add to the
accumulators of their vectors. What all segments still to come can add or take away is known
exactly. The search stops only on proof, when all but a few vectors can no longer reach the
k-th best score; the possible members are rescored exactly from their vectors.

Queries, a stated set, meet all rows block by block: the unit of work is one block of queries
and one index block. Pairs of block numbers are dealt by salt, their payloads join them by
block, so no key gathers all blocks. Each unit gives k rows a query; the k best are then
taken by a window over a query's rows.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; vectors of other lengths than the query's aren't its candidates; rows with the
query's vec_id are left out, as are rows without one; repeated candidates each count;
of equal scores the smaller vec_id comes first; an empty table gives no rows; other
columns are ignored. Components are under 2**20 in size after scaling, so that sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

K = 20
SCALE = 64
EVERY = 20
INDEX_BLOCK = 8_192
QUERY_BLOCK = 128
#: So many possible members are rescored without looking further.
RESCORE = 256
#: Shares of the query blocks that meet index blocks in tasks of their own.
SALTS = 64


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: array<bigint> of the vectors that take part."""
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("embedding").isNotNull()).filter(F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("v"))


def _blocks(size: int):
    """(vec_id, v) -> packed blocks of at most ``size`` vectors of one length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}
        base, made = TaskContext.get().partitionId() << 32, 0

        def out(dims: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(dims)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([base | made]), pa.array([dims], pa.int32()), pa.array([np.array([r[0] for r in rows], dtype=np.int64).tobytes()]), pa.array([np.array([r[1] for r in rows], dtype=np.int64).tobytes()])], names=["block", "dims", "ids", "vectors"])

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((vec_id, v))
                if len(held[len(v)]) >= size:
                    yield out(len(v))
        for dims in list(held):
            yield out(dims)

    return run


class ImpactIndex:
    """Bitmaps of one block by digit, the highest first."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.low = vectors.min(axis=0)
        self.above = vectors - self.low
        self.digits = int(self.above.max()).bit_length()
        self.kind = np.float32 if int(np.abs(vectors).max()) ** 2 * vectors.shape[1] < 1 << 22 else np.float64

    def segments(self, digit: int) -> np.ndarray:
        """Of every dimension, the vectors with this digit set."""
        return (self.above >> digit & 1).astype(self.kind)

    def search(self, queries: np.ndarray, k: int, own: list[np.ndarray], rescore: int = RESCORE) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and exact scores of all vectors that may be among the
        k best, its ``own`` apart."""
        n = len(self.vectors)
        weights = queries.astype(self.kind)
        acc = np.repeat((queries @ self.low).astype(self.kind)[:, None], n, axis=1)
        for i, places in enumerate(own):
            acc[i, places] = -np.inf
        gain = np.where(queries > 0, queries, 0).sum(axis=1).astype(self.kind)
        loss = np.where(queries < 0, queries, 0).sum(axis=1).astype(self.kind)
        possible = None
        for digit in range(self.digits - 1, -1, -1):
            acc += weights @ self.segments(digit).T * self.kind(1 << digit)
            rest = (1 << digit) - 1  # the most that a component can still grow by
            if n > k and (digit <= 2 or rest == 0):
                bar = np.partition(acc, n - k, axis=1)[:, n - k]
                can = acc + (gain * rest)[:, None] >= (bar + loss * rest)[:, None]
                if not rest or can.sum(axis=1).max() <= max(rescore, 4 * k):
                    possible = can
                    break
        if possible is None:
            possible = acc > -np.inf
        out = []
        for i, query in enumerate(queries):
            places = np.flatnonzero(possible[i] & (acc[i] > -np.inf))
            out.append((places, self.vectors[places] @ query))
        return out


def _unit(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (dims, _), rows in pdf.groupby(["dims", "block"]):
            ids = np.frombuffer(rows["ids"].iloc[0], dtype=np.int64)
            index = ImpactIndex(np.frombuffer(rows["vectors"].iloc[0], dtype=np.int64).reshape(-1, dims))
            order = np.argsort(ids, kind="stable")
            sorted_ids = ids[order]
            for q_block, q_ids, q_vectors in zip(rows["q_block"], rows["q_ids"], rows["q_vectors"], strict=True):
                queries = np.frombuffer(q_vectors, dtype=np.int64).reshape(-1, dims)
                asked = np.frombuffer(q_ids, dtype=np.int64).tolist()
                own = [order[np.searchsorted(sorted_ids, q, "left") : np.searchsorted(sorted_ids, q, "right")] for q in asked]
                for i, (q_id, (places, scores)) in enumerate(zip(asked, index.search(queries, k, own), strict=True)):
                    best = np.lexsort((ids[places], -scores))[:k]
                    out.append(pd.DataFrame({"q_block": q_block, "q_row": i, "query_id": q_id, "vec_id": ids[places[best]], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q_block", "q_row", "query_id", "vec_id", "score")})

    return run


def top_k(embeddings: DataFrame, queries: DataFrame | None = None, k: int = K, every: int = EVERY, scale: int = SCALE, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each query (vec_id divisible by
    ``every``, or all rows of ``queries``)."""
    scratch = Scratch(embeddings.sparkSession, "topk")
    packed = "block bigint, dims int, ids binary, vectors binary"
    rows = integers(embeddings, scale)
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else integers(queries, scale)
    index = scratch.keep(rows.coalesce(max(1, rows.rdd.getNumPartitions() // 4)).mapInArrow(_blocks(index_block), packed))
    asked = scratch.keep(asked.coalesce(max(1, asked.rdd.getNumPartitions() // 4)).mapInArrow(_blocks(query_block), packed))
    asked = asked.select(F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # pairs of block numbers are dealt by salt, payloads then meet them by block
    salt = F.pmod(F.xxhash64("q_block"), F.lit(SALTS))
    ids = index.select("block", "dims", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    pairs = ids.join(asked.select("q_block", "dims", salt.alias("salt")).hint("shuffle_hash"), ["dims", "salt"]).select("block", "q_block")
    units = pairs.join(index.hint("shuffle_hash"), "block").join(asked.drop("dims").hint("shuffle_hash"), "q_block")
    found = units.groupBy("block", "q_block").applyInPandas(_unit(k), "q_block bigint, q_row bigint, query_id bigint, vec_id bigint, score bigint")
    found = scratch.keep(found)
    best = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
