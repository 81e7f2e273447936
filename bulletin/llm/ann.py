"""Embedding near-dedup on a robust-pruned flat graph (operator 3).

Vectors with one label are clustered around centres taken from a bounded sample; each
belongs to the shards of its nearest centres, so shards overlap. In each shard every vector
takes its nearest ones and prunes them robustly (a neighbour goes if one already taken is
closer to it by the factor alpha). The adjacency lists of all shards are united. Every
vector then searches the united graph among the vectors of its home, the shard of its nearest
centre: greedily with a beam from the medoid and from its own node, then expanding the range while links are found. Links are
verified in double precision. What the links join is a family, however many shards it is
spread over: all its pairs are compared in blocks, so that pairs without a common shard
count too. Recall is audited on a bounded sample against all rows, and the search repeats
with a wider beam and more overlap if recall is too low; if the last try is too low as well,
all pairs of each label are compared in blocks instead.

Equal vectors are one class first, with their number, so copies cost nothing. Shards over
``max_shard`` vectors are cut again around centres of their own.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and those without a label, link with nothing; vectors of different lengths don't link; rows
that share a vec_id are one node; rows with a null vec_id link with nothing and have a null
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, tidy_group
from .components import components

COSINE = 0.93
SHARD = 1500
OVERLAP = 3
MAX_SHARD = 8192
MAX_CENTRES = 256
NEAREST, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 32
AUDIT_QUERIES = 128
LEAST_RECALL = 0.98
TRIES = 3
#: Rows of a block when all pairs of a group are compared.
BLOCK = 2048


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> unit vectors in double precision and their class keys."""
    for batch in batches:
        rows = []
        for vec_id, label, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if vec_id is None or label is None or not e or any(x is None for x in e):
                continue
            v = np.array(e, dtype=np.float64)
            if not np.isfinite(v).all() or not v.any():
                continue
            key = xxhash.xxh3_128_digest((v + 0.0).tobytes())
            v = v / np.abs(v).max()  # against overflow
            rows.append((vec_id, label, key, (v / np.sqrt(v @ v)).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["vec_id", "label", "key", "v"])


def _matrix(column: Iterable[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.float64) for b in column])


def robust_prune(x: np.ndarray, nearest: int = NEAREST, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """The adjacency list of every unit vector of a shard."""
    n = len(x)
    out = []
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        k = min(n, nearest + 1)
        close = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(sims), 1))
        for i, own in enumerate(close):
            own = own[own != at + i]
            own = own[np.argsort(-sims[i, own], kind="stable")]
            apart = 1 - sims[i, own]  # half the squared distance
            between = 1 - x[own] @ x[own].T
            alive, taken = np.ones(len(own), dtype=bool), []
            for j in range(len(own)):
                if alive[j]:
                    taken.append(own[j])
                    if len(taken) == degree:
                        break
                    alive &= alpha * alpha * between[j] > apart
            out.append(np.array(taken, dtype=np.int64))
    return out


def padded(graph: list[np.ndarray]) -> np.ndarray:
    """Adjacency lists as rows of one matrix, filled with -1."""
    out = np.full((len(graph), max(map(len, graph), default=0) or 1), -1, dtype=np.int64)
    for i, near in enumerate(graph):
        out[i, : len(near)] = near
    return out


def range_search(x: np.ndarray, graph: np.ndarray, own: int, starts: list[int], cosine: float, beam: int) -> np.ndarray:
    """Nodes within ``cosine`` of node ``own``: a greedy beam search from ``starts`` that, as
    soon as it meets nodes in range, expands all of them before it goes on."""
    q = x[own]
    new = np.unique(starts)
    seen = np.zeros(len(x) + 1, dtype=bool)
    seen[new] = seen[-1] = True  # the last stands for the filling
    frontier: list[tuple[float, int]] = []
    best: list[float] = []
    found = []
    while True:
        sims = x[new] @ q
        inside = sims >= cosine
        hot = new[inside]
        found.append(hot)
        near = ~inside if len(best) < beam else ~inside & (sims > best[0])
        for s, j in zip(sims[near].tolist(), new[near].tolist(), strict=True):
            if len(best) < beam:
                heapq.heappush(best, s)
            elif s > best[0]:
                heapq.heapreplace(best, s)
            else:
                continue
            heapq.heappush(frontier, (-s, j))
        if not len(hot):
            if not frontier or (len(best) >= beam and -frontier[0][0] < best[0]):
                break
            hot = [heapq.heappop(frontier)[1]]
        new = graph[hot].ravel()
        new = new[~seen[new]]
        if len(hot) > 1:  # one list holds no node twice
            new = np.unique(new)
        seen[new] = True
    out = np.concatenate(found)
    return out[out != own]


def _assign(shared, overlap: int):
    """Members of groups -> a row for each of their nearest centres; of a member's home, the nearest is its home."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: dict[str, np.ndarray] = shared.value
        for batch in batches:
            groups, vs, at_home = batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            rows, shards, home = [], [], []
            for i, (g, v) in enumerate(zip(groups, vs, strict=True)):
                if (c := centres.get(g)) is None:
                    rows.append(i)
                    shards.append(g)
                    home.append(at_home[i])
                    continue
                near = np.argsort(-(c @ np.frombuffer(v.as_py(), dtype=np.float64)), kind="stable")[:overlap]
                rows += [i] * len(near)
                shards += [f"{g}/{k}" for k in near.tolist()]
                home += [at_home[i]] + [False] * (len(near) - 1)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), batch.column(1).take(take), vs.take(take), pa.array(home, pa.bool_())], names=["shard", "rep", "v", "home"])

    return run


def shards_of(reps: DataFrame, scratch: Scratch, overlap: int, shard: int, max_shard: int) -> DataFrame:
    """shard, rep, v, home: overlapping shards of (label, rep, v), each of bounded size. Of a vector's shards
    one is its home. ``shard`` is the wanted size with the overlap, so that shards don't grow with it."""
    spark = reps.sparkSession
    members = reps.select(F.concat_ws(":", "label", F.length("v").cast("string")).alias("shard"), "rep", "v", F.lit(True).alias("home"))
    limit = shard
    for _ in range(8):
        sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        first = Window.partitionBy("shard").orderBy(F.xxhash64("rep", F.lit(limit)))
        wanted = F.least(F.lit(MAX_CENTRES), F.ceil(overlap * F.col("n") / shard))
        sample = members.join(sizes, "shard").filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < 8 * 1_000_000 * wanted / F.col("n"))
        chosen = sample.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= wanted).select("shard", "v").collect()
        if not chosen:
            break
        centres: dict[str, list[bytes]] = {}
        for r in chosen:
            centres.setdefault(r.shard, []).append(r.v)
        shared = spark.sparkContext.broadcast({g: _matrix(vs) for g, vs in centres.items()})
        members = scratch.keep(members.mapInArrow(_assign(shared, overlap), "shard string, rep bigint, v binary, home boolean"))
        limit = max_shard
    return members


def _build(nearest: int, degree: int, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["rep"].to_numpy()
        lists = robust_prune(_matrix(pdf["v"]), nearest, degree, alpha)
        return pd.DataFrame({"rep": ids, "near": [ids[a] for a in lists]})

    return run


def _search(cosine: float, beam: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["rep"].to_numpy(), _matrix(pdf["v"])
        order = np.argsort(ids)
        sorted_ids = ids[order]
        graph = []
        for near in pdf["near"]:
            at = np.minimum(np.searchsorted(sorted_ids, near), len(ids) - 1)
            graph.append(order[at[sorted_ids[at] == near]])
        lists, medoid = padded(graph), int(np.argmax(x @ x.mean(axis=0)))
        # verified as found: range_search compares unit vectors in double precision
        at_home = np.flatnonzero(pdf["home"].to_numpy())
        found = [range_search(x, lists, i, [medoid, i], cosine, beam) for i in at_home.tolist()]
        own, other = np.repeat(ids[at_home], [len(f) for f in found]), ids[np.concatenate(found)] if found else ids[:0]
        return pd.DataFrame({"a": np.minimum(own, other), "b": np.maximum(own, other)}).drop_duplicates()

    return run


def audit(reps: DataFrame, links: DataFrame, cosine: float, queries: int = AUDIT_QUERIES) -> float:
    """The share of a bounded sample's links, found by comparing it with all rows, that
    are in ``links``."""
    n = reps.count()
    sample = reps.filter(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_000)) < max(1, 1_000_000 * queries // max(n, 1))).select("rep", "label", "v").limit(4 * queries).toPandas()
    if not len(sample):
        return 1.0
    shared = reps.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        groups = {k: (g["rep"].to_numpy(), _matrix(g["v"])) for k, g in s.groupby(["label", s["v"].str.len()])}
        for batch in batches:
            a, b = [], []
            for rep, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (g := groups.get((label, len(v)))) is None:
                    continue
                for q in g[0][g[1] @ np.frombuffer(v, dtype=np.float64) >= cosine].tolist():
                    if q != rep:
                        a.append(min(q, rep))
                        b.append(max(q, rep))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    true = reps.select("rep", "label", "v").mapInArrow(run, "a bigint, b bigint").distinct()
    r = true.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return r.hits / r.n if r.n else 1.0


def _compare(cosine: float):
    @tidy_group
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        left, right = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
        codes = pd.factorize(pdf["family"])[0]
        own, other = codes[(pdf["block"] == lo).to_numpy()], codes[(pdf["block"] == hi).to_numpy()]
        x, y, i, j = _matrix(left["v"]), _matrix(right["v"]), left["rep"].to_numpy(), right["rep"].to_numpy()
        a, b = [i[:0]], [i[:0]]
        for at in range(0, len(x), 256):
            near = (x[at : at + 256] @ y.T >= cosine) & (own[at : at + 256, None] == other[None, :])
            p, q = np.nonzero(near)
            p, q = i[at + p], j[q]
            p, q = p[p != q], q[p != q]
            a.append(np.minimum(p, q))
            b.append(np.maximum(p, q))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def all_pairs(members: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """a, b: every link within a family of ``members`` (family, rep, v; vectors of a family
    are of one length). Large families are dealt in blocks, of which every two meet in a
    task; small ones share a task."""
    size = F.length("v").cast("string")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    total = members.count()
    some = max(1, -(-total // block))
    rows = members.join(sizes, "family").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    small = rows.filter("blocks = 1").select(F.concat_ws(":", F.lit("s"), size, F.pmod(F.xxhash64("family"), F.lit(some)).cast("string")).alias("task"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"), "family", "rep", "v")
    large = rows.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    large = large.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(F.concat_ws(":", F.lit("l"), "family").alias("task"), F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi"), "block", "family", "rep", "v")
    return small.unionByName(large).groupBy("task", "lo", "hi").applyInPandas(_compare(cosine), "a bigint, b bigint")


def completed(reps: DataFrame, links: DataFrame, tops: DataFrame, cosine: float) -> DataFrame:
    """``links`` and all others between vectors that they join, directly or not."""
    families = tops.select(F.col("node").alias("rep"), F.col("component").cast("string").alias("family"))
    big = families.groupBy("family").agg(F.count("*").alias("n")).filter("n > 2").select("family")  # two are linked
    return links.unionByName(all_pairs(reps.join(families.join(big, "family"), "rep").select("family", "rep", "v"), cosine)).distinct()


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, shard: int = SHARD, overlap: int = OVERLAP, max_shard: int = MAX_SHARD, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id,
    embedding, label)."""
    scratch = Scratch(embeddings.sparkSession, "ann")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    packed = scratch.keep(rows.mapInArrow(_pack, "vec_id bigint, label string, key binary, v binary"))
    classes = packed.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    member = packed.select("vec_id", "label", "key").join(classes, ["label", "key"]).select("vec_id", "label", "rep", "many")
    member = scratch.keep(member)
    reps = scratch.keep(packed.join(classes.select("label", F.col("rep").alias("vec_id"), "key"), ["label", "vec_id", "key"]).select(F.col("vec_id").alias("rep"), "label", "v").dropDuplicates(["rep", "label", "v"]))
    for _ in range(TRIES):
        shards = scratch.keep(shards_of(reps, scratch, overlap, shard, max_shard))
        built = shards.select("shard", "rep", "v").groupBy("shard").applyInPandas(_build(NEAREST, DEGREE, ALPHA), "rep bigint, near array<bigint>")
        graph = scratch.keep(built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        searched = shards.join(graph, "rep").groupBy("shard").applyInPandas(_search(cosine, beam), "a bigint, b bigint")
        found = scratch.keep(searched.distinct())
        tops = components(found)
        links = scratch.keep(completed(reps, found, tops, cosine))
        if audit(reps, links, cosine) >= LEAST_RECALL:
            break
        overlap, beam = overlap + 1, 2 * beam
    else:  # no try was good enough: compare everything
        whole = reps.select(F.concat_ws(":", F.length("v").cast("string"), "label").alias("family"), "rep", "v")
        links = scratch.keep(all_pairs(whole, cosine).distinct())
        tops = components(links)
    many = member.select("rep", "many").distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(many.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("many").alias("others"))
    tops = tops.withColumnRenamed("node", "rep")
    linked = member.join(others, "rep", "left").join(tops, "rep", "left")
    linked = linked.groupBy("vec_id").agg(F.sum(F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
