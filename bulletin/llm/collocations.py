"""Phrase collocation mining over word-id suffix arrays (operator 12).

Texts are cut into shards of words. A shard is written once: its distinct words, their
counts and the text as word ids, 0 between pieces. Whatever follows reads shards, not texts:

1. Word counts of all shards, merged by (language, word), give the frequent words.
2. Each shard, broken at all other words, is put in suffix order at depth 2; LCP intervals
   count its pairs, merged by a 40-bit hash. A hash that comes under the least count holds
   nothing frequent, so the others are a superset of the frequent pairs. Triples, broken at
   all other pairs, are counted the same way.
3. Each shard, broken wherever a pair or a triple isn't among them, is put in suffix order by
   prefix doubling, to the longest phrase; its LCP intervals give the counts of its phrases of
   each length, merged by (language, phrase). Every part of a frequent phrase is frequent, so
   nothing frequent is lost, and all counts are exact whatever the hashes do.

What is frequent goes to the tasks as a bitmap of fixed size over hashes (`BITS`): its size
doesn't grow with the corpus. A bit shared by a rare word costs time, not exactness.

Scores, cuts and the removal of phrases that a longer one explains are joins by
(language, phrase). Arithmetic is on decimals of 38 digits.

Keys and phrases are shuffled as blocks, one a shard or some and a range of hashes; a range is
one of as many as there are shuffle partitions, so it is as large as one of them.

Memory: a task holds one shard (`SHARD` words) and one Arrow batch, `PENDING` keys, or a range. Besides, Spark holds a batch
sent to Python twice outside its heap, and what a reader takes at once on it; so word ids are compressed before Spark sees
them, a shard is a row group of its own, and blocks go out in parts. A piece longer than a shard
goes on in the next, which repeats its last words, and what stands in them is counted
down by one there. Recovery: shards and counts are tables in the shared scratch folder.

Defined cases: a null text is empty, a null language is ``und``, together with documents
that are labelled so; repeated rows count as often as they occur; ties rank by the order
given; an empty table, or one without a frequent phrase, gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from .common import Scratch, tidy, trim

LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
UNKNOWN = "und"
#: Words in a shard, and bytes of text that are cut into words at a time.
SHARD, BLOCK = 1 << 19, 1 << 22
#: Bits of a bitmap of what is frequent, as a power of two: 4 MB.
BITS = 25
#: Bits of the hashes by which pairs and triples are merged.
KEY = 40
#: Bits that a key leaves in a number of 64.
_ROOM = np.uint64(64 - KEY)
#: Keys that a task gathers over shards before it gives them out.
PENDING = 1 << 21
#: What parts pieces becomes a line feed, tabs become blanks, A-Z become small.
_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(10 if b in _CUTS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Batches in which a task's blocks go out.
STEPS = 16
#: How shards are written: a row group each, so that writers and readers hold one at a time.
ALONE = {"parquet.block.row.count.limit": "1"}

_SHARDS = pa.schema([("lang", pa.string()), ("overlap", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("n", pa.int32()), ("ids", pa.binary())])
_SHARDS_DDL = "lang string, overlap int, words array<string>, counts array<bigint>, n int, ids binary"


class Shard:
    """Collects the texts of one language until there are enough words."""

    def __init__(self, lang: str, size: int, longest: int):
        self.lang, self.size, self.keep = lang, size, longest - 1
        self.start([])

    def start(self, words: list[bytes]) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[b"\n"]  # the end of a piece is 0
        self.parts, self.n, self.overlap = [], 0, len(words)
        self.take(words)
        self.n = 0

    def take(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def add(self, text: bytes) -> Iterator[dict]:
        """Take a text up; gives the shards that it fills."""
        text, done = text.translate(_TABLE), 0
        while done < len(text):
            stop = min((x for x in (text.find(b" ", done + BLOCK), text.find(b"\n", done + BLOCK)) if x >= 0), default=len(text))
            words = [w for w in text[done:stop].replace(b"\n", b" \n ").split(b" ") if w]
            for at in range(0, len(words), self.size):
                self.take(words[at : at + self.size])
                if self.n >= self.size:
                    yield from self.flush()
            done = stop
        self.parts.append(np.zeros(1, np.int32))

    def flush(self) -> Iterator[dict]:
        if not self.n:
            return
        ids = np.concatenate(self.parts)
        words = list(self.number)[1:]
        often = np.bincount(ids, minlength=len(words) + 1)[1:]
        counts = often - np.bincount(ids[: self.overlap], minlength=len(words) + 1)[1:]
        by = np.argsort(-often, kind="stable")  # frequent words have small numbers, whose higher bytes compress away
        renumbered = np.empty(len(words) + 1, np.int32)
        renumbered[0], renumbered[by + 1] = 0, np.arange(1, len(words) + 1)
        planes = renumbered[ids].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
        yield {"lang": self.lang, "overlap": self.overlap, "words": [words[k] for k in by.tolist()], "counts": counts[by], "n": len(ids), "ids": pa.compress(planes, "zstd", asbytes=True)}
        ends = np.flatnonzero(ids == 0)
        piece = ids[ends[-1] + 1 :] if len(ends) else ids  # goes on in the next shard
        self.start([words[i - 1] for i in piece[len(piece) - min(self.keep, len(piece)) :].tolist()])


def shards(docs: DataFrame, size: int = SHARD, longest: int = LONGEST) -> DataFrame:
    """The shards of ``docs`` (text, lang): lang, overlap (words at the beginning that stand
    in the shard before, too), words (the most frequent first), counts, n and ids (so many int32, by byte planes, compressed; 0 ends a piece)."""

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([s["lang"] for s in found], pa.string()), pa.array([s["overlap"] for s in found], pa.int32())]
        words = [pa.array(s["words"], pa.binary()) for s in found]
        places = pa.array(np.cumsum([0, *map(len, words)]), pa.int32())
        columns += [pa.ListArray.from_arrays(places, pa.concat_arrays(words).view(pa.string())), pa.ListArray.from_arrays(places, pa.array(np.concatenate([s["counts"] for s in found]), pa.int64())), pa.array([s["n"] for s in found], pa.int32()), pa.array([s["ids"] for s in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=_SHARDS)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = open_.get(lang) or open_.setdefault(lang, Shard(lang, size, longest))
                for full in shard.add(text.as_py()):
                    yield batch_of([full])
            if sum(s.n for s in open_.values()) > 2 * size:  # many languages at once
                fullest = max(open_.values(), key=lambda s: s.n)
                for full in fullest.flush():
                    yield batch_of([full])
        for shard in open_.values():
            for full in shard.flush():
                yield batch_of([full])

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, _SHARDS_DDL)


# ------------------------------------------------------------------------- suffix order


def doubled(rank: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Ranks of pairs: those of equal pairs are equal, and they rise as the pairs do."""
    key = rank.astype(np.int64) * (int(other.max(initial=0)) + 1) + other
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def suffix_order(ids: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` that hold a phrase of two words or more, in order through ``depth``
    words, and the words that each has in common with the one before. ``room`` is the number
    of words until the next break; what lies behind a break counts as 0.

    Prefix doubling: ranks of one word, then of 2, 4, ... words, each from two ranks of half
    the length; the last step adds what lacks to ``depth``.
    """
    n = len(ids)
    ranked = room >= 2
    ranked[1:] |= room[:-1] >= 2  # and the last words of phrases, of which ranks are made, too
    at = np.flatnonzero(ranked)

    def shifted(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        inside = room[at] > by
        out[inside] = rank[at[inside] + by]
        return out

    ranks, long = ids.astype(np.int64), 1
    while long < depth:
        step = min(long, depth - long)  # halves overlap where less than double is wanted
        full = np.zeros(n, np.int64)
        full[at] = doubled(ranks[at], shifted(ranks, step)) + 1
        ranks, long = full, long + step
    at = at[room[at] >= 2]
    order = at[np.argsort(ranks[at], kind="stable")]
    common = np.zeros(len(order), np.int64)
    left, right = order[:-1], order[1:]
    alike = np.ones(max(len(order) - 1, 0), bool)
    for m in range(depth):
        alike &= (room[left] > m) & (room[right] > m)
        alike[alike] = ids[left[alike] + m] == ids[right[alike] + m]
        common[1:] += alike
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, room: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The LCP intervals of ``m`` words: a suffix that begins with each phrase, and its count."""
    long = room[order] >= m
    first = np.flatnonzero(long & (common < m))
    bounds = np.append(first, len(order))
    counts = np.add.reduceat(long.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    return order[bounds[:-1]], counts


def run_from(yes: np.ndarray) -> np.ndarray:
    """How many places in a row hold from each place on."""
    places = np.arange(len(yes))
    stops = np.append(np.flatnonzero(~yes), len(yes))
    return stops[np.searchsorted(stops, places)] - places


def room_of(joined: np.ndarray) -> np.ndarray:
    """Words from each place until a phrase must end: ``joined`` says which words hold on to the
    next one."""
    return run_from(joined) + 1


# ------------------------------------------------------------------------- what is frequent


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread evenly (any odd factors do)."""
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two parts by their hashes, in order."""
    with np.errstate(over="ignore"):
        return mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """Of the words of a language."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def bitmap(spark: SparkSession, hashes: DataFrame, bits: int, width: int = 64):
    """A broadcast of 2**bits bits, those of ``hashes`` (one bigint column, ``h``, of ``width`` bits) set by
    their first bits."""
    low = min(bits, 19)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << (low - 3), np.uint8)
        at = np.unique(pdf["bit"].to_numpy())
        np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "held": [held.tobytes()]})

    place = F.shiftrightunsigned("h", width - bits)
    spots = hashes.select(F.shiftright(place, low).alias("block"), place.bitwiseAND(F.lit((1 << low) - 1)).alias("bit")).distinct()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for row in spots.groupBy("block").applyInPandas(block, "block bigint, held binary").collect():  # 2**bits bits in all
        whole[row.block << (low - 3) : (row.block + 1) << (low - 3)] = np.frombuffer(row.held, np.uint8)
    return spark.sparkContext.broadcast(whole)


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - (len(bits).bit_length() + 2))).astype(np.int64)
    return bits[at >> 3] >> (at & 7) & 1 == 1


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            planes = pa.decompress(batch.column(4)[k].as_buffer(), 4 * batch.column(3)[k].as_py(), "zstd")
            ids = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values, ids
            if len(ids) > 1 << 16:
                trim()


def word_counts(found: DataFrame) -> DataFrame:
    """lang, phrase (of one word), a of every word of the shards."""
    each = found.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return each.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a"))


def _hash_of_words(lang: pd.Series, phrase: pd.Series) -> pd.Series:
    out = np.zeros(len(lang), np.uint64)
    for name in lang.unique():
        own = (lang == name).to_numpy()
        out[own] = word_hashes(name, pa.array(phrase[own], pa.string()))
    return pd.Series(out.view(np.int64))


class Words:
    """A shard's words with what is known of them: hashes and where the frequent ones stand."""

    def __init__(self, lang: str, words: pa.Array, ids: np.ndarray, frequent: np.ndarray):
        hashes = np.append(np.uint64(0), word_hashes(lang, words))
        self.hash = hashes[ids]
        self.known = np.append(False, held(frequent, hashes[1:]))[ids]
        self.joined = self.known & np.append(self.known[1:], False)[: len(ids)]

    def grams(self, at: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the ``m`` words from each place."""
        out = self.hash[at]
        for k in range(1, m):
            out = pair_hash(out, self.hash[at + k])
        return out

    def room(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words from each place until a phrase must end; of ``levels`` the first has the pairs that
        may stand in one, the second the triples."""
        joined, three = self.joined.copy(), None
        if levels:
            at = np.flatnonzero(joined)
            joined[at] = held(levels[0], self.grams(at, 2))
        if levels[1:]:
            three = np.zeros(len(joined), bool)
            at = np.flatnonzero(joined[:-1] & joined[1:])
            three[at] = held(levels[1], self.grams(at, 3))
        room = room_of(joined) if three is None else np.where(joined, 2 + run_from(three), 1)
        room[~self.known] = 0
        return room


def counted_again(overlap: int, room: np.ndarray, m: int) -> np.ndarray:
    """Places of phrases that were counted in the shard before, too."""
    return np.array([i for i in range(overlap - m + 1) if room[i] >= m], np.int64)


class Blocks:
    """Sorted keys with counts, gathered over shards and given out as one block a range of keys.

    A shuffle of blocks instead of rows: some three bytes a key, and no work a row outside numpy.
    Until then a key and its count are one number, the count (-1 or more, of one shard) in the bits
    that the key leaves, so that they are sorted in place.
    """

    def __init__(self, ranges: int):
        self.ranges, self.parts, self.n = ranges, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys << _ROOM | (counts + 1).astype(np.uint64))
        self.n += len(keys)
        if self.n >= PENDING:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        both = np.concatenate(self.parts)
        self.parts, self.n = [], 0
        both.sort()
        keys = both >> _ROOM
        both &= (np.uint64(1) << _ROOM) - np.uint64(1)
        counts = both.view(np.int64)
        counts -= 1
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        del both, first
        part = (keys * np.uint64(self.ranges)) >> np.uint64(KEY)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keys))
        spans = list(pairwise(cuts.tolist()))
        step = -(-len(spans) // STEPS)
        for k in range(0, len(spans), step):
            some = spans[k : k + step]
            rows = [[part[a] for a, _ in some], [packed(keys[a:b]) for a, b in some], [counts[a:b].astype("<i4").tobytes() for a, b in some]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _BLOCKS, strict=True)], schema=_BLOCKS)
_BLOCKS = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def packed(keys: np.ndarray) -> bytes:
    """Rising keys as their differences, all lowest bytes first, so that the higher ones compress away."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, : KEY // 8].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(KEY // 8, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : KEY // 8] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def frequent_grams(found: DataFrame, frequent, levels: list, least: int) -> DataFrame:
    """h of the pairs of frequent words of the shards that stand ``least`` times; with the pairs as a
    level, of the triples."""
    m = len(levels) + 2
    ranges = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(ranges)
        for lang, overlap, words, ids in rows_of(batches):
            own = Words(lang, words, ids, frequent.value)
            room = own.room([x.value for x in levels])
            at, counts = intervals(*suffix_order(ids, room, m), room, m)
            again = counted_again(overlap, room, m)
            at, counts = np.concatenate((at, again)), np.concatenate((counts, np.full(len(again), -1)))
            yield from blocks.add(own.grams(at, m) >> np.uint64(64 - KEY), counts)
        yield from blocks.flush()

    def merge(blocks: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x) for x in blocks.column("keys").to_pylist()])
        keys, counts = summed(keys, np.frombuffer(b"".join(blocks.column("counts").to_pylist()), "<i4").astype(np.int64))
        return pa.table({"h": pa.array(keys[counts >= least].view(np.int64), pa.int64())})

    blocks = found.select("lang", "overlap", "words", "n", "ids").mapInArrow(run, "part bigint, keys binary, counts binary")
    return blocks.groupBy("part").applyInArrow(merge, "h bigint")


_PHRASES = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def phrase_counts(found: DataFrame, frequent, levels: list, longest: int, least: int) -> DataFrame:
    """lang, phrase, m, a of every phrase of 2 to ``longest`` words that stands ``least`` times; its pairs and
    triples are all in ``levels``. What a shard counts goes out as one block a range of hashes, too."""
    ranges = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, overlap, words, ids in rows_of(batches):
            own = Words(lang, words, ids, frequent.value)
            room = own.room([x.value for x in levels])
            order, common = suffix_order(ids, room, longest)
            parts, phrases, lengths, sums = [], [], [], []
            for m in range(2, longest + 1):
                at, counts = intervals(order, common, room, m)
                again = counted_again(overlap, room, m)
                at, counts = np.concatenate((at, again)), np.concatenate((counts, np.full(len(again), -1)))
                if len(at):
                    parts.append(((own.grams(at, m) >> np.uint64(64 - KEY)) * np.uint64(ranges)) >> np.uint64(KEY))
                    phrases.append(pc.binary_join_element_wise(*(words.take(pa.array(ids[at + k] - 1)) for k in range(m)), " "))
                    lengths.append(np.full(len(at), m, np.int32))
                    sums.append(counts)
            if not parts:
                continue
            part = np.concatenate(parts)
            by = np.argsort(part, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, part[by][1:] != part[by][:-1])), len(by))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x.take(pa.array(by))) for x in (pa.concat_arrays(phrases), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(sums), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(part[by][cuts[:-1]].astype(np.int64)), pa.array([lang] * (len(cuts) - 1), pa.string()), *lists], schema=_PHRASES)

    def merge(blocks: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(blocks.column("phrases")).to_numpy()
        flat = pa.table({"lang": blocks.column("lang").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), "phrase": pc.list_flatten(blocks.column("phrases")), "m": pc.list_flatten(blocks.column("lengths")), "a": pc.list_flatten(blocks.column("counts"))})
        total = flat.group_by(["lang", "phrase", "m"]).aggregate([("a", "sum")])
        return total.filter(pc.greater_equal(total.column("a_sum"), least)).select(["lang", "phrase", "m", "a_sum"]).rename_columns(["lang", "phrase", "m", "a"])

    blocks = found.select("lang", "overlap", "words", "n", "ids").mapInArrow(run, "part bigint, lang string, phrases array<string>, lengths array<int>, counts array<bigint>")
    return blocks.groupBy("part").applyInArrow(merge, "lang string, phrase string, m int, a bigint")


# ------------------------------------------------------------------------- scores


def scored(words: DataFrame, candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each candidate at its lowest-scoring cut."""
    parts = words.select("lang", "phrase", "a").unionByName(candidates.select("lang", "phrase", "a"))
    split = candidates.withColumn("w", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    # 17 digits each: products of two have 34, and with the 1000 before them 38 at most
    score = F.expr("(CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0)) * CAST(1000 AS DECIMAL(4, 0))) DIV (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))")
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r", "n").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def explained(candidates: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of the candidates that stand in a longer one with ``percent`` of their count."""
    w = candidates.select("lang", "a", "m", F.split("phrase", " ").alias("w")).filter("m > 2")
    each = w.select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("long"))
    inner = each.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - F.col("long") + 1), lambda i: F.array_join(F.slice("w", i, F.col("long")), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"]).filter(100 * F.col("longer") >= percent * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = PERCENT, size: int = SHARD, bits: int = BITS) -> DataFrame:
    """Of every language of ``docs`` (text, lang) its ``top`` phrases of 2 to ``longest`` words that
    stand ``least`` times: lang, rank, phrase, a, l, r, n, score."""
    if 2 * size + longest >= 1 << (64 - KEY):
        raise ValueError("a shard's counts must fit beside a key")
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    found = scratch.keep(shards(docs, size, longest), **ALONE)
    counts = scratch.keep(word_counts(found))
    totals = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    words = counts.filter(F.col("a") >= least)
    hash_of = pandas_udf(_hash_of_words, "bigint")
    frequent = bitmap(spark, words.select(hash_of("lang", "phrase").alias("h")), bits)
    levels: list = []
    for _ in range(2):  # pairs, then triples
        levels.append(bitmap(spark, frequent_grams(found, frequent, levels[:], least), bits, KEY))
    candidates = scratch.keep(phrase_counts(found, frequent, levels, longest, least))
    scratch.drop(found)
    kept = scored(words, candidates, totals).join(explained(candidates, percent), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # in two steps: what isn't among the first of its part isn't among the first of its language
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
