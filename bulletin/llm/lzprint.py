"""Lempel-Ziv phrase fingerprints of documents (operator 13).

A text's bytes are parsed as in LZ78: each phrase is the shortest string that isn't yet in
the dictionary and enters it. The set of phrases stands for what a compressor would learn
of the text; its fingerprint is the ``k`` least of the phrases' 32-bit hashes, and the likeness
of two fingerprints is the share of the union's ``k`` least that stand in both, which is the
Jaccard similarity of the sets, exactly where they have at most ``k`` phrases in all.

`fingerprints` is the plain operator. `against_neighbours` also compares each document with
an edit of itself, its tail replaced by the head of the next document, and with that
document. Documents are dealt by ranges of the order (falling id, text hash, text), one
range to a task, and stream through it; the first document of a range also goes to the
end of the range before, so no task waits for another. An id with many rows is cut by the
hash. The parse of what text and edit share is done once.

Memory: a task holds two documents and one dictionary of at most ``phrases`` entries, which
is then begun afresh; the driver holds one id for each range.

Defined cases: a null text is empty; an empty text has the empty fingerprint, like only to
another empty one (1, else 0); a null id comes last; rows alike in id and text may stand
either way round; a single document is next to itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import tidy

K = 256
PHRASES = 1 << 18
#: Bytes whose phrases are hashed at a time.
BLOCK = 1 << 22
#: Factor of the polynomial that hashes a phrase, and those of the mixing behind it: any odd numbers do.
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_LEAST = -(2**63)


def parse(data: bytes, known: dict[int, int], node: int, place: int, ends: list[int], phrases: int = PHRASES) -> int:
    """Go on parsing at ``node`` of the trie ``known``: ``data`` begins at ``place``; the ends of
    phrases go to ``ends``. Returns the node of the unfinished phrase, 0 if there is none."""
    get = known.get
    for place, byte in enumerate(data, place + 1):
        child = get(node + byte)
        if child is None:
            if len(known) >= phrases:
                known.clear()
            else:
                known[node + byte] = (len(known) + 1) << 8
            ends.append(place)
            node = 0
        else:
            node = child
    return node


def hashes(data: bytes, ends: list[int], place: int = 0) -> np.ndarray:
    """32-bit hashes of the phrases that end at ``ends``, the first of which begins at ``place``."""
    if not ends:
        return np.empty(0, np.uint32)
    if ends[-1] - place > BLOCK and len(ends) > 1:
        half = len(ends) // 2
        return np.concatenate((hashes(data, ends[:half], place), hashes(data, ends[half:], ends[half - 1])))
    stops = np.array(ends, np.int64)
    starts = np.concatenate(([place], stops[:-1]))
    sizes = stops - starts
    deep = int(sizes.max())
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(deep, _BASE, np.uint64))
        within = np.arange(stops[-1] - place) - np.repeat(starts - place, sizes)
        terms = (np.frombuffer(data, np.uint8, int(stops[-1]) - place, place).astype(np.uint64) + np.uint64(1)) * power[within]
        h = np.add.reduceat(terms, starts - place)
        for shift, factor in zip((30, 27), _MIX, strict=True):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def least(found: np.ndarray, k: int) -> np.ndarray:
    return np.unique(found)[:k]


def written(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Of two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    values, times = np.unique(np.concatenate((a, b)), return_counts=True)
    return float((times[:k] == 2).mean())


def fingerprint(text: str, k: int = K, phrases: int = PHRASES) -> np.ndarray:
    data = text.encode("utf-8", "surrogateescape")
    ends: list[int] = []
    parse(data, {}, 0, 0, ends, phrases)
    return least(hashes(data, ends), k)


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "surrogateescape")


def fingerprints(docs: DataFrame, k: int = K, phrases: int = PHRASES) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(fingerprint(_text(t.as_py()), k, phrases)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


class Parsed:
    """A document with its signature, and the parse as it stood where its tail begins."""

    def __init__(self, doc_id: int | None, text: str, k: int, phrases: int):
        self.doc_id, self.text, self.k, self.phrases = doc_id, text, k, phrases
        self.tail = len(text) // 3
        self.head = text[: len(text) - self.tail].encode("utf-8", "surrogateescape")
        data = text.encode("utf-8", "surrogateescape")
        self.ends: list[int] = []
        self.known: dict[int, int] = {}
        self.node = parse(self.head, self.known, 0, 0, self.ends, phrases)
        self.shared = hashes(self.head, self.ends)
        known, more = (self.known.copy(), []) if self.tail else ({}, [])
        parse(data[len(self.head) :], known, self.node, len(self.head), more, phrases)
        self.signature = self.joined(data, more)

    def joined(self, data: bytes, more: list[int]) -> np.ndarray:
        return least(np.concatenate((self.shared, hashes(data, more, self.ends[-1] if self.ends else 0))), self.k)

    def edited(self, following: str) -> tuple[bytes, np.ndarray]:
        """Text and signature with the tail replaced by the head of ``following``. Once only."""
        head = following[: self.tail].encode("utf-8", "surrogateescape")
        data, more = self.head + head, []
        parse(head, self.known, self.node, len(self.head), more, self.phrases)
        return data, self.joined(data, more)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def places_of(key: np.ndarray, spread: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each row: ``bounds`` fall; rows of an id that is several bounds are dealt by
    ``spread`` (0 to 1, growing with the text hash)."""
    up, rising = -key.astype(np.float64), -bounds
    low, high = np.searchsorted(rising, up, "left"), np.searchsorted(rising, up, "right")
    return low + np.minimum((spread * (high - low + 1)).astype(np.int64), high - low)


def against_neighbours(docs: DataFrame, k: int = K, phrases: int = PHRASES, ranges: int | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the next one: doc_id, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("h", F.xxhash64("text"))
    shares = [float(x) for x in np.arange(1, ranges) / ranges]
    found = rows.agg(F.percentile_approx("key", shares, 20 * ranges).alias("b")).first().b if shares else []
    bounds = np.array(sorted(found or [], reverse=True), np.float64)

    def placed(key: pd.Series, h: pd.Series) -> np.ndarray:
        return places_of(key.to_numpy(), h.to_numpy() / 2.0**64 + 0.5, bounds).astype(np.int32)

    @pandas_udf("int")
    def place(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(placed(key, h))

    firsts = rows.groupBy(place("key", "h").alias("place")).agg(F.max(F.struct("key", F.bitwise_not(F.col("h")).alias("r"))).alias("first"))
    heads = sorted((r.place, r.first.key, ~r.first.r) for r in firsts.collect())  # one for each range
    before = {(key, h): heads[n - 1][0] for n, (_, key, h) in enumerate(heads)}

    @pandas_udf("array<int>")
    def places(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[p] if (b := before.get(at)) is None else [p, b] for p, at in zip(placed(key, h).tolist(), zip(key.tolist(), h.tolist(), strict=True), strict=True)])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Parsed | None = None
        over = False
        for batch in batches:
            out: list[list] = [[] for _ in _OUT]
            for doc_id, value, is_next in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if over:
                    break  # further rows of that id, which begin the next range
                new = Parsed(doc_id.as_py(), _text(value.as_py()), k, phrases)
                if held is not None:
                    data, signature = held.edited(new.text)
                    row = (held.doc_id, len(held.text), data, written(held.signature), written(signature), likeness(held.signature, signature, k), likeness(held.signature, new.signature, k))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                held, over = new, is_next.as_py()
            if out[0]:
                arrays = [pa.array(x, pa.binary()).view(pa.string()) if f.name == "edited_text" else pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_OUT)

    dealt = rows.select("doc_id", "text", "key", "h", F.posexplode(places("key", "h")).alias("is_next", "place"))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("place")).sortWithinPartitions("is_next", F.desc("key"), "h", "text")
    return dealt.select("doc_id", "text", (F.col("is_next") == 1).alias("is_next")).mapInArrow(run, _DDL)
