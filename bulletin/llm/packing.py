"""Best-fit packing of token sequences into fixed-length training sequences (operator 10).

Hierarchical residual packing. Every document becomes ids plus an end id and is cut into
pieces of ``capacity`` tokens only where longer, the first piece taking the remainder.
Each partition packs its own pieces best-fit in order of falling length and emits the
bins that are nearly full. Underfull bins travel up a tree, each as one item, and meet
others in fewer, wider partitions for another best-fit round; a bin over half full that
holds several pieces is opened there, since two of those can never share a sequence.

Memory: a task holds at most ``max_units`` items at once and packs them block by block.
Recovery: each round is a table in the shared scratch folder, so an assignment, once
used, is never recomputed differently.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, tidy
from .tokens import default_path, json_encoding

CAPACITY = 1024
END_ID = 2
#: A bin with at most so many free places is emitted at once.
SLACK = 4
FAN_IN = 8
MAX_UNITS = 200_000

PIECE = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"
UNIT = f"fill int, members array<struct<{PIECE.replace(' ', ':').replace(',:', ', ')}>>"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
_BIN = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(_MEMBER)), ("closed", pa.bool_())])


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only the first may be shorter."""
    first = n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def cut(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    path = tokenizer_path or default_path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = json_encoding(path)
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.concatenate((enc.encode_to_numpy(text, allowed_special="all"), tail)) if text else tail
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8))
                rows += [(doc_id, k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(pieces_of(len(ids), capacity))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the indices of the items in each bin."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    some = 0  # bit k: a bin with k free places exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := some >> n:
            k = n + (fits & -fits).bit_length() - 1
            b = free[k].pop()
            if not free[k]:
                some &= ~(1 << k)
            bins[b].append(i)
        else:
            k, b = capacity, len(bins)
            bins.append([i])
        if left := k - n:
            free[left].append(b)
            some |= 1 << left
    return bins


def _packer(round_no: int, capacity: int, slack: int, max_units: int, last: bool):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = (round_no << 56) | (TaskContext.get().partitionId() << 32), 0

        def pack(units: list[list[dict]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            sizes = np.array([sum(m["length"] for m in u) for u in units], dtype=np.int64)
            out: dict[str, list] = {f.name: [] for f in _BIN}
            for own in best_fit(sizes, capacity):
                fill = int(sizes[own].sum())
                out["sequence_id"].append(base | made)
                out["fill"].append(fill)
                out["members"].append([m for i in own for m in units[i]])
                out["closed"].append(last or fill >= capacity - slack)
                made += 1
            for at in range(0, len(out["fill"]), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name][at : at + 4096], f.type) for f in _BIN], schema=_BIN)

        held: list[list[dict]] = []
        for batch in batches:
            for fill, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if round_no and len(members) > 1 and 2 * fill > capacity:
                    held += [[m] for m in members]  # opened
                else:
                    held.append(members)
            if len(held) >= max_units:
                yield from pack(held)
                held = []
        if held:
            yield from pack(held)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, max_units: int = MAX_UNITS) -> DataFrame:
    """Bins of ``pieces`` (doc_id, piece, start, length, ids_crc32): adds sequence_id, offset."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    schema = f"sequence_id bigint, {UNIT}, closed boolean"
    units = pieces.select(F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    closed: DataFrame | None = None
    width, round_no, before = units.rdd.getNumPartitions(), 0, None
    while True:
        last = width == 1
        done = scratch.keep(units.mapInArrow(_packer(round_no, capacity, slack, max_units, last), schema))
        open_ = done.filter(~F.col("closed"))
        n_open = 0 if last else open_.count()
        # a round that no longer merges anything ends the search: the rest stand alone
        stuck = before is not None and n_open > max_units and n_open > 0.98 * before
        whole = done if stuck or not n_open else done.filter("closed")
        closed = whole if closed is None else closed.unionByName(whole)
        if stuck or not n_open:
            break
        round_no, before = round_no + 1, n_open
        width = max(1, min(-(-width // fan_in), -(-n_open * fan_in // max_units)))
        units = open_.select("fill", "members").repartition(width)
    at = F.aggregate(F.slice("members", F.lit(1), F.col("k")), F.lit(0).cast("bigint"), lambda a, m: a + m["length"])
    return (
        closed.select("sequence_id", "members", F.posexplode("members").alias("k", "m"))
        .select("m.doc_id", "m.piece", "m.start", F.col("m.length").cast("bigint").alias("length"), "m.ids_crc32", "sequence_id", at.alias("offset"))
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """One row per piece of every document, with its sequence and place there."""
    # kept, so that a task never runs the tokenizer and the packer at once
    pieces = Scratch(docs.sparkSession, "pieces").keep(cut(docs, tokenizer_path, capacity, end_id))
    return pack(pieces, capacity, slack)
