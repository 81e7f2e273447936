"""Byte-level BPE encoding and decoding (operator 2).

The words of each text (matches of the tokenizer's pattern) are taken by Spark's regular
expressions. Distinct words, as arrays of byte tokens, are encoded once: Spark higher-order
functions fold the ranked merges over them, looking pairs up in one literal rank map.
Documents then put the ids of their words together, and decoding concatenates the ids'
binary pieces.

Words that a bounded sample shows to be frequent (at most ``shared_words``) are distinct in
the whole corpus: they are folded first and broadcast. Of the others, those of a partition
are distinct there: they go down the pipeline before the batch in which they first occur, then
the batch's documents as numbers of words, so encoded words always arrive before their uses.
No text is shuffled. The dictionary of a partition is begun anew at ``max_words`` words of
its own, so memory is bounded whatever the vocabulary of the corpus; a word is then folded
again. The sample decides only where a word is folded, never its ids.

A fold moves the rest of a word for every merge, so its time grows with the square of the
word. Words over ``long_word`` bytes are merged with a heap instead, by the same ranks.

Defined cases: a null text counts as empty: no ids, both digests those of the empty
string; repeated rows are encoded as often as they occur; an empty table gives no rows;
other columns are ignored. Very long texts and words need memory in proportion.
"""

from __future__ import annotations

import hashlib
import heapq
import random
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import default_path, default_pattern, load_ranks

MAX_WORDS = 500_000
LONG_WORD = 512
#: Documents of the sample that tells frequent words, how often one is there, how many count.
SAMPLE_DOCS, OFTEN, SHARED_WORDS = 40_000, 3, 500_000
#: Texts sent to Python at once, as arrays of their words.
BATCH_ROWS = 1000
#: The literal pair table: a perfect hash, its slots found by a multiply and a displacement.
_SLOT_BITS, _SHIFT_BITS, _M1, _M2 = 18, 15, 1000003897, 900022589
_EDGE = 65535  # the id of what stands before and behind a word
_RANK = (1 << 47) - 1  # bits of a slot that tell its pair from others
_NEWEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The rank map of token pairs as a perfect hash: slots with left token, right token
    and merged token in 16 bits each, and a displacement for each group of pairs."""
    pairs = {}
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            a, b = ranks.get(word[:i]), ranks.get(word[i:])
            if a is not None and b is not None:
                pairs[a << 16 | b] = rank
    groups: dict[int, list[int]] = {}
    for key in pairs:
        groups.setdefault(key * _M2 >> 28 & (1 << _SHIFT_BITS) - 1, []).append(key)
    size = 1 << _SLOT_BITS
    slots, shifts = [0] * size, [0] * (1 << _SHIFT_BITS)
    rng = random.Random(0)
    for g, keys in sorted(groups.items(), key=lambda x: -len(x[1])):
        for _ in range(100_000):
            shift = rng.randrange(size)
            places = {(key * _M1 >> 24) + shift & size - 1 for key in keys}
            if len(places) == len(keys) and not any(slots[p] for p in places):
                break
        else:
            raise ValueError("the rank map is too large for the literal table")
        shifts[g] = shift
        for key in keys:
            slots[(key * _M1 >> 24) + shift & size - 1] = key << 16 | pairs[key]
    return slots, shifts


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(tokens: Column, table: tuple[list[int], list[int]]) -> Column:
    """The ids of a word given as array<int> of byte tokens: an aggregate that applies
    the lowest-ranked merge of the word, leftmost first, until none is left.

    The state is an array with one long for each piece: the rank of its pair with the next
    piece above its own id, so the array's least element is the merge. A pair that is no
    merge differs from its slot above 16 bits, so it has a larger number than any rank. A
    piece that is in no pair stands at either end.
    """

    def fold(tables: Column) -> Column:
        slots, shifts = F.get(tables, F.lit(0)), F.get(tables, F.lit(1))

        def states(keys: Column) -> Column:
            def state(key: Column) -> Column:  # of left << 16 | right
                shift = F.get(shifts, F.shiftright(key * _M2, 28).bitwiseAND((1 << _SHIFT_BITS) - 1).cast("int"))
                slot = F.get(slots, (F.shiftright(key * _M1, 24) + shift).bitwiseAND((1 << _SLOT_BITS) - 1).cast("int"))
                return F.shiftleft((slot - F.shiftleft(key, 16)).bitwiseAND(_RANK), 16).bitwiseOR(F.shiftright(key, 16))

            return F.transform(keys, state)

        def step(s: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                def at(k: Column) -> Column:  # piece k, from 1, goes with the next one
                    own = F.shiftright(least, 16)
                    keys = F.array(F.shiftleft(F.get(s, k - 2).bitwiseAND(65535), 16).bitwiseOR(own), F.shiftleft(own, 16).bitwiseOR(F.get(s, k + 1).bitwiseAND(65535)))
                    return F.concat(F.slice(s, F.lit(1), k - 2), states(keys), F.slice(s, k + 2, F.size(s)))

                return F.when(least >= 65536 << 16, s).otherwise(_let(F.array_position(s, least).cast("int"), at))

            return _let(F.array_min(s), merge)

        edge = F.array(F.lit(_EDGE))
        lefts, rights = F.concat(edge, tokens, edge), F.concat(tokens, edge, edge)
        start = states(F.zip_with(lefts, rights, lambda a, b: F.shiftleft(a.cast("bigint"), 16).bitwiseOR(b.cast("bigint"))))
        turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - 1))
        return F.aggregate(turns, start, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(65535).cast("int")))

    slots, shifts = (F.split(F.lit(" ".join(map(str, x))), " ").cast("array<bigint>") for x in table)
    return _let(F.array(slots, shifts), fold)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by the lowest-ranked merges, leftmost first, from a heap."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that begins at a place
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and ends[at] < n and (rank := ranks.get(word[at : ends[ends[at]]])) is not None:
            heapq.heappush(heap, (rank, at, ends[ends[at]]))

    for at in range(n):
        offer(at)
    while heap:
        _, at, end = heapq.heappop(heap)
        if ends[at] == -1 or ends[at] == end or ends[at] >= n or ends[ends[at]] != end:
            continue  # of pieces that are no longer
        gone, ends[at] = ends[at], end
        ends[gone] = -1
        if end < n:
            before[end] = at
        offer(before[at])
        offer(at)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def _tokens_of(words: pa.Array, byte_ids: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False)))).astype(np.int32)
    raw = np.frombuffer(b"".join(words.to_pylist()), dtype=np.uint8)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(byte_ids[raw]))


def frequent_words(texts: DataFrame, words: Column, byte_ids: np.ndarray, table: tuple[list[int], list[int]], shared_words: int = SHARED_WORDS, sample_docs: int = SAMPLE_DOCS, long_word: int = LONG_WORD) -> pa.Table:
    """word, ids of the words that are frequent in a bounded sample, folded by Spark."""
    n = texts.count()
    share = min(1_000_000, -(-sample_docs * 1_000_000 // max(1, n)))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts within the task first; single ones could add up, so they stay."""
        held: Counter = Counter()
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten().cast(pa.binary()))
            for word, times in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                held[word] += times
            if len(held) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counted = sample.select(words.alias("words")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= OFTEN) & (F.octet_length("word") <= long_word))
    top = counted.orderBy(F.desc("n"), "word").limit(shared_words).select("word").repartition(texts.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0)
            yield pa.RecordBatch.from_arrays([word, _tokens_of(word, byte_ids)], names=["word", "tokens"])

    folded = top.mapInArrow(run, "word binary, tokens array<int>").select("word", fold_merges(F.col("tokens"), table).alias("ids"))
    return folded.toArrow()


def _number_words(shared, byte_ids: np.ndarray, ranks_path: str, max_words: int, long_word: int):
    """Batches (doc_id, words) -> rows of new words (byte tokens, or ids of long ones) before
    documents as int32 numbers of words; ``begin`` marks where the numbering begins anew."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("numbers", pa.binary()), ("tokens", ints), ("ids", ints), ("begin", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = {w: i for i, w in enumerate(shared.value.column("word").to_pylist())}
        known: dict[bytes, int] = {}
        begin, ranks = True, None
        for batch in batches:
            words = batch.column(1)
            flat = words.flatten().cast(pa.binary()).dictionary_encode()
            distinct = flat.dictionary.to_pylist()
            place = np.fromiter((base[w] if w in base else known.get(w, -1) for w in distinct), dtype=np.int32, count=len(distinct))
            fresh = np.flatnonzero(place < 0)
            place[fresh] = np.arange(len(base) + len(known), len(base) + len(known) + len(fresh))
            new = [distinct[i] for i in fresh.tolist()]
            known.update(zip(new, place[fresh].tolist(), strict=True))
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                n = len(part)
                long = [len(w) > long_word for w in part]
                if any(long):
                    ranks = ranks or load_ranks(ranks_path)
                tokens = _tokens_of(pa.array([b"" if x else w for w, x in zip(part, long, strict=True)], pa.binary()), byte_ids)
                ids = pa.array([merge_long(w, ranks) if x else None for w, x in zip(part, long, strict=True)], ints)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), tokens, ids, pa.array([begin] + [False] * (n - 1))], schema=schema)
                begin = False
            numbers = place[flat.indices.to_numpy(zero_copy_only=False)]
            counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(counts)))
            rows = [numbers[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            n = len(rows)
            for at in range(0, n, 2000):
                m = min(2000, n - at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, m).cast(pa.int64()), pa.array(rows[at : at + m], pa.binary()), pa.nulls(m, ints), pa.nulls(m, ints), pa.array([False] * m)], schema=schema)
            if len(known) >= max_words:
                known, begin = {}, True

    return run


def _put_together(shared, ranks_path: str):
    """Rows of encoded words and documents -> n_tokens and the digests of ids and bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        binary = pa.array(pieces, pa.large_binary())
        spelled = pa.array([b"%d " % i for i in range(len(pieces))], pa.large_binary())
        ids_of = shared.value.column("ids").combine_chunks()
        base = ids_of if isinstance(ids_of, pa.ListArray) else pa.concat_arrays(ids_of.chunks)
        words: list[pa.Array] = [base.cast(pa.list_(pa.int32()))]
        base = words[0]

        def joined(values: pa.Array, ids: pa.Array) -> memoryview:
            out = values.take(ids)
            return memoryview(out.buffers()[2]) if len(out) else memoryview(b"")

        for batch in batches:
            out = []
            is_doc = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(is_doc.astype(np.int8))) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(is_doc)], strict=True):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                if not is_doc[a]:
                    begins = np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False))
                    words = [base, part.column(2)] if len(begins) else [*words, part.column(2)]
                    if len(begins) and begins[0]:
                        raise ValueError("words arrived out of order")
                    continue
                if len(words) > 1:
                    words = [pa.concat_arrays([w.cast(base.type) for w in words])]
                for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    numbers = np.frombuffer(raw, dtype=np.int32)
                    ids = words[0].take(pa.array(numbers)).flatten() if len(numbers) else pa.array([], pa.int32())
                    text = joined(spelled, ids)
                    out.append((doc_id, len(ids), hashlib.sha256(text[:-1]).hexdigest(), hashlib.sha256(joined(binary, ids)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def byte_bpe(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, max_words: int = MAX_WORDS, shared_words: int = SHARED_WORDS, long_word: int = LONG_WORD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text)."""
    ranks_path = ranks_path or default_path("byte_bpe_50k.tiktoken")
    ranks = load_ranks(ranks_path)
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
    # Unicode white space, as the tokenizer libraries take it
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + (pattern or default_pattern())), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    session, table = docs.sparkSession, pair_table(ranks)
    rows_at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(session.conf.get(rows_at_once)) <= BATCH_ROWS:
        session.conf.set(rows_at_once, BATCH_ROWS)  # for when the result is read
    shared = session.sparkContext.broadcast(frequent_words(texts, words, byte_ids, table, shared_words, long_word=long_word))
    numbered = texts.select("doc_id", words.alias("words")).mapInArrow(_number_words(shared, byte_ids, ranks_path, max_words, long_word), "doc_id bigint, numbers binary, tokens array<int>, ids array<int>, begin boolean")
    folded = F.when(F.col("ids").isNotNull() | F.col("tokens").isNull(), F.col("ids")).otherwise(fold_merges(F.col("tokens"), table))
    encoded = numbered.select("doc_id", "numbers", folded.alias("ids"), "begin")
    return encoded.mapInArrow(_put_together(shared, ranks_path), _NEWEST)
