"""Exact removal of repeated byte strings by depth-limited radix sort of suffixes (operator 9).

Every byte that lies in a string of ``threshold`` bytes that also starts anywhere else in
the corpus is removed. Suffixes are told apart only to the threshold's depth, by
most-significant-digit passes over the whole corpus. A suffix alone in its group drops out
after each pass; groups left at full depth are exactly the repeated windows. Suffixes are
read from a place inside them that their own bytes choose, so that neighbouring ones go
through the passes together; one order of digits serves as well as another for equality:

1. The anchor: of the grams in the first bytes of a window the one with the least hash.
   Equal windows have equal anchors at equal offsets, so a hundredth of all places is moved.
2. All bytes of all windows around an anchor, at once. Anchors equal here have repeated
   windows only; one of each such class goes on, for those that resemble it in part.
3. The core that up to ``step`` neighbouring windows around one anchor share.
4. The bytes left and right of the core, one at a time: contexts are put in byte order, and
   windows are equal where neighbours in that order agree to their depth.

Several thresholds can share the passes: the least of them chooses the anchors, and only
windows all of whose shorter windows repeat are looked into at the next depth.

Hot groups: counts and equal contexts are summed before each shuffle, so copies of one
passage reach a task as one row from each task before; all joins are between tables, which
Spark can split. Around anchors that stand in more than ``HOT`` different places, blocks have
only HOT_STEP windows, so a core there has at most 2 * (HOT_STEP - 1) bytes of context to
tell its rows apart, however many documents hold it. Every pass ends as a table in the shared
scratch folder.

Digests of a pass's digit have 64 bits for anchors (which only preselect) and 128 bits for
anchor and surroundings, and for cores; the last digits are compared as bytes.

Defined cases: a null text is empty; texts shorter than the threshold stay whole; repeated
rows are repetitions of each other; an empty table gives no rows; other columns are
ignored by ``repeated`` and kept by ``strip_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, tidy

THRESHOLD = 400
#: Bytes that any passage of over 50 words has in running text (51 words of five letters and
#: a space have 306): what counts as a repeated passage, as opposed to a repeated string.
PASSAGE = 250
#: Bytes of texts that are hashed at once; longer texts go piece by piece.
SEGMENT = 1 << 20
STEP, HOT_STEP, HOT = 63, 4, 2000
#: Texts of an Arrow batch that are cut at once.
ROWS = 500
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64
_LARGEST = np.uint64(2**64 - 1)


def gram_of(threshold: int) -> int:
    return max(1, threshold // 4)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of a base and of its inverse, modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.concatenate(([np.uint64(1)], np.full(n - 1, self.base, dtype=np.uint64))).cumprod(dtype=np.uint64)
            self.down = np.concatenate(([np.uint64(1)], np.full(n - 1, self.inverse, dtype=np.uint64))).cumprod(dtype=np.uint64)


_POWERS = tuple(map(_Powers, _BASES))


def _prefix(data: np.ndarray, lane: int) -> np.ndarray:
    p = _POWERS[lane]
    p.to(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p.up[: len(data)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of the strings from ``starts`` to ``ends``."""
    return _mix((prefix[ends] - prefix[starts]) * _POWERS[lane].down[starts])


def _gram_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(_mix((prefix[n:] - prefix[: len(prefix) - n]) * _POWERS[0].down[: len(prefix) - n]), _LARGEST - np.uint64(1))


def _slide(x: np.ndarray, w: int, fold: np.ufunc, fill: np.uint64) -> np.ndarray:
    """Fold of each run of ``w`` neighbours: out[i] over x[i : i + w]."""
    n = len(x)
    padded = np.full(-(-n // w) * w + w, fill, dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = fold.accumulate(rows, axis=1).ravel()
    back = fold.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(back[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """The anchors of texts put end to end, and the windows that each is the anchor of."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, threshold: int):
        gram = gram_of(threshold)
        self.w = w = threshold - gram + 1
        self.ends, self.begins = ends, np.concatenate(([0], ends[:-1]))
        self.prefix = _prefix(data, 0)
        self.places = self.hashes = self.first = self.last = self.text = np.zeros(0, dtype=np.int64)
        if len(data) < threshold:
            return
        grams = _gram_hashes(self.prefix, gram)
        least = _slide(grams, w, np.minimum, _LARGEST)
        held = least.copy()
        for end in ends.tolist():  # windows that reach into the next text
            held[max(0, end - threshold + 1) : end] = 0
        # a gram is an anchor if it is the least of some whole window around it
        around = np.zeros(w - 1, dtype=np.uint64)
        most = _slide(np.concatenate((around, held, around)), w, np.maximum, np.uint64(0))
        self.places = np.flatnonzero(most[: len(grams)] == grams)
        self.hashes = grams[self.places]
        self.text = np.searchsorted(ends, self.places, side="right")
        # windows of one least hash lie together: an anchor's are in the last such run
        # that begins before it
        runs = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        stops = np.concatenate((runs[1:], [len(least)])) - 1
        codes, of_run = np.unique(least[runs], return_inverse=True)
        n = len(data) + 1  # places reach beyond the last window
        keys = of_run * n + runs
        order = np.argsort(keys, kind="stable")
        at = order[np.searchsorted(keys[order], np.searchsorted(codes, self.hashes) * n + self.places, side="right") - 1]
        self.first = np.maximum(runs[at], self.places - w + 1)
        self.last = np.minimum(stops[at], self.places)

    def windows(self, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of ``threshold`` bytes that lies in the anchor's text."""
        return np.maximum(self.first, self.begins[self.text]), np.minimum(self.last, self.ends[self.text] - threshold)

    def surroundings(self, threshold: int) -> np.ndarray:
        """Hashes of all bytes of all windows that an anchor could have."""
        lo = np.maximum(self.places - self.w + 1, self.begins[self.text])
        hi = np.minimum(self.places + threshold, self.ends[self.text])
        return _mix(_hashes(self.prefix, lo, hi, 0) + (self.places - lo).astype(np.uint64) * np.uint64(_BASES[1]) + (hi - lo).astype(np.uint64))


def _pieces(text: bytes, margin: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Pieces of a long text: (offset, first and last place of its own, bytes). A piece has
    ``margin`` bytes more on either side than places of its own."""
    if len(text) <= SEGMENT:
        yield 0, 0, len(text), text
        return
    for at in range(0, len(text), SEGMENT):
        low = max(0, at - margin)
        yield low, at, min(len(text), at + SEGMENT), text[low : at + SEGMENT + margin]


def _grouped(column: pa.Array, thresholds: tuple[int, ...]) -> Iterator[tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]]:
    """Texts put end to end up to SEGMENT bytes: (row, offset, first and last own place) of
    each piece, bytes, ends."""
    own, held, size = [], [], 0

    def out():
        return own, np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(x) for x in held])

    for row, text in enumerate(column):
        raw = text.as_buffer() if text.is_valid else None
        if raw is None or raw.size < thresholds[0]:
            continue
        for at, lo, hi, piece in _pieces(raw.to_pybytes(), 2 * thresholds[-1]):
            if held and size + len(piece) > SEGMENT:
                yield out()
                own, held, size = [], [], 0
            own.append((row, at, lo, hi))
            held.append(piece)
            size += len(piece)
    if held:
        yield out()


def _owned(own: list[tuple[int, int, int, int]], a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which anchors a piece may speak for, and the rows and places in the text of all."""
    row, at, lo, hi = (np.array(x, dtype=np.int64)[a.text] for x in zip(*own, strict=True))
    pos = a.places - a.begins[a.text] + at
    return (pos >= lo) & (pos < hi), row, pos


def _find_anchors(thresholds: tuple[int, ...]):
    names = ["doc_id", "text_hash", "pos", "anchor", *(f"wide{k}" for k in range(len(thresholds)))]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, ends in _grouped(batch.column(2), thresholds):
                a = Anchors(data, ends, thresholds[0])
                mine, row, pos = _owned(own, a)
                wides = []
                for t in thresholds:
                    lo, hi = a.windows(t)
                    wides.append(pa.array(a.surroundings(t)[mine].view(np.int64), mask=(lo > hi)[mine]))
                take = pa.array(row[mine])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos[mine]), pa.array(a.hashes[mine].view(np.int64)), *wides], names=names)

    return run


def steps_of(thresholds: tuple[int, ...]) -> list[tuple[int, int]]:
    """(threshold, step) by kind: twice the number of the threshold, one more if hot."""
    w = thresholds[0] - gram_of(thresholds[0]) + 1
    return [(t, min(s, w)) for t in thresholds for s in (STEP, HOT_STEP)]


class Lists:
    """A column of arrays of structs of whole numbers, as one array a field."""

    def __init__(self, column: pa.ListArray, *names: str):
        self.offsets = column.offsets.to_numpy()
        self.fields = [column.values.field(x).to_numpy(zero_copy_only=False) for x in names]

    def __getitem__(self, row: int) -> list[np.ndarray]:
        return [x[self.offsets[row] : self.offsets[row + 1]] for x in self.fields]


def _deeper(own: list[tuple[int, int, int, int]], sizes: list[int], runs: Lists, thresholds: tuple[int, ...], level: int) -> np.ndarray:
    """How many windows before each place of texts put end to end may repeat at this depth:
    those of which every window of the depth before repeats."""
    more = thresholds[level] - thresholds[level - 1]
    out = []
    for (row, at, _, _), size in zip(own, sizes, strict=True):
        n = at + size
        total = np.concatenate(([0], np.cumsum(starts_of(n, runs[row], level - 1))))
        deep = np.zeros(n, dtype=np.int64)
        if n > more:
            deep[: n - more] = total[more + 1 :] - total[: n - more] == more + 1
        out.append(deep[at:])
    return np.concatenate(([0], np.cumsum(np.concatenate(out))))


def _cut_blocks(thresholds: tuple[int, ...], level: int):
    """(doc_id, text_hash, [(pos, flags)], runs of the level before, text) -> rows of window
    runs that repeat for sure (start to stop), and of blocks of windows around an anchor to
    be looked into."""
    names = ["doc_id", "text_hash", "kind", "start", "stop", "core1", "core2", "left", "right"]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = Lists(batch.column(2), "pos", "flags")
            runs = Lists(batch.column(3), *_RUN) if level else None
            rows_at, (places, flags) = listed.offsets, listed.fields
            span = int(places.max(initial=0)) + 1
            keys = np.repeat(np.arange(batch.num_rows), np.diff(rows_at)) * span + places[rows_at[0] : rows_at[-1]]
            order = np.argsort(keys)
            keys, flags = np.append(keys[order], -1), np.append(flags[rows_at[0] : rows_at[-1]][order], 0)
            for own, data, ends in _grouped(batch.column(4), thresholds):
                a = Anchors(data, ends, thresholds[0])
                mine, row, pos = _owned(own, a)
                here = row * span + pos
                at = np.searchsorted(keys[:-1], here)
                flag = np.where((keys[at] == here) & (pos < span), flags[at], 0)
                lanes = [a.prefix, _prefix(data, 1)]
                deep = _deeper(own, np.diff(ends, prepend=0).tolist(), runs, thresholds, level) if level else None
                raw = data.tobytes()
                offset = pos - a.places  # from places here to places in the text
                found: list[list[np.ndarray | list]] = [[] for _ in range(8)]

                def add(*cols, found=found):
                    for have, col in zip(found, cols, strict=True):
                        have.append(col)

                for kind in (2 * level, 2 * level + 1):
                    threshold, step = steps_of(thresholds)[kind]
                    lo, hi = a.windows(threshold)
                    bits = flag >> 3 * (kind // 2)
                    if not kind % 2:
                        some = np.flatnonzero(mine & (bits & 1 != 0) & (lo <= hi))
                        none = np.zeros(len(some), dtype=np.int64)
                        add(row[some], np.full(len(some), kind), lo[some] + offset[some], hi[some] + offset[some], none, none, [None] * len(some), [None] * len(some))
                    look = (bits & 2 != 0) & (lo <= hi) & ((bits & 4 != 0) == bool(kind % 2))
                    core, side = threshold - step + 1, step - 1
                    pairs = []
                    for j in range(-(-a.w // step) if look.any() else 0):
                        start = a.places - step * j
                        some = np.flatnonzero(look & (lo <= start) & (hi > start - step))
                        if deep is not None:
                            some = some[deep[np.minimum(hi[some], start[some]) + 1] > deep[np.maximum(lo[some], start[some] - step + 1)]]
                        pairs.append((some, start[some]))
                    if pairs:
                        some, s = (np.concatenate(x) for x in zip(*pairs, strict=True))
                        # two anchors may cut one block: the first of them does
                        order = np.lexsort((a.places[some], s + offset[some], row[some]))
                        some, s = some[order], s[order]
                        where = s + offset[some]
                        keep = np.concatenate(([True], (where[1:] != where[:-1]) | (row[some[1:]] != row[some[:-1]])))[: len(some)] & mine[some]
                        some, s = some[keep], s[keep]
                        h = [_hashes(p, s, s + core, k).view(np.int64) for k, p in enumerate(lanes)]
                        low, high = np.maximum(a.begins[a.text[some]], s - side).tolist(), np.minimum(a.ends[a.text[some]], s + core + side).tolist()
                        ss = s.tolist()
                        add(row[some], np.full(len(some), kind), s + offset[some], np.full(len(some), -1), *h, [raw[x:y] for x, y in zip(low, ss, strict=True)], [raw[y + core : z] for y, z in zip(ss, high, strict=True)])
                cols = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in found[:6]] + [[x for part in c for x in part] for c in found[6:]]
                for k in range(0, len(cols[0]), 20_000):
                    r, kind, start, stop, c1, c2, left, right = (c[k : k + 20_000] for c in cols)
                    take, block = pa.array(r), stop < 0
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(kind.astype(np.int32)), pa.array(start), pa.array(stop, mask=block), pa.array(c1, mask=~block), pa.array(c2, mask=~block), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=names)

    return run


_BLOCK = "doc_id bigint, text_hash bigint, kind int, start bigint, stop bigint, core1 bigint, core2 bigint, `left` binary, `right` binary"


def _in_order(group: np.ndarray, side: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte order of strings within their groups, and how many bytes each has in common
    with the one before (none with one of another group)."""
    n = len(side)
    rows = np.zeros((n, width + 2), dtype=np.uint8)  # bytes from 1 on, so an end differs from each
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in side), dtype=np.uint8).reshape(n, width)
    rows[:, :width] = flat
    length = np.array([len(x) for x in side])
    order = np.lexsort((rows[:, :width].copy().view(f"S{width}").ravel() if width else np.zeros(n), group)) if n else np.zeros(0, dtype=np.int64)
    same = np.zeros(n, dtype=np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        equal = flat[a] == flat[b] if width else np.ones((n - 1, 0), dtype=bool)
        run = np.where(equal.all(axis=1), width, equal.argmin(axis=1)) if width else np.zeros(n - 1, dtype=np.int64)
        same[1:] = np.where(group[a] == group[b], np.minimum(run, np.minimum(length[a], length[b])), -1)
    same[:1] = -1
    return order, same


def window_masks(group: np.ndarray, left: list[bytes], right: list[bytes], count: np.ndarray, side: int) -> np.ndarray:
    """For contexts of cores (equal ``group``: equal core): bit t is set if the window that
    takes t bytes from the left and ``side`` - t from the right stands elsewhere, too."""
    n = len(left)
    mask = np.zeros(n, dtype=np.int64)
    l_len, r_len = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    sides = []
    for strings in ([x[::-1] for x in left], right):
        order, same = _in_order(group, strings, side)
        sides.append((np.argsort(order), same))
    (l_place, l_same), (r_place, r_same) = sides
    for t in range(side + 1):
        fits = np.flatnonzero((l_len >= t) & (r_len >= side - t))
        # equal to depth: of one class in either order
        a = np.cumsum(l_same < t)[l_place[fits]]
        b = np.cumsum(r_same < side - t)[r_place[fits]]
        _, at, times = np.unique(a * (n + 1) + b, return_inverse=True, return_counts=True)
        again = (times[at] > 1) | (count[fits] > 1)
        mask[fits[again]] |= np.int64(1) << np.int64(t)
    return mask


def _compare(sides: list[int]):
    """Distinct contexts sorted by kind and core -> the same with their masks, where any bit
    is set."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def breaks(t: pa.Table) -> np.ndarray:
            k, c1, c2 = (t.column(i).to_numpy() for i in range(3))
            return np.concatenate(([True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (k[1:] != k[:-1])))

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(breaks(t))
            kind, count = t.column(0).to_numpy(), t.column(5).to_numpy()
            size = np.bincount(group)[group]
            for k in np.unique(kind).tolist():
                busy = np.flatnonzero(((size > 1) | (count > 1)) & (kind == k))
                if len(busy):
                    part = t.take(pa.array(busy))
                    mask = window_masks(group[busy], part.column(3).to_pylist(), part.column(4).to_pylist(), count[busy], sides[k])
                    part = part.drop_columns(["n"]).append_column("mask", pa.array(mask)).filter(pa.array(mask != 0))
                    yield from part.combine_chunks().to_batches(max_chunksize=20_000)

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 20_000:
                cut = int(np.flatnonzero(breaks(held))[-1])
                if cut:
                    yield from out(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from out(held)

    return run


def starts_of(n: int, runs: list[np.ndarray], level: int) -> np.ndarray:
    """Which of ``n`` places begin a repeated window: the level's ``runs`` (kind, start, stop,
    mask) are whole, or have a mask and a stop of -1."""
    mine = runs[0] // 2 == level
    start, stop, mask = (x[mine] for x in runs[1:])
    whole = stop >= 0
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, np.minimum(start[whole], n), 1)
    np.add.at(edge, np.minimum(stop[whole] + 1, n), -1)
    out = np.cumsum(edge[:n]) > 0
    some, t = np.nonzero(mask[~whole][:, None] >> np.arange(STEP) & 1)
    hit = start[~whole][some] - t
    out[hit[hit < n]] = True
    return out


def covered(n: int, runs: list[np.ndarray], threshold: int, level: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a repeated window of ``threshold`` bytes."""
    starts = np.flatnonzero(starts_of(n, runs, level))
    if not len(starts):
        return np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int32)
    gaps = np.flatnonzero(np.diff(starts) > threshold)
    edge[np.concatenate((starts[:1], starts[gaps + 1]))] = 1
    edge[np.concatenate((starts[gaps], starts[-1:])) + threshold] -= 1
    return np.cumsum(edge[:n]) > 0


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone``, and the other bytes of characters of which a byte goes."""
    if not (data & 0x80).any():
        return gone
    char = np.cumsum((data & 0xC0) != 0x80)
    return np.isin(char, char[gone])


def _keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), *more, F.encode(text, "utf-8").alias("bytes"))


def _same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


_RUN = ("kind", "start", "stop", "mask")
_RUNS = "array<struct<kind:int,start:bigint,stop:bigint,mask:bigint>>"


def repeated_runs(docs: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """doc_id, text_hash, runs: array of (kind, start, stop, mask) of repeated windows, for
    texts with any. ``thresholds`` are in rising order."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    wides = [f"wide{k}" for k in range(len(thresholds))]
    first = _keyed(docs).mapInArrow(_find_anchors(thresholds), "doc_id bigint, text_hash bigint, pos bigint, anchor bigint, " + ", ".join(f"{w} bigint" for w in wides))
    anchors = scratch.keep(first)
    again = scratch.keep(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    left = scratch.keep(anchors.join(again, "anchor", "left_semi"))
    scratch.drop(anchors)
    # flags by threshold: 1 all windows repeat, 2 to be looked into, 4 hot
    flags = F.lit(0)
    rows = left
    for k, w in enumerate(wides):
        place = F.struct("doc_id", "text_hash", "pos")
        full = scratch.keep(left.filter(F.col(w).isNotNull()).groupBy("anchor", w).agg(F.count("*").alias("n"), F.min(place).alias(f"least{k}")).filter("n > 1").drop("n"))
        rows = rows.join(full, ["anchor", w], "left")
        own = F.struct(rows["doc_id"], rows["text_hash"], rows["pos"])
        looked = F.col(w).isNotNull() & (F.col(f"least{k}").isNull() | own.eqNullSafe(F.col(f"least{k}")))
        flags = flags + F.when(F.col(f"least{k}").isNotNull(), 1 << 3 * k).otherwise(0) + F.when(looked, 2 << 3 * k).otherwise(0)
    flagged = scratch.keep(rows.select("doc_id", "text_hash", "pos", "anchor", flags.alias("flags")))
    looked = sum(2 << 3 * k for k in range(len(thresholds)))
    hot = scratch.keep(flagged.filter(F.col("flags").bitwiseAND(looked) != 0).groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor", F.lit(sum(4 << 3 * k for k in range(len(thresholds)))).alias("hot")))
    places = flagged.join(hot, "anchor", "left").withColumn("flags", F.col("flags") + F.coalesce("hot", F.lit(0)))
    places = scratch.keep(places.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "flags")).alias("places")))
    scratch.drop(left)
    scratch.drop(flagged)
    sides, done = F.xxhash64("left", "right"), []
    for level in range(len(thresholds)):
        texts = _keyed(docs)
        # suffixes alone at the depth before have dropped out
        before = places.join(done[-1], _same_text(places, done[-1])).select(places["doc_id"], places["text_hash"], "places", "runs") if done else places.withColumn("runs", F.lit(None).cast(_RUNS))
        with_places = texts.join(before, _same_text(texts, before)).select(texts["doc_id"], texts["text_hash"], "places", "runs", "bytes")
        blocks = scratch.keep(with_places.mapInArrow(_cut_blocks(thresholds, level), _BLOCK))
        look = blocks.filter("stop IS NULL")
        distinct = scratch.keep(look.groupBy("kind", "core1", "core2", "left", "right").agg(F.count("*").alias("n")))
        sorted_ = distinct.repartition("kind", "core1", "core2").sortWithinPartitions("kind", "core1", "core2")
        masks = scratch.keep(sorted_.mapInArrow(_compare([s - 1 for _, s in steps_of(thresholds)]), "kind int, core1 bigint, core2 bigint, `left` binary, `right` binary, mask bigint").select("kind", "core1", "core2", sides.alias("sides"), "mask"))
        scratch.drop(distinct)
        found = look.select("doc_id", "text_hash", "kind", "start", "core1", "core2", sides.alias("sides")).join(masks, ["kind", "core1", "core2", "sides"])
        found = found.select("doc_id", "text_hash", F.struct("kind", "start", F.lit(-1).cast("bigint").alias("stop"), "mask").alias("run"))
        sure = blocks.filter("stop IS NOT NULL").select("doc_id", "text_hash", F.struct("kind", "start", "stop", F.lit(0).cast("bigint").alias("mask")).alias("run"))
        done.append(scratch.keep(found.unionByName(sure).groupBy("doc_id", "text_hash").agg(F.collect_set("run").cast(_RUNS).alias("runs"))))
        scratch.drop(blocks)
        scratch.drop(masks)
    scratch.drop(places)
    if len(done) == 1:
        return done[0]
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return scratch.keep(every.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def _with_runs(docs: DataFrame, thresholds: tuple[int, ...], *more: str) -> DataFrame:
    texts, runs = _keyed(docs, *more), repeated_runs(docs, thresholds)
    return texts.join(runs, _same_text(texts, runs), "left").select(texts["doc_id"], *more, "runs", "bytes")


def repeated(docs: DataFrame, threshold: int = THRESHOLD, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row of ``docs``; then
    ``text``, what is left without the strings of ``passage`` bytes that repeat (whole
    characters), and n_passage_bytes, the bytes cut from it."""
    thresholds = tuple(sorted({threshold, passage}))
    span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.string(), pa.int64()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text", "n_passage_bytes"]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                rows, lists, found = [], Lists(batch.column(1), *_RUN), batch.column(1).is_valid().to_pylist()
                for k, raw in enumerate(batch.column(2)):
                    raw = raw.as_py()
                    spans, kept, text = [], raw, raw
                    if found[k]:
                        data, runs = np.frombuffer(raw, dtype=np.uint8), lists[k]
                        gone = covered(len(raw), runs, threshold, thresholds.index(threshold))
                        spans, kept = spans_of(gone), data[~gone].tobytes()
                        text = data[~whole_characters(data, covered(len(raw), runs, passage, thresholds.index(passage)))].tobytes()
                    rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"first": a, "end": b} for a, b in spans], text.decode("utf-8"), len(raw) - len(text)))
                cols = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return _with_runs(docs, thresholds).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first:bigint,end:bigint>>, text string, n_passage_bytes bigint")


def strip_repeats(docs: DataFrame, threshold: int = PASSAGE) -> DataFrame:
    """``docs`` with repeated strings cut from text and n_chars counted anew. A character
    goes as a whole if any of its bytes goes; a null text stays null."""
    names = docs.columns

    @F.arrow_udf("string")
    def cut(raw: pa.Array, runs: pa.Array) -> pa.Array:
        out, lists = [], Lists(runs, *_RUN)
        for k, r in enumerate(raw):
            r = r.as_py()
            if runs[k].is_valid:
                data = np.frombuffer(r, dtype=np.uint8)
                r = data[~whole_characters(data, covered(len(r), lists[k], threshold, 0))].tobytes()
            out.append(r.decode("utf-8"))
        return pa.array(out, pa.string())

    others = [F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]
    row = F.struct(F.struct(F.lit(0).alias("_"), *others).alias("others"), F.col("text").isNull().alias("no_text"))
    packed = docs.select("doc_id", "text", row.alias("__row"))
    out = _with_runs(packed, (threshold,), "__row").select("doc_id", "__row", cut("bytes", "runs").alias("text"))
    text = F.when(~F.col("__row.no_text"), F.col("text"))
    col = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("bigint")}
    return out.select(*((col[c] if c in col else F.col("__row.others").getField(c)).alias(c) for c in names))
