"""Fill-in-middle transformation with run-length classes (operator 11).

A text is a sequence of maximal runs of characters of one class, the class being the bytes
a character takes in UTF-8. With each run stand its first byte and the characters before
it, so the byte of any cut is found by a binary search for its run and one multiplication:
nothing is decoded and no character is counted twice. The runs of a whole Arrow batch are
one table, as each text begins a run.

A text falls in prefix, middle and suffix at two cuts; it is laid out as
``<P>``prefix``<S>``suffix``<M>``middle (psm), as ``<S>``suffix``<P>``prefix``<M>``middle (spm) or left
plain. A plain share of the texts, empty ones and those that hold a marker stay plain, so
a layout can be undone: no marker can arise across a seam, since none begins with the
character another ends with. Cuts and forms follow from a digest of seed and id.

Memory: bytes are scanned in blocks, so a batch costs its text, its output and its runs.

Defined cases: a null text is empty; a null id is digested as the empty string; repeated
rows come out as often as they occur, alike if id and text are; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred texts so many stay plain, and of the others so many take the form spm.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes scanned at a time.
BLOCK = 1 << 20

_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Runs:
    """Maximal runs of characters of one width in ``data``; each of ``starts`` begins one."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, block: int = BLOCK):
        size = len(data)
        first = np.unique(starts[starts < size])
        at, width = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        done, last = 0, 0
        while done < size:
            stop = done + block
            while stop < size and data[stop] & 0xC0 == 0x80:  # not inside a character
                stop += 1
            stop = min(stop, size)
            begins = data[done:stop] & 0xC0 != 0x80
            begins[0] = True
            texts = first[np.searchsorted(first, done) : np.searchsorted(first, stop)] - done
            begins[texts] = True
            lead = np.flatnonzero(begins)
            wide = np.diff(lead, append=stop - done)
            new = np.concatenate(([True], wide[1:] != wide[:-1]))
            new[np.searchsorted(lead, texts)] = True
            if wide[0] == last and not (len(texts) and texts[0] == 0):
                new[0] = False  # the run before goes on
            last = wide[-1]
            at.append(lead[new] + done)
            width.append(wide[new])
            done = stop
        #: first byte, bytes a character, characters before; with an end behind the last run
        self.at = np.append(np.concatenate(at), size)
        self.width = np.append(np.concatenate(width), 1)
        self.before = np.concatenate(([0], np.cumsum(np.diff(self.at) // self.width[:-1])))

    def units(self, byte: np.ndarray) -> np.ndarray:
        """Characters before ``byte``, where a run begins or all end."""
        return self.before[np.searchsorted(self.at, byte)]

    def byte(self, unit: np.ndarray) -> np.ndarray:
        """The byte at which character ``unit`` begins."""
        run = np.searchsorted(self.before, unit, side="right") - 1
        return self.at[run] + (unit - self.before[run]) * self.width[run]


def lay_out(texts: pa.Array, draws: list[np.ndarray], plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: characters, form, characters of prefix and middle, output."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, held = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    low, high = int(places[0]), int(places[-1])
    data = np.frombuffer(held, np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
    start, stop = places[:-1] - low, places[1:] - low
    runs = Runs(data, start)
    base = runs.units(start)
    n = runs.units(stop) - base
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    a, b = np.minimum(one, two), np.maximum(one, two)
    marked = np.zeros(len(texts), bool)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (draws[2] % 100 >= 100 - plain_percent)
    spm = ~plain & (draws[3] % 100 < spm_percent)
    form = np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist()
    whole = data.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for kind, i, j, k, z in zip(form, start.tolist(), runs.byte(base + a).tolist(), runs.byte(base + b).tolist(), stop.tolist(), strict=True):
        if kind == "plain":
            out.append(whole[i:z])
        elif kind == "psm":
            out.append(b"".join((p, whole[i:j], s, whole[k:z], m, whole[j:k])))
        else:
            out.append(b"".join((s, whole[k:z], p, whole[i:j], m, whole[j:k])))
    return n, form, a, b - a, out


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) laid out: doc_id, n, form, prefix_chars,
    middle_chars (null if plain) and output."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [batch.column(k).to_numpy() for k in range(2, 6)]
            n, form, prefix, middle, out = lay_out(batch.column(1), draws, plain_percent, spm_percent)
            no = np.array([f == "plain" for f in form], bool)
            rows = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64(), mask=no), pa.array(middle, pa.int64(), mask=no), pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(rows, schema=_OUT)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", digest.alias("digest")).select("doc_id", "text", *drawn)
    return rows.mapInArrow(run, _DDL)


def restore(form: Column, output: Column) -> Column:
    """The text that was laid out."""
    after = F.length(output)
    p, s = F.locate(PREFIX, output), F.locate(SUFFIX, output)
    m_of_psm, m_of_spm = (F.position(F.lit(MIDDLE), output, at + len(MIDDLE)) for at in (s, p))
    psm = F.concat(F.substring(output, F.lit(4), s - 4), F.substring(output, m_of_psm + 3, after), F.substring(output, s + 3, m_of_psm - s - 3))
    spm = F.concat(F.substring(output, p + 3, m_of_spm - p - 3), F.substring(output, m_of_spm + 3, after), F.substring(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
