"""Fill-in-middle, collocations and document fingerprints against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bulletin.llm import collocations, fim, lzprint
from bulletin.llm.common import Scratch

COLUMNS = "doc_id bigint, text string, lang string, n int, a bigint, h bigint, place string, key string, form string, phrase string, rank int, `a.b` int"
ODD = [
    (1, None, None), (2, "", "en"), (3, "<P>", "en"), (4, "a<S>b", "en"), (5, "<<M>", "und"), (None, "the cat sat on the mat", "en"), (5, "the cat sat on the mat", None), (5, "the cat sat on the mat", None),
    (5, "another text with that very id", "en"), (6, "é ü 漢字 🙂   x<", "fr"), (7, "x" * 5000, "en"), (8, "a B " * 4000, "de"), (9, "<" * 50, "en"), (10, "é", "fr"), (11, "🙂🙂a漢漢漢", "fr"), (None, None, None),
]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, "p", "k", "f", "x", 4, 5) for r in rows], COLUMNS).repartition(parts)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ------------------------------------------------------------------------- fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", text
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", text


def test_fill_in_middle_is_brute_force_and_undone(spark):
    rng = random.Random(4)
    rows = ODD + [(i, "".join(rng.choice("ab é漢🙂<PSM>") for _ in range(rng.randint(0, 80))), None) for i in range(20, 400)]
    got = fim.fill_in_middle(frame(spark, rows)).withColumn("text", fim.restore(F.col("form"), F.col("output")))
    found = [tuple(r) for r in got.collect()]
    same(found, [brute_middle(i, t) for i, t, _ in rows])
    assert {"plain", "psm", "spm"} == {r[2] for r in found}
    assert fim.fill_in_middle(frame(spark, [], 1)).collect() == []


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_runs_are_maximal_and_find_every_cut(block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab") if rng.random() < 0.8 else rng.choice("é漢🙂") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    data = "".join(texts).encode()
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    runs = fim.Runs(np.frombuffer(data, np.uint8), starts[:-1], block)
    unit = 0
    for t, start in zip(texts, starts.tolist(), strict=False):
        assert runs.units(np.array([start]))[0] == unit
        assert runs.byte(np.arange(unit, unit + len(t))).tolist() == [start + len(t[:k].encode()) for k in range(len(t))]
        unit += len(t)
    inner = set(runs.at.tolist()) - set(starts.tolist())
    width = dict(zip(runs.at.tolist(), runs.width.tolist(), strict=True))
    assert all(width[b] != width[max(x for x in width if x < b)] for b in inner)


def test_bytes_that_are_no_text_come_through():
    import pyarrow as pa

    odd = pa.array([b"a\xff\xfeb\xc3", b"\x80\x80", b"ok"], pa.binary()).view(pa.string())
    n, form, a, m, out = fim.lay_out(odd, [np.array([1, 1, 1]), np.array([2, 2, 2]), np.zeros(3, np.int64), np.full(3, 50)])
    assert [len(o) for o in out] == [5 + 9, 2 + 9, 2 + 9]


# ------------------------------------------------------------------------- collocations


def brute_phrases(rows, longest=5, least=100, top=2000, percent=100):
    counts, total, out = Counter(), Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        small = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i : i + m])] += 1
    often = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    for (lang, w), a in often.items():
        if any(g == lang and len(x) > len(w) and 100 * b >= percent * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (g, x), b in often.items()):
            continue
        score, _, left, right = min((1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, total[lang], score))
    found = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(r[0], k, *r[1:]) for k, r in enumerate(own[:top], 1)]
    return found


def sentences(seed, n):
    rng = random.Random(seed)
    words = "the of and cat Sat on é 漢 \x00 x. a, b! mat\tin  hat\n far".split(" ")
    return ODD + [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None])) for i in range(n)]


@pytest.mark.parametrize(("size", "bits", "percent"), [(1 << 20, 27, 100), (50, 3, 100), (5, 12, 60), (1, 12, 100)])
def test_collocations_are_brute_force_at_any_shard_size(spark, size, bits, percent):
    rows = sentences(size, 150)
    got = collocations.collocations(frame(spark, rows), least=4, top=40, percent=percent, size=size, bits=bits).collect()
    want = brute_phrases(rows, least=4, top=40, percent=percent)
    assert len(want) > 60
    same([tuple(r) for r in got], want)


def test_collocations_of_nothing_and_of_a_long_text(spark):
    assert collocations.collocations(frame(spark, [], 1)).collect() == []
    assert collocations.collocations(frame(spark, ODD[:5])).collect() == []
    rows = [(1, "one two three " * 3000, "en"), (2, "w " * 400, "en")]
    for size in (64, 1 << 20):
        same([tuple(r) for r in collocations.collocations(frame(spark, rows), size=size).collect()], brute_phrases(rows))


def test_a_shard_is_small_where_spark_holds_it(spark):
    rng = np.random.default_rng(1)
    words = np.minimum(rng.zipf(1.3, 60_000), 20_000)
    docs = frame(spark, [(k, " ".join(f"w{x}" for x in words[k::6]) + ".", "en") for k in range(6)], 1)
    found = Scratch(spark, "shards").keep(collocations.shards(docs, size=1 << 13), **collocations.ALONE)
    rows = found.select("lang", "overlap", "words", "n", "ids").toArrow()
    assert rows.num_rows > 4
    assert all(len(x) < 2 * n for x, n in zip(rows["ids"].to_pylist(), rows["n"].to_pylist(), strict=True))
    seen = Counter()
    for _, overlap, names, ids in collocations.rows_of(rows.to_batches()):
        seen.update(f"{names[int(i) - 1]}" for i in ids[overlap:] if i)
    assert seen == Counter(f"w{x}" for x in words)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in found.inputFiles()]
    assert {g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)} == {1}


def test_keys_are_gathered_in_little_memory(monkeypatch):
    n = 1 << 18
    monkeypatch.setattr(collocations, "PENDING", n)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 40, n, dtype=np.uint64)
    keys[: n // 4] = keys[n // 4 : n // 2]  # some twice
    counts = rng.integers(-1, 1 << 20, n)
    want = Counter()
    for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
        want[k] += c
    blocks, batches = collocations.Blocks(50), []
    tracemalloc.start()
    for at in range(0, n, n // 4):
        for batch in blocks.add(keys[at : at + n // 4].copy(), counts[at : at + n // 4].copy()):
            batches.append(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for part, ks, cs in (row for batch in batches for row in zip(*batch.to_pydict().values(), strict=True)):
        ks = collocations.unpacked(ks)
        assert set((ks * np.uint64(50) >> np.uint64(40)).tolist()) == {part}
        got |= dict(zip(ks.tolist(), np.frombuffer(cs, "<i4").tolist(), strict=True))
    assert got == dict(want)
    assert max(batch.nbytes for batch in batches) < n
    assert peak < 44 * n, peak / n


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**16
    words = spark.createDataFrame([("en", "x", 3 * big), ("en", "y", big + 7)], "lang string, phrase string, a bigint")
    pair = spark.createDataFrame([("en", "x y", big + 1, 2)], "lang string, phrase string, a bigint, m int")
    (row,) = collocations.scored(words, pair, spark.createDataFrame([("en", 9 * big + 5)], "lang string, n bigint")).collect()
    assert row.score == 1000 * (big + 1) * (9 * big + 5) // (3 * big * (big + 7))


@pytest.mark.parametrize("depth", [2, 3, 4, 5, 7])
def test_suffix_order_is_that_of_the_phrases(depth):
    rng = np.random.default_rng(depth)
    ids = rng.integers(0, 4, 400).astype(np.int32)
    joined = np.append((ids[1:] > 0) & (ids[:-1] > 0), False)
    room = collocations.room_of(joined)
    room[ids == 0] = 0
    order, common = collocations.suffix_order(ids, room, depth)
    cut = lambda i: tuple(ids[i : i + min(room[i], depth)].tolist())
    assert [cut(i) for i in order] == sorted(cut(i) for i in range(400) if room[i] >= 2)
    agree = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert common[1:].tolist() == [agree(cut(i), cut(j)) for i, j in pairwise(order)]


# ------------------------------------------------------------------------- fingerprints


def brute_set(data, phrases=1 << 30):
    """The definition: the shortest string that isn't known yet is a phrase."""
    known, out, start = set(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            out.add(data[start:end])
            start = end
    return out


def brute_likeness(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def brute_neighbours(spark, rows):
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(bytes((t or "").encode()) if t is not None else None,) for _, t, _ in rows], "t binary").select("t", F.xxhash64("t")).collect() for r in [(None if r[0] is None else bytes(r[0]), r[1])]}
    at = lambda r: (-(r[0] if r[0] is not None else -(2**63)), hashed[None if r[1] is None else r[1].encode()], (r[1] or "").encode())
    ordered = sorted(rows, key=at)
    out = []
    for (i, t, _), (_, following, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, following = t or "", following or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        sets = [brute_set(x.encode()) for x in (t, edited, following)]
        out.append((i, len(t), edited, round(brute_likeness(sets[0], sets[1]), 9), round(brute_likeness(sets[0], sets[2]), 9)))
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 60])
def test_fingerprints_are_brute_force_in_any_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = ODD + [(rng.choice([i, i, 77]), " ".join(rng.choice("the of and cat sat é 漢 mat".split()) for _ in range(rng.randint(0, 30))), None) for i in range(100)]
    got = lzprint.against_neighbours(frame(spark, rows), k=100_000, ranges=ranges).collect()
    same([(r.doc_id, r.n_chars, r.edited_text, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], brute_neighbours(spark, rows))
    plain = {(r.doc_id, r.fingerprint) for r in lzprint.fingerprints(frame(spark, rows), k=100_000).collect()}
    assert {(r.doc_id, r.fingerprint) for r in got} == plain


def test_a_hot_id_is_dealt_to_many_ranges():
    key, h = np.full(1000, 5), np.linspace(0, 1, 1000, endpoint=False)
    assert len(set(lzprint.places_of(key, h, np.array([9.0, 5, 5, 5, 5, 1])).tolist())) == 5
    key = np.array([10, 9, 8, 5, 5, 4, 1, 0])
    found = lzprint.places_of(key, np.array([0, 0.99, 0, 0, 0.99, 0, 0.99, 0]), np.array([9.0, 5, 5, 1]))
    assert found.tolist() == sorted(found.tolist())


def test_fingerprints_tell_copies_edits_and_others_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lzprint.against_neighbours(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    prints = {}
    assert all(prints.setdefault(r.text, r.fingerprint) == r.fingerprint for r in got)
    long = [r for r in got if r.n_chars > 300]
    assert min(r.near_edited for r in long) > max(r.near_next for r in long if r.near_next < 0.9)
    assert lzprint.against_neighbours(frame(spark, [], 1)).collect() == []


def test_signatures_estimate_the_share(spark):
    rng = random.Random(8)
    a = " ".join(str(rng.random()) for _ in range(2000))
    b = a[: len(a) // 2] + " ".join(str(rng.random()) for _ in range(1000))
    exact = brute_likeness(brute_set(a.encode()), brute_set(b.encode()))
    assert abs(lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b)) - exact) < 0.12
    small = lzprint.fingerprint(a, phrases=50)  # a dictionary that is begun afresh many times
    assert np.array_equal(small, lzprint.fingerprint(a, phrases=50)) and len(small) == lzprint.K
