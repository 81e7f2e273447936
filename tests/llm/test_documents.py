"""Operators on documents against brute force, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bulletin.llm import bpe, langid, licences, packing, partenum, suffixes, tokens

#: Nulls, empty and blank texts, ties, repeated rows and ids, other scripts, no word ends.
ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "12 34 !?", "en"), (None, "the cat sat on the mat", "en"), (5, "the cat sat on the mat", None),
    (5, "the cat sat on the mat", None), (5, "another text with that very id", "en"), (6, "é ü 漢字 🙂   x", "fr"), (7, "x" * 5000, "en"), (8, "a b " * 4000, "de"), (9, "<|endoftext|> a<|endoftext|>", "en"),
]
COLUMNS = "doc_id bigint, text string, lang string, bytes string, n int, a string, words string, blocks int, component_id string, text_hash string, v int, `a.b` int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 1, "x", "y", 2, "z", "h", 3, 4) for r in rows], COLUMNS).repartition(parts)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [], 1)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_language_id_held_out_accuracy(documents):
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents.count() and len(held) > 40
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_learns_from_allowed_rows_only(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "x" if i % 2 else "y") for i in range(200)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    wrong = [(i, t, "bad") if (i, t, lang) in held else (i, t, lang) for i, t, lang in rows]
    assert {r.lang_pred for r in langid.identify(frame(spark, wrong)).collect()} == {"x", "y"}


def test_language_id_odd_rows(odd, none, spark):
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd).collect()}
    assert {(1, True), (2, True), (3, True), (4, True), (5, False), (6, False)} <= got
    assert langid.identify(none).collect() == []
    unlabelled = frame(spark, [(1, "some text", None)])
    assert [(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def test_backoff_uses_shorter_grams():
    m = langid.Model({"x": {"hello": 3}, "y": {"bonjour": 3}}, longest=3)
    assert m.score_word("hello").argmax() == 0 and m.score_word("bonj").argmax() == 1
    assert not m.score_word("zz").any()


def digests(text, enc):
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("max_words", [bpe.MAX_WORDS, 5])
def test_byte_bpe_is_tiktoken_and_round_trips(odd, none, documents, max_words):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokens.default_pattern(), mergeable_ranks=tokens.load_ranks(tokens.default_path("byte_bpe_50k.tiktoken")), special_tokens={})
    same([tuple(r) for r in bpe.byte_bpe(odd, max_words=max_words).collect()], [(i, *digests(t, enc)) for i, t, _ in ODD])
    some = documents.filter("doc_id < 40").select("doc_id", "text")
    same([tuple(r) for r in bpe.byte_bpe(some, max_words=max_words).collect()], [(i, *digests(t, enc)) for i, t in some.collect()])
    assert bpe.byte_bpe(none).collect() == []


@pytest.mark.parametrize("shared_words", [0, 7])
def test_byte_bpe_of_long_words_and_any_dictionary(spark, shared_words):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokens.default_pattern(), mergeable_ranks=tokens.load_ranks(tokens.default_path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("theanorin é漢acgt") for _ in range(n)).replace(" ", "") + " the end the end", None) for i, n in enumerate([1, 30, 511, 513, 700, 3000, 40_000])]
    same([tuple(r) for r in bpe.byte_bpe(frame(spark, rows), shared_words=shared_words).collect()], [(i, *digests(t, enc)) for i, t, _ in rows])
    assert bpe.merge_long(b"acgt" * 50_000, tokens.load_ranks(tokens.default_path("byte_bpe_50k.tiktoken")))



def brute_scan(text, phrases):
    words = licences._WORD.findall((text or "").encode().lower())
    places = [(i, label) for phrase, label in phrases.items() for p in [phrase.encode().split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def test_license_scan_finds_every_phrase(spark, odd, none):
    rng = random.Random(1)
    vocab = "gnu general public license apache mit cc by the of x gnu, (GENERAL) Licensed under 4 0".split()
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))), None) for i in range(300)] + ODD
    got = licences.license_scan(frame(spark, rows)).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(i, *brute_scan(t, licences.PHRASES)) for i, t, _ in rows])
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licences.license_scan(none).collect() == []


def test_license_spans_chain_over_small_changes():
    a = licences.Automaton(licences.TEMPLATES, licences.PHRASES)
    text = "x y Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: z"
    _, spans = licences.scan(licences.words_of(text), a)
    assert [(a.strings[t][0], first, last) for t, first, last, _ in spans] == [("bsd", 2, 23)]
    assert licences.scan(licences.words_of("permission is hereby granted to leave"), a) == ([], [])


def test_matching_statistics_are_longest():
    rng = random.Random(2)
    strings = [("t", " ".join(rng.choice("abc") for _ in range(12))) for _ in range(4)]
    a = licences.Automaton(strings, {})
    subs = {tuple(s.split()[i:j]) for _, s in strings for i in range(12) for j in range(i + 1, 13)}
    text = [rng.choice("abcd") for _ in range(300)]
    ids = [a.words.get(w.encode(), -1) for w in text]
    want = [max((n for n in range(1, 13) if n <= i + 1 and tuple(text[i - n + 1 : i + 1]) in subs), default=0) for i in range(len(text))]
    assert [n for _, n in a.statistics(ids)] == want


def brute_jaccard(rows):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def near_rows(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage, family = ([rng.choice(vocab) for _ in range(m)] for m in (40, 100))
    rows = []
    for i in range(n):
        kind, w = rng.random(), [rng.choice(vocab) for _ in range(int(2 ** rng.uniform(0, 8)))]
        if kind < 0.3:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        elif kind < 0.5:
            w = list(family)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.8 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w.insert(rng.randrange(len(w) + 1), rng.choice(vocab))
            w = w[: max(1, int(len(w) * rng.choice([1, 1, 0.9, 0.76])))]
        rows.append((100 + i, " ".join(w), None))
    return rows


@pytest.mark.parametrize("small_group", [partenum.SMALL_GROUP, 2])
def test_jaccard_join_is_brute_force(spark, small_group):
    rows = near_rows(3, 250) + ODD
    same([tuple(r) for r in partenum.jaccard_join(frame(spark, rows), small_group=small_group).collect()], brute_jaccard(rows))


def test_jaccard_join_in_small_cells_is_brute_force(spark):
    rows = near_rows(8, 150) + ODD
    same([tuple(r) for r in partenum.jaccard_join(frame(spark, rows), small_group=2, block=3).collect()], brute_jaccard(rows))


def test_share_of_the_sample_does_not_fall(spark, monkeypatch):
    monkeypatch.setattr(partenum, "SAMPLE_DOCS", 10)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(14))
    for own in (9, 60):  # sets of single features and of parts
        docs = frame(spark, [(i, passage + "".join(f" w{rng.randrange(10**9)}" for _ in range(own)), None) for i in range(800)])
        common = partenum._common_signatures(docs, 800, partenum.WORDS)
        s = partenum.shingles(passage)
        if own == 9:
            assert all(common.of(partenum.parts(s, band)[0]).all() for band in (4,))
        a, b = (partenum.shingles(r.text) for r in docs.select("text").limit(2).collect())
        assert not set(partenum.signatures(a, len(a).bit_length() - 1, common)) & set(partenum.signatures(b, len(b).bit_length() - 1, common))


def test_cells_hold_what_may_meet(spark):
    rng = random.Random(6)
    size = {m: int(20 * 2 ** rng.uniform(0, 5)) for m in range(400)}
    groups = [list(range(f, f + 20)) for f in range(0, 400, 20)] + [list(range(k, 400, 20)) for k in range(0, 20, 4)]
    rest = spark.createDataFrame([(g, m, m, min(ms)) for g, ms in enumerate(groups) for m in ms], "sig bigint, member bigint, component bigint, lead bigint")
    shapes = spark.createDataFrame(list(size.items()), "member bigint, size bigint").select("member", partenum.size_class("size").alias("class"))
    cells = partenum._cells(rest, shapes, 8)
    rows = partenum._sides(partenum._units(rest, cells), cells).collect()
    one, two = ({(r.cell, r.cell2, r.member) for r in rows if r[side]} for side in ("one", "two"))
    units = {(r.cell, r.cell2) for r in rows}
    met = {(a, b) for c in units for a in (m for m in size if (*c, m) in one) for b in (m for m in size if (*c, m) in two)}
    for ms in groups:
        for a in ms:
            for b in ms:
                if a != b and 75 * max(size[a], size[b]) <= 100 * min(size[a], size[b]):
                    assert (a, b) in met or (b, a) in met
    kind = {m: int(math.log(n) / math.log(partenum.SIZE_STEP)) for m, n in size.items()}
    assert all(abs(kind[a] - kind[b]) <= 1 for a, b in met)  # whole families were compared
    assert {(r.member, r.component) for r in rows} == {(m, m) for m in size}


def test_jaccard_join_of_nothing(none):
    assert partenum.jaccard_join(none).collect() == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 5, 8, 31, 32, 33, 60, 64, 100, 129, 500]:
        for _ in range(30):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            union = len(a)
            drop = int(rng.integers(0, n // 4 + 1))
            b = a[drop:]
            extra = rng.integers(0, 2**63, max(0, int(len(b) / 0.75) - union), dtype=np.uint64)
            b = np.unique(np.concatenate((b, extra)))
            a = np.unique(a)
            inter = len(np.intersect1d(a, b))
            if 100 * inter < 75 * (len(a) + len(b) - inter):
                continue
            common = partenum.Common(rng.choice(np.concatenate([partenum.parts(a, k)[0] for k in partenum.bands_of(len(a))]), 3))
            sa, sb = (set(np.concatenate([partenum.signatures(s, k, common) for k in partenum.bands_of(len(s))]).tolist()) for s in (a, b))
            assert sa & sb


def brute_repeats(rows, n):
    counts = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        counts.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - n + 1):
            if counts[b[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), len(suffixes.spans_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows(seed, n):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(3 * n))
    rows = []
    for i in range(50):
        t = "".join(rng.choice("abcdefgh ü\n") for _ in range(rng.randint(0, 6 * n)))
        if i % 3 == 0:
            k = rng.randint(0, 2 * n)
            t = t[: len(t) // 2] + base[k : k + rng.randint(n - 5, n + 60)] + t[len(t) // 2 :]
        if i % 10 == 1:
            t = rng.choice(rows)[1]
        rows.append((100 + i, t, None))
    return rows


@pytest.mark.parametrize("n", [400, 40, 7, 1])
def test_suffix_dedup_is_brute_force(spark, n):
    rows = repeat_rows(n, n) + ODD
    same([tuple(r)[:5] for r in suffixes.repeated(frame(spark, rows), n, n).collect()], brute_repeats(rows, n))


@pytest.mark.parametrize(("segment", "hot"), [(150, 2000), (1 << 20, 1)])
def test_suffix_dedup_of_long_texts_and_hot_anchors(spark, monkeypatch, segment, hot):
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (90, 60, 45, 300)]
    rows = [(i, "".join(rng.choice([*parts, "xyz", "q", "".join(rng.choice("abc") for _ in range(30))]) for _ in range(1 + i % 9)), "x") for i in range(60)]
    rows += [(100, "ab" * 700, "x"), (101, "a" * 900, "x"), (102, "".join(rng.choice("abc") for _ in range(2000)), "x")]
    got = suffixes.repeated(frame(spark, rows), 40, 30).collect()
    same([tuple(r)[:5] for r in got], brute_repeats(rows, 40))
    cut = {i: removed for i, _, removed, *_ in brute_repeats(rows, 30)}
    assert all(r.n_passage_bytes == cut[r.doc_id] and len(r.text) == r.n_bytes - r.n_passage_bytes for r in got)


def test_anchors_know_all_windows_of_single_texts():
    """Every window of a text, alone or among others, has an anchor that holds it."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        sizes = rng.integers(30, 400, rng.integers(1, 4))
        data = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
        ends = np.cumsum(sizes)
        a = suffixes.Anchors(data, ends, 40)
        for threshold in (40, 55):
            lo, hi = a.windows(threshold)
            held = set().union(*(range(x, y + 1) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)))
            want = {i for b, e in zip(a.begins.tolist(), ends.tolist(), strict=True) for i in range(b, e - threshold + 1)}
            assert held == want


def test_passages_of_51_words_go_from_all_documents(spark, sf_dir):
    """Whatever passage of over 50 words two documents share, nothing of it is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(6)
    words = sorted({w for r in docs.collect() if r.text for w in r.text.split()})
    planted = [" ".join(rng.choice(words) for _ in range(51)) for _ in range(12)]
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{own(40)} {planted[i % 12]} {own(30)}", "x") for i in range(48)] + [(100 + i, own(150), "x") for i in range(20)]
    for texts in ([r.text for r in suffixes.repeated(frame(spark, rows)).select("doc_id", "text").orderBy("doc_id").collect()], [r.text for r in suffixes.strip_repeats(frame(spark, rows)).orderBy("doc_id").collect()]):
        assert not any(" ".join(p.split()[k : k + 8]) in t for p in planted for k in range(0, 44, 4) for t in texts)
        assert texts[48:] == [t for _, t, _ in rows[48:]]
        assert all(t.startswith(x[:150]) for t, (_, x, _) in zip(texts, rows, strict=True))


def test_strip_repeats_keeps_columns_and_characters(spark, odd):
    rows = repeat_rows(6, 40) + ODD
    docs = frame(spark, rows)
    got = suffixes.strip_repeats(docs, 40)
    assert got.columns == docs.columns
    want = {(i, sha) for i, *_, sha in brute_repeats([(i, t, x) for i, t, x in rows if t is None or t.isascii()], 40)}
    out = [(r.doc_id, r.text) for r in got.collect()]
    assert len(out) == len(rows) and (1, None) in out
    plain = [(i, t) for i, t, _ in rows if t is not None and t.isascii() and not any(t[k : k + 40] in (o or "") for k in range(len(t) - 39) for _, o, _ in rows if o is not t)]
    assert all((i, t) in out for i, t in plain if len(t) < 40)
    assert want


def test_suffix_dedup_of_nothing(none):
    assert suffixes.repeated(none).collect() == [] and suffixes.strip_repeats(none).collect() == []


def test_packing_matches_the_tokenizer_and_is_whole(documents, odd, none):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = [*enc.encode(r.text or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, dtype="<u4").tobytes()
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.best_fit_packing(docs).collect()
    same([tuple(r)[:5] for r in got], want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 1024) + 5
    assert packing.best_fit_packing(none).collect() == []


def test_best_fit_takes_the_tightest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(map(sorted, bins)) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit(np.array([], dtype=int), 10) == []
