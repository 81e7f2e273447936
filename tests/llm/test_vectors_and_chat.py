"""Operators on embeddings, conversations and token counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulletin.llm import ann, chat, components, rollup, topk
from bulletin.llm.common import Scratch

INF, NAN = float("inf"), float("nan")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "vec_id bigint, embedding array<float>, label int, rep string, v int, key string").repartition(3)


def odd_rows():
    return [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [1.0] * 7 + [None], 1), (5, [1.0] * 7 + [NAN], 1), (6, [INF] + [1.0] * 7, 1), (7, [1.0] * 8, None), (8, [1.0] * 8, 1), (9, [2.0] * 8, 1), (9, [2.0] * 8, 1), (None, [1.0] * 8, 1), (11, [1.0] * 3, 1)]


def clustered(seed, n, labels=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            _, e, label = out[rng.integers(len(out))]
            e = np.array(e) + rng.normal(0, rng.choice([0, 0.1, 0.4]), 8)
        else:
            e, label = rng.normal(0, 1, 8), int(rng.integers(labels))
        out.append((100 + i, [float(np.float32(x)) for x in e], label))
    return out


def brute_links(rows):
    ok = [(i, np.array(e, dtype=np.float64), lab) for i, e, lab in rows if i is not None and lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    root = {i: i for i, *_ in rows}
    links = {i: 0 for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a, la) in enumerate(ok):
        for j, b, lb in ok[:k]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, *_ in rows if i is not None}


@pytest.mark.parametrize("shard", [ann.SHARD, 60])
def test_near_duplicates_recall(spark, shard):
    rows = clustered(1, 300)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ann.near_duplicates(vectors(spark, rows), shard=shard).collect()}
    want = brute_links(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert sum(x for x, _ in got.values()) >= 0.9 * sum(x for x, _ in want.values())
    if shard == ann.SHARD:
        assert got == want


def test_near_duplicates_odd_rows(spark):
    got = [tuple(r) for r in ann.near_duplicates(vectors(spark, odd_rows())).collect()]
    by_id = {g[0]: g[1:] for g in got}
    assert len(got) == 12 and all(by_id[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11)) and by_id[None] == (0, None, False)
    assert by_id[8][1:] == (8, True) and by_id[9][1:] == (8, False)
    assert ann.near_duplicates(vectors(spark, [])).collect() == []


def test_large_shards_are_cut_again(spark):
    rows = clustered(2, 400, labels=1)
    got = {r.vec_id: r.n_links for r in ann.near_duplicates(vectors(spark, rows), shard=40, overlap=2, max_shard=80).collect()}
    want = brute_links(rows)
    assert sum(got.values()) >= 0.9 * sum(x for x, _ in want.values()) and all(got[i] <= want[i][0] for i in want)


def test_shards_count_their_overlap_and_each_vector_is_searched_once(spark):
    rng = np.random.default_rng(12)
    reps = spark.createDataFrame([(i, "1", rng.normal(0, 1, 8).tobytes()) for i in range(1200)], "rep bigint, label string, v binary")
    for n, shard, most in ((1200, 100, 10_000), (1200, 100, 150), (90, 100, 150)):  # cut once, again, and not at all
        rows = ann.shards_of(reps.filter(F.col("rep") < n), Scratch(spark, "shards"), 3, shard, most).toPandas()
        assert sorted(rows[rows["home"]]["rep"]) == list(range(n))
        # most centres at random get more than others, but on average a shard has the wanted size
        assert len(rows) / rows["shard"].nunique() <= 1.3 * shard


def family(seed, n, spread, dims=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, dims)
    return [(1 + i, [float(np.float32(x)) for x in middle + rng.normal(0, spread, dims)], 1) for i in range(n)]


def test_families_across_shards_are_whole(spark, monkeypatch):
    monkeypatch.setattr(ann.all_pairs, "__defaults__", (100,))
    rows = family(6, 300, 0.15) + [(i + 1000, e, label) for i, e, label in clustered(7, 60)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ann.near_duplicates(vectors(spark, rows), shard=30).collect()}
    assert {i: g for i, g in got.items() if i <= 300} == {i: w for i, w in brute_links([r for r in rows if len(r[1]) == 16]).items() if i <= 300}


def test_failed_audits_end_in_a_whole_comparison(spark, monkeypatch):
    monkeypatch.setattr(ann, "audit", lambda *_: 0.0)
    monkeypatch.setattr(ann, "TRIES", 1)
    rows = clustered(8, 200)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ann.near_duplicates(vectors(spark, rows), shard=40, overlap=1, beam=1).collect()}
    assert got == brute_links(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a int, b int").repartition(4)).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def brute_top(rows, k):
    ok = [(i, np.floor(64 * np.array(e, dtype=np.float64)).astype(np.int64)) for i, e, _ in rows if i is not None and e and None not in e and np.isfinite(e).all()]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize(("k", "index_block", "query_block"), [(20, topk.INDEX_BLOCK, topk.QUERY_BLOCK), (3, 16, 2), (500, 64, 3)])
def test_top_k_is_exact(spark, k, index_block, query_block):
    rows = clustered(4, 250) + [(r[0] + 20, r[1], 0) for r in clustered(4, 1)] * 2 + odd_rows()
    rows += [(400 + i, [0.0] * 8, 0) for i in range(4)]
    got = [tuple(r) for r in topk.top_k(vectors(spark, rows), k=k, index_block=index_block, query_block=query_block).collect()]
    want = brute_top(rows, k)
    assert sorted({(g[0], g[1], g[3]) for g in got}) == sorted({(w[0], w[1], w[3]) for w in want})
    twice = {i for i in {r[0] for r in rows} if sum(r[0] == i for r in rows) > 1}
    assert sorted(g for g in got if g[0] not in twice) == sorted(w for w in want if w[0] not in twice)


def test_top_k_stops_early_and_right():
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (3000, 16))
    x[:40] = x[0] + rng.integers(-1, 2, (40, 16))
    index = topk.ImpactIndex(x)
    found = index.search(x[:60], 20, [np.array([i]) for i in range(60)])
    assert max(len(places) for places, _ in found) < len(x) // 2
    for i, (places, scores) in enumerate(found):
        exact = np.delete(x @ x[i], i)
        assert sorted(scores.tolist())[-20:] == sorted(exact.tolist())[-20:] and i not in places


def test_top_k_of_nothing(spark):
    assert topk.top_k(vectors(spark, [])).collect() == []


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, "bob", "yo"), (1, 2, None, None), (None, 0, "ann", "lost"), (2, None, "ann", "only")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, ms string, segment int")
    got = {(r.conv_id, r.assistant): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann")}
    bob = got[1, "bob"]
    assert bob.rendered == "<|user name=ann|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|assistant|>\nyo<|end|>\n<|user name=unknown|>\n<|end|>\n"
    assert [bob.rendered[int(a) : int(b)] for a, b in (s.split(":") for s in bob.mask.split(","))] == ["yo", "yo"]
    assert (bob.n_turns, bob.n_trained, got[2, "ann"].n_turns) == (4, 2, 1)
    assert chat.rotate_perspectives(turns.limit(0)).collect() == []
    assert {r.segment for r in chat.rotate_perspectives(turns, most_turns=3, segment_turns=2).collect()} == {0, 1}


def test_a_dialogue_is_one_rendering_whatever_its_turns_are_numbered_by(spark):
    rows = [(c, t, "ab"[k % 2], f"w{k}") for c, turns in ((1, range(508, 517)), (2, [1_700_000_000_000 + 10**9 * k for k in range(9)]), (3, [-(2**62), 0, 2**62])) for k, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = chat.rotate_perspectives(turns).collect()
    assert sorted((r.conv_id, r.segment, r.n_turns) for r in got) == [(1, 0, 9)] * 2 + [(2, 0, 9)] * 2 + [(3, 0, 3)] * 2
    cut = chat.rotate_perspectives(turns, most_turns=8, segment_turns=3).filter("assistant = 'a'").orderBy("conv_id", "segment").collect()
    assert [(r.conv_id, r.segment, r.n_turns) for r in cut] == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 0, 3), (2, 1, 3), (2, 2, 3), (3, 0, 3)]


def test_ledger_is_idempotent(spark):
    rows = [("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, None, "v1", 3), ("t", "fr", "v2", 0)]
    counted = spark.createDataFrame(rows, "source string, lang string, version string, tokens bigint")
    ledger = rollup.new_ledger(spark, "test")
    assert ledger.totals().collect() == []
    for _ in range(3):
        ledger.commit("1", rollup.inserts(counted))
    ledger.commit("2", rollup.deletes(counted.filter("tokens = 7")))
    ledger.commit("3", rollup.revisions(counted.filter("tokens = 3").withColumnRenamed("tokens", "old_tokens").withColumn("tokens", F.lit(10))))
    ledger.commit("4", rollup.inserts(counted.limit(0)))
    got = {tuple(r) for r in ledger.totals().collect()}
    assert got == {("s", "en", "v1", 1, 5), (None, None, "v1", 1, 10), ("t", "fr", "v2", 1, 0)}
    ledger.commit("5", rollup.deletes(counted.filter("source = 't'")))
    assert ("t", "fr", "v2", 1, 0) not in {tuple(r) for r in ledger.totals().collect()}
    with pytest.raises(ValueError, match="batch id"):
        ledger.commit("../x", rollup.inserts(counted))


def test_token_counts(spark):
    r = spark.createDataFrame([("ab, c",), (None,), ("é é",)], "text string").select(rollup.word_tokens(F.col("text")), rollup.letter_tokens(F.col("text")), rollup.byte_tokens(F.col("text"))).collect()
    assert [tuple(x) for x in r] == [(2, 3, 5), (0, 0, 0), (2, 2, 5)]
