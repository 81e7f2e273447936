"""Joins, components, throttles and crawls that hold at scale, against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bulletin.functions.text import jaccard
from bulletin.operators import counters, frontier, resolve

AT = datetime(2024, 1, 1)


def test_a_long_chain_takes_few_rounds(spark):
    nodes = list(range(1000))
    random.Random(1).shuffle(nodes)
    edges, rounds = resolve.stars(spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a bigint, b bigint"))
    assert rounds <= 16 and {r.b for r in edges.collect()} == {0} and edges.count() == 999


def test_components_are_brute_force(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(1, 1), (5, 6), (6, 5)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.cluster for r in resolve.close(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == least
    assert resolve.close(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("least", [0.25, 0.6, 1.0])
def test_similar_pairs_are_all_pairs_of_a_block_and_few_are_compared(spark, least):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未") for _ in range(rng.randint(0, 9)))
    texts = [text() for _ in range(60)]
    rows = [(n % 3 if n % 7 else None, n, rng.choice(["u", "v", None]) if n % 5 == 0 else f"u{n}", rng.choice(texts), rng.choice([*texts, None])) for n in range(150)]
    df = spark.createDataFrame(rows, "g int, ord int, sourceUrl string, title string, topic string")
    got = {(r.a, r.b, round(r.similarity, 9)) for r in resolve.similar_pairs(df, least, ("g",)).collect()}
    from bulletin.functions.text import topic_tokens

    a, b = (df.select("g", *(F.col(c).alias(c + k) for c in ("ord", "sourceUrl")), topic_tokens(F.col("title")).alias("t" + k), topic_tokens(F.col("topic")).alias("p" + k)) for k in "12")
    best = F.greatest(*(jaccard(F.col(x), F.col(y)) for x, y in (("t1", "t2"), ("p1", "p2"), ("t1", "p2"), ("p1", "t2"))))
    every = a.join(b, "g").filter("ord1 < ord2").withColumn("s", best)
    want = {(r.ord1, r.ord2, round(r.s, 9)) for r in every.filter(F.col("s") >= least).filter(~F.col("sourceUrl1").eqNullSafe(F.col("sourceUrl2"))).collect()}
    assert got == want and got
    if least > 0.5:
        sets = df.select("g", F.col("ord").alias("o"), F.explode(F.array(topic_tokens(F.col("title")), topic_tokens(F.col("topic")))).alias("s"))
        assert resolve.candidate_pairs(sets, least, ["g"]).count() < every.count() / 2


def brute_accepted(events, seconds):
    out, last = [], {}
    for k, t in sorted((e for e in events if e[1] is not None), key=lambda e: (str(e[0]), e[1])):
        if k not in last or (t - last[k]).total_seconds() >= seconds:
            last[k] = t
            out.append((k, t))
    return out


@pytest.mark.parametrize("seconds", [1, 7, 300])
def test_throttles_by_runs_are_brute_force(spark, seconds, monkeypatch):
    monkeypatch.setattr(counters, "SPAN", 2)  # many spans a key
    rng = random.Random(seconds)
    events = [(rng.choice(["hot"] * 6 + ["a", "b", None]), AT + timedelta(seconds=rng.choice([rng.randrange(4000), rng.randrange(10) * 400, 77]))) for _ in range(700)] + [("a", None), (None, None)]
    df = spark.createDataFrame(events, "k string, ts timestamp_ntz").repartition(3)
    got = sorted(((r.k, r.ts) for r in counters.accepted(df, ["k"], seconds=seconds).collect()), key=str)
    assert got == sorted(brute_accepted(events, seconds), key=str)
    assert counters.runs(df, ["k"], "ts", seconds).select("k", "run").distinct().count() > 20 or seconds == 300


def test_a_crawl_follows_lists_stops_at_cycles_and_goes_on(spark, tmp_path):
    links = [("/l/", "/a/1"), ("/l/", "/a/2/"), ("/l/2.html", "/a/2"), ("/l/2.html", "/a/3"), ("/l/3.html", "/a/3"), ("/m/", "/a/1"), ("/m/p2", "/a/9"), ("/x", None)]
    nexts = [("/m/", "/m/p2"), ("/m/p2", "/m")]
    seeds = spark.createDataFrame([("s", "/l/"), ("s", "/l"), ("t", "/m/"), ("t", None)], "source string, url string")
    args = (spark.createDataFrame(links, "url string, href string"), str(tmp_path / "c"), spark.createDataFrame(nexts, "url string, next string"))
    frontier.crawl(seeds, *args, most=1)
    visited, found = frontier.crawl(seeds, *args)
    # 2.html and 3.html are guessed; 3.html has nothing new, so 4.html is not; t's second page leads back
    assert {(r.source, r.url.rstrip("/"), r.depth) for r in visited.collect()} == {("s", "/l", 0), ("s", "/l/2.html", 1), ("s", "/l/3.html", 2), ("t", "/m", 0), ("t", "/m/p2", 1)}
    assert sorted((r.source, r.href.rstrip("/")) for r in found.collect()) == [("s", "/a/1"), ("s", "/a/2"), ("s", "/a/3"), ("t", "/a/1"), ("t", "/a/9")]
    nothing, _ = frontier.crawl(seeds.limit(0), args[0], str(tmp_path / "n"))
    assert nothing.collect() == []
