"""Similar pairs against all pairs, with copies, equal addresses and two texts a row."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from bulletin.operators import resolve


def tokens(text):
    text = text or ""
    return {text[i : i + 2] for i in range(len(text) - 1)} | ({text} if len(text) >= 4 else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("seed", range(2))
def test_pairs_and_links_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "甲", "".join(r.choice("甲乙丙") for _ in range(r.randint(2, 7)))])
    rows = [(r.choice("gh"), i, f"u{r.randint(0, 25)}", text(), text()) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, ord int, sourceUrl string, title string, topic string")
    want = {}
    for x, y in itertools.combinations(rows, 2):
        best = max(likeness(tokens(p), tokens(q)) for p in x[3:] for q in y[3:])
        if x[0] == y[0] and x[2] != y[2] and best >= 0.6:
            want[x[1], y[1]] = best
    got = {(p.a, p.b): p.similarity for p in resolve.similar_pairs(df, 0.6, ("g",)).collect()}
    assert got == pytest.approx(want)
    first = {(c.node, c.cluster) for c in resolve.close(spark.createDataFrame(list(want), "a int, b int")).collect()}
    assert {(c.node, c.cluster) for c in resolve.close(resolve.similar_links(df, 0.6, ("g",))).collect()} == first


def test_links_of_copies_grow_as_the_copies(spark):
    rows = [("g", i, f"u{i}", "甲乙丙丁", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, ord int, sourceUrl string, title string, topic string")
    assert resolve.similar_links(df, 0.6, ("g",)).count() <= 400  # all pairs: 19,900
