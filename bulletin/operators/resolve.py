"""One event announced by several colleges: J6, J7, A12, U3, U4.

Pairs are compared only inside a block of one speaker and day, and there only if they share a
rare token. Components are closed by rounds of stars, and each cluster is folded into its
fullest record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.predicates import is_speaker
from ..functions.text import jaccard, let, normalize_speaker, topic_tokens
from ..session import Rounds
from .dedup import completeness

SIMILAR = 0.25
FILLED = ("speakerTitle", "speakerAffiliation", "location", "speakerBio", "organizer")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows with a plausible speaker and a day, and the block they are in."""
    speaker = let(normalize_speaker(F.col("speaker")), lambda n: F.when(is_speaker(n), n))
    day = F.substring(F.coalesce("lectureStart", F.lit("")), 1, 10)
    return rows.withColumns({"block_speaker": speaker, "block_day": day}).filter((day != "") & ~day.startswith("0000") & F.col("block_speaker").isNotNull())


def prefixes(sets: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """A row for each token of the prefix of each set: the first n - ceil(least * n) + 1 tokens, the
    rarest of all rows first. Of two sets with similarity ``least`` (over 0) the prefixes share one. ``sets`` has keys, s
    and its other columns; token is the rank of the row's token, p the ranks of the prefix, n the size, bits a sum of the set in 64 bits."""
    others = [c for c in sets.columns if c not in (*keys, "s")]
    each = sets.filter(F.size("s") > 0).select(*keys, *others, F.monotonically_increasing_id().alias("id"), "s").select("*", F.explode("s").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    own = [F.first(c).alias(c) for c in (*keys, *others, "s")]
    ranked = each.join(often, "token").groupBy("id").agg(*own, F.array_sort(F.collect_list(F.struct("often", "token"))).alias("r"))
    # least * n is lowered by a hair, as a product may come out above the number it stands for
    first = F.slice("r", F.lit(1), F.size("r") - F.ceil(F.size("r") * least - 1e-9).cast("int") + 1)
    bits = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))
    return ranked.select(*keys, *others, "s", F.transform(first, lambda x: x["token"]).alias("p"), F.size("s").alias("n"), bits.alias("bits")).select("*", F.explode("p").alias("token"))


def candidate_pairs(sets: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Pairs of rows of ``sets`` (o and other columns, numbered 1 and 2; o1 < o2) with similar sets s1, s2. Pairs
    that meet at a token are held against each other there, so nothing but the prefixes is shuffled, and only
    at the first one they share, so each once. Sizes and sums of sets rule most out: a bit that one sum has alone is a token that one set has alone."""
    rows = prefixes(sets, least, keys)
    names = [c for c in rows.columns if c not in (*keys, "token")]
    a, b = (rows.select(*keys, "token", *(F.col(c).alias(f"{c}{k}") for c in names)) for k in "12")
    size = F.col("n1") + F.col("n2")
    # of similar sets at most so many tokens are in one alone
    apart = F.floor(size * ((1 - least) / (1 + least)) + 1e-9)
    fits = (F.least("n1", "n2") >= F.greatest("n1", "n2") * least - 1e-9) & (F.bit_count(F.col("bits1").bitwiseXOR(F.col("bits2"))) <= apart)
    met = a.join(b, [*keys, "token"]).filter(F.col("o1") < F.col("o2")).filter(fits)
    met = met.filter(F.get(F.array_intersect("p1", "p2"), F.lit(0)) == F.col("token"))
    return met.filter(jaccard(F.col("s1"), F.col("s2")) >= least)


def _classes(blocked: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by the sets of their titles and topics (keys, o, u, k, w; w is the set in one text) with the class they are in.
    A class is the rows of a block with one set; c names it by the first of them, which is r; q is the first with another address than r, if any."""
    sets = F.array_distinct(F.array(*(F.array_join(F.array_sort(topic_tokens(F.col(x))), " ") for x in ("title", "topic"))))  # no token holds a blank
    # never empty: outer keeps Spark from computing it a second time to see that
    t = blocked.select(*keys, F.col(order).alias("o"), F.col("sourceUrl").alias("u"), F.posexplode_outer(sets).alias("k", "w")).filter("w <> ''")
    by = Window.partitionBy(*keys, "w")
    rows = t.withColumn("r", F.min(F.struct("o", "k", "u")).over(by)).withColumn("c", F.struct("r.o", "r.k"))
    return rows.withColumn("q", F.min(F.when(~F.col("u").eqNullSafe(F.col("r.u")), F.struct("o", "u"))).over(by))


def _firsts(rows: DataFrame) -> DataFrame:
    """The row that names each class."""
    return rows.filter((F.col("c.o") == F.col("o")) & (F.col("c.k") == F.col("k")))


def _met(firsts: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Pairs of similar classes (keys, c, d, similarity), each compared once."""
    sets = firsts.select(*keys, F.col("c").alias("o"), F.split("w", " ").alias("s"))
    return candidate_pairs(sets, least, keys).select(*keys, F.col("o1").alias("c"), F.col("o2").alias("d"), jaccard(F.col("s1"), F.col("s2")).alias("similarity"))


def similar_pairs(blocked: DataFrame, least: float = SIMILAR, keys: tuple[str, ...] = ("block_speaker", "block_day"), order: str = "ord") -> DataFrame:
    """(a, b, similarity) of rows of one block with different addresses, by the best of
    the comparisons of title and topic. Only rows that share a token of their prefixes are compared,
    not all of a block, and equal sets of a block once; ``order`` is unique and ``least`` over 0."""
    by = list(keys)
    rows = _classes(blocked, by, order)
    met = _met(_firsts(rows), least, by)
    one, two = (rows.select(*by, F.col("c").alias(c), F.col("o").alias(f"o{k}"), F.col("u").alias(f"u{k}")) for c, k in (("c", 1), ("d", 2)))
    across = met.join(one, [*by, "c"]).join(two, [*by, "d"]).filter("o1 <> o2")
    twins = one.join(two.withColumnRenamed("d", "c"), [*by, "c"]).filter("o1 < o2").withColumn("similarity", F.lit(1.0))
    cols = ["o1", "o2", "u1", "u2", "similarity"]
    linked = across.select(cols).unionByName(twins.select(cols)).filter(~F.col("u1").eqNullSafe(F.col("u2")))
    # rows with two sets can meet several times
    return linked.groupBy(F.least("o1", "o2").alias("a"), F.greatest("o1", "o2").alias("b")).agg(F.max("similarity").alias("similarity"))


def similar_links(blocked: DataFrame, least: float = SIMILAR, keys: tuple[str, ...] = ("block_speaker", "block_day"), order: str = "ord") -> DataFrame:
    """(a, b): links with the components of `similar_pairs`, in number as the rows and the pairs of classes' members, not
    as the square of a class. Every row of a class, and of the classes similar to it, is linked with the class's first row,
    or where that has the row's own address with the first one of another: whoever is linked with any of a class is linked with one of the two."""
    by = list(keys)
    rows = Rounds(blocked.sparkSession, "classes").keep(_classes(blocked, by, order))  # read several times
    end = lambda: F.when(~F.col("u").eqNullSafe(F.col("r.u")), F.col("r.o")).otherwise(F.col("q.o"))
    firsts = _firsts(rows)
    # a class alone in its block meets none, and most are
    several = firsts.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    met = _met(firsts.join(several, by, "left_semi"), least, by).select(*by, "c", "d")
    both = met.unionByName(met.select(*by, F.col("d").alias("c"), F.col("c").alias("d")))
    led = firsts.select(*by, F.col("c").alias("d"), "r", "q")
    across = both.join(led, [*by, "d"]).join(rows.select(*by, "c", "o", "u"), [*by, "c"])
    links = rows.select(F.col("o").alias("a"), end().alias("b")).unionByName(across.select(F.col("o").alias("a"), end().alias("b")))
    return links.filter("b IS NOT NULL AND a <> b").distinct()


def stars(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Links as stars, (a, b) with b the least of a's component, and the rounds that it took: in
    each, every node hands its larger neighbours to its least one (large star), then its smaller ones (small star).
    Rounds grow with the logarithm of the number of nodes, not with the length of chains."""
    rounds = Rounds(pairs.sparkSession, "stars")
    oriented = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, n, before = rounds.keep(oriented(pairs)), 0, None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == before:
            return edges, n
        before, n = state, n + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = rounds.keep(both.join(to, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        down = oriented(large)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), "m").unionByName(least).select("a", F.col("m").alias("b"))
        edges = rounds.keep(oriented(small))


def close(pairs: DataFrame) -> DataFrame:
    """(node, cluster) of linked rows, the cluster being its least node."""
    edges, _ = stars(pairs.select("a", "b"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())


def merge(rows: DataFrame, clusters: DataFrame, order: str = "ord") -> DataFrame:
    """Of each cluster the fullest record, the first of equals, takes the others of
    other colleges as its sources, one a college in order, and fills its empty fields from
    them; those others leave, others of its own college stay."""
    # a row without a cluster is dealt by its own number, so that such rows don't all meet in one task
    member = rows.join(clusters, F.col(order) == F.col("node"), "left").withColumn("__in", F.col("node").isNotNull()).drop("node")
    member = member.withColumn("cluster", F.coalesce("cluster", order)).repartition("cluster")
    source = F.struct(F.coalesce("sourceUrl", F.lit("")).alias("sourceUrl"), F.coalesce("college", F.lit("")).alias("college"), F.coalesce("campus", F.lit("")).alias("campus"), F.coalesce("title", F.lit("")).alias("title"))
    # the first of each college is enough, as one a college is kept
    fill = lambda f: F.min(F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))
    place = F.struct((-completeness()).alias("least"), F.col(order).alias("o"), F.col("college").alias("college"))
    own = member.filter("__in").groupBy("cluster", "college").agg(F.min(place).alias("best"), F.min(F.struct(F.col(order).alias("o"), source.alias("s"))).alias("new"), *(fill(f).alias(f"__{f}") for f in FILLED))
    folded = own.groupBy("cluster").agg(F.min("best").alias("best"), F.collect_list(F.struct("college", "new")).alias("all"), *(F.min(f"__{f}")["v"].alias(f"__{f}") for f in FILLED))
    foreign_new = F.transform(F.filter("all", lambda x: ~x["college"].eqNullSafe(F.col("best.college"))), lambda x: x["new"])
    folded = folded.select("cluster", F.col("best").alias("__best"), F.array_sort(foreign_new).alias("__new"), *(f"__{f}" for f in FILLED))
    joined = member.join(folded, "cluster", "left")
    lead = F.col("__in") & place.eqNullSafe(F.col("__best"))
    foreign = F.col("__in") & ~F.col("college").eqNullSafe(F.col("__best.college"))
    none = F.array().cast("array<struct<sourceUrl:string,college:string,campus:string,title:string>>")
    listed = F.concat(F.coalesce("sources", none), F.transform(F.coalesce("__new", F.array().cast(joined.schema["__new"].dataType)), lambda x: x["s"]))
    once = F.aggregate(listed, none, lambda acc, s: F.when((s["college"] == F.col("college")) | F.exists(acc, lambda x: x["college"] == s["college"]), acc).otherwise(F.concat(acc, F.array(s))))
    merged = F.coalesce(lead & (F.size("__new") > 0), F.lit(False))
    out = joined.withColumns({"sources": F.when(merged, once).otherwise(F.col("sources")), "merged": F.when(merged, F.lit(True)).otherwise(F.col("merged"))})
    out = out.withColumns({"sourceCount": F.when(merged, F.size("sources") + 1).otherwise(F.col("sourceCount"))} | {f: F.when(merged & (F.coalesce(F.col(f), F.lit("")) == ""), F.coalesce(F.col(f"__{f}"), F.col(f))).otherwise(F.col(f)) for f in FILLED})
    stays = ~F.coalesce(foreign, F.lit(False))
    return out.filter(stays).select(rows.columns)


def resolve(rows: DataFrame, least: float = SIMILAR, order: str = "ord") -> DataFrame:
    """The whole stage over lecture records."""
    return merge(rows, close(similar_links(blocks(rows), least, order=order)), order)
