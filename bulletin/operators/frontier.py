"""Following list pages and their links, round by round, over pages that are at hand.

A round reads the pages of the frontier, takes up the links that no earlier page of their
source had, and finds each page's next one: the one it links to, else, where it had new
links, the one its address makes likely (D19). What was visited leaves the next frontier, so
cycles end. Each round is written before the next one begins, and a crawl that was broken
off goes on behind its last whole round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import next_page

_PAGES = "source string, url string, depth int"
_LINKS = "source string, href string, page string, depth int"


def bare(url):
    """An address without closing slashes: how two are compared."""
    return F.rtrim(url, F.lit("/"))


class Rounds:
    """The written rounds of a crawl: ``<path>/<kind>/depth=<n>``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def done(self, n: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pages/depth={n}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, kind: str, n: int, rows: DataFrame) -> None:
        rows.drop("depth").write.mode("overwrite").parquet(f"{self.path}/{kind}/depth={n}")

    def read(self, kind: str, schema: str, upto: int) -> DataFrame:
        fields = schema.removesuffix(", depth int")
        rounds = [self.spark.read.schema(fields).parquet(f"{self.path}/{kind}/depth={n}").withColumn("depth", F.lit(n)) for n in range(upto + 1)]
        out = rounds[0]
        for more in rounds[1:]:
            out = out.unionByName(more)
        return out


def crawl(seeds: DataFrame, links: DataFrame, path: str, nexts: DataFrame | None = None, guess: bool = True, follow: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, links): source, url, depth of every page visited; source, href, page, depth of every link, once a source.

    ``seeds`` has source, url; ``links`` url, href of the pages at hand; ``nexts`` url, next. ``follow`` makes every new link
    a page of the next round; ``most`` ends after so many rounds. A null address is no page; of addresses alike but for closing slashes the
    longest stands; an empty seed table visits none."""
    spark = seeds.sparkSession
    rounds = Rounds(spark, path)
    have = links.select(bare(F.col("url")).alias("key"), "href").filter("href IS NOT NULL")
    ahead = None if nexts is None else nexts.select(bare(F.col("url")).alias("key"), "next").filter("next IS NOT NULL")
    if not rounds.done(0):
        rounds.write("links", 0, spark.createDataFrame([], "source string, href string, page string"))
        rounds.write("pages", 0, seeds.filter("url IS NOT NULL").groupBy("source", bare(F.col("url")).alias("key")).agg(F.max("url").alias("url")).drop("key"))
    # what the links are made of is worked out once, not in each round
    rounds.write("have", 0, have)
    have = spark.read.schema("key string, href string").parquet(f"{rounds.path}/have/depth=0")
    n = 0
    while most is None or n < most:
        visited, seen = rounds.read("pages", _PAGES, n), rounds.read("links", _LINKS, n)
        now = visited.filter(F.col("depth") == n)
        if not rounds.done(n + 1):
            if now.isEmpty():
                break
            known = seen.select("source", bare(F.col("href")).alias("to"))
            found = now.withColumn("key", bare(F.col("url"))).join(have, "key").withColumn("to", bare(F.col("href"))).join(known, ["source", "to"], "left_anti")
            rounds.write("links", n + 1, found.groupBy("source", "to").agg(F.min(F.struct("href", "url")).alias("l")).select("source", "l.href", F.col("l.url").alias("page")))
            fresh = rounds.read("links", _LINKS, n + 1).filter(F.col("depth") == n + 1)
            paged = now.withColumn("key", bare(F.col("url")))
            paged = paged.withColumn("next", F.lit(None).cast("string")) if ahead is None else paged.join(ahead, "key", "left")
            lively = fresh.select("source", F.col("page").alias("url"), F.lit(True).alias("lively")).distinct()
            likely = F.when(F.col("lively"), next_page(F.col("url"))) if guess else F.lit(None).cast("string")
            to = paged.join(lively, ["source", "url"], "left").select("source", F.coalesce("next", likely).alias("url"))
            if follow:
                to = to.unionByName(fresh.select("source", F.col("href").alias("url")))
            to = to.filter("url IS NOT NULL").withColumn("key", bare(F.col("url"))).groupBy("source", "key").agg(F.max("url").alias("url"))
            been = visited.select("source", bare(F.col("url")).alias("key"))
            rounds.write("pages", n + 1, to.join(been, ["source", "key"], "left_anti").select("source", "url"))
        n += 1
    return rounds.read("pages", _PAGES, n), rounds.read("links", _LINKS, n)
