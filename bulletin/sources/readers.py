"""JSON documents of notices, exclusions and counters, and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .schema import COLLEGE, COUNTERS, LECTURE


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_lectures(spark: SparkSession, path: str) -> DataFrame:
    """Lectures with their place ``ord`` and the document's ``updatedAt``; the document is
    wrapped, a bare array, or missing; notes may be one text or a list."""
    lecture = T._parse_datatype_string(LECTURE)
    if not _exists(spark, path):
        return spark.createDataFrame([], f"ord bigint, updatedAt string, {LECTURE}")
    text = spark.read.option("wholetext", True).text(path)
    loose = T.StructType([T.StructField(f.name, T.StringType() if f.name == "notes" else f.dataType) for f in lecture])
    item, wrapped = loose.simpleString(), f"struct<updatedAt:string,data:array<{loose.simpleString()}>>"
    doc = F.from_json("value", wrapped)
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(doc["data"])
    flat = text.select(F.when(~F.trim("value").startswith("["), doc["updatedAt"]).alias("updatedAt"), F.posexplode(rows).alias("ord", "r"))
    return flat.select(F.col("ord").cast("bigint").alias("ord"), "updatedAt", *((notes_list(F.col("r.notes")) if f.name == "notes" else F.col(f"r.{f.name}")).alias(f.name) for f in lecture))


def notes_list(raw: Column) -> Column:
    """A text or a JSON list of texts as a list."""
    return F.when(raw.isNotNull(), F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.array(raw)))


def read_excluded(spark: SparkSession, path: str) -> DataFrame:
    """Excluded addresses, a list or one under ``urls``; a missing file excludes none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "url string")
    text = spark.read.option("wholetext", True).text(path)
    urls = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json("value", "struct<urls:array<string>>")["urls"])
    return text.select(F.explode(urls).alias("url")).select(F.rtrim("url", F.lit("/")).alias("url")).distinct()


def college_rows(parsed: list[dict]) -> list[tuple]:
    """Sources of a parsed list; a list page is an address or an address with a mode."""
    page = lambda p: (p, "auto") if isinstance(p, str) else (p["url"], p.get("collect_mode", "auto"))
    return [(s["name"], s.get("campus"), s.get("base"), [page(p) for p in s.get("list_urls") or []], s.get("exclude_urls") or [], bool(s.get("skip_news_filter"))) for s in parsed]


def read_colleges(spark: SparkSession, path: str) -> DataFrame:
    """The source dimension, a small JSON document (or YAML where its parser exists)."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a hand-kept list
    if path.endswith((".yaml", ".yml")):
        import yaml

        parsed = yaml.safe_load(text)
    else:
        parsed = json.loads(text)
    return spark.createDataFrame(college_rows(parsed if isinstance(parsed, list) else parsed.get("sources") or []), COLLEGE)


def read_visits(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The total and (day, n); older files have no days, none may be there at all."""
    if not _exists(spark, path):
        return 0, spark.createDataFrame([], "day string, n bigint")
    doc = spark.read.schema("total bigint, by_day map<string,bigint>").option("multiLine", True).json(path)
    total = doc.select(F.coalesce(F.max("total"), F.lit(0)).alias("t")).first().t
    return total, doc.select(F.explode("by_day").alias("day", "n"))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """A map of address to counters as rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], COUNTERS)
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,struct<visits:bigint,likes:bigint>>")).alias("url", "s")).select("url", F.coalesce("s.visits", F.lit(0)).alias("visits"), F.coalesce("s.likes", F.lit(0)).alias("likes"))


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A stored version of the records, the newest by default; Spark reads that
    partition alone."""
    rows = spark.read.parquet(root)
    version = version or rows.agg(F.max("snapshot").cast("string").alias("v")).first().v
    return rows.filter(F.col("snapshot").cast("string") == version)


def read_if_changed(rows: DataFrame, stored: float, since: float | None, tolerance: float = 1.0) -> tuple[bool, DataFrame]:
    """S11, ST4: nothing if the stored version is the one the client has."""
    same = since is not None and abs(stored - since) < tolerance
    return same, rows.limit(0) if same else rows
