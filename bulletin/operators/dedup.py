"""Exact duplicates of one source: A11, A13."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_title

KEY_FIELDS = ("lectureStart", "location", "speaker", "speakerAffiliation", "topic", "speakerBio")


def completeness(fields: tuple[str, ...] = KEY_FIELDS) -> Column:
    """How many of the fields have a value."""
    return reduce(lambda a, b: a + b, (F.when(F.coalesce(F.col(f), F.lit("")) != "", 1).otherwise(0) for f in fields))


def record_key() -> list[Column]:
    """College, bare title, day, and address with the number of the session, if any."""
    session = F.when(F.coalesce(F.col("isMultiLecture"), F.lit(False)) & (F.coalesce(F.col("lectureIndex"), F.lit(0)) != 0), F.concat(F.lit("#"), F.col("lectureIndex").cast("string"))).otherwise("")
    return [F.coalesce("college", F.lit("")).alias("__c"), normalize_title(F.col("title")).alias("__t"), F.substring(F.coalesce("lectureStart", F.lit("")), 1, 10).alias("__d"), F.concat(F.rtrim(F.coalesce("sourceUrl", F.lit("")), F.lit("/")), session).alias("__u")]


def keep_best(rows: DataFrame, keys: list[Column], score: Column, order: str) -> DataFrame:
    """Of each key the row with the best score, the first of equals. The window is over
    a key, whose rows are copies of one record; Spark drops all but the best of each task
    before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(order))
    return rows.withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank")


def dedup(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Lecture records without exact copies."""
    return keep_best(rows, record_key(), completeness(), order)
