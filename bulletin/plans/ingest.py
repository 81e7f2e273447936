"""The ingest: links -> pages -> records -> classified -> without copies -> resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import is_dropped
from ..operators.dedup import dedup
from ..operators.maintain import known_urls, unseen, upsert
from ..operators.resolve import resolve


def fetchable(links: DataFrame, existing: DataFrame, excluded: DataFrame) -> DataFrame:
    """The links worth a request; the joins run before anything costly."""
    return unseen(links, known_urls(existing), excluded)


def classify(records: DataFrame, body: str = "body", skip: str = "skip_news_filter") -> DataFrame:
    """records that are notices of lectures."""
    drop = is_dropped(F.col("title"), F.col(body), F.col("lectureStart"), F.col("publishTime"), F.col("publishTimeSource"), F.col(skip))
    return records.filter(~drop)


def curate(existing: DataFrame, fresh: DataFrame, order: str = "ord") -> DataFrame:
    """The record set after a run."""
    from ..operators.maintain import record_id

    both = upsert(existing.withColumn("__id", record_id()), fresh.withColumn("__id", record_id()), "__id", order).drop("__id")
    return resolve(dedup(both, order), order=order)
