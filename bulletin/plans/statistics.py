"""The statistics job: what the pages of a site load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import year_of
from ..operators.cube import college_year_cube, first_seen, measures, notice_count, with_counters
from ..operators.serve import index, latest


def dated(records: DataFrame) -> DataFrame:
    return records.withColumn("year", year_of(F.col("lectureStart"), F.col("publishTime"), F.col("title")))


def build(records: DataFrame, counters: DataFrame) -> dict[str, DataFrame]:
    """Each slice as its own plan; records with their year are read once for the cubes."""
    rows = dated(records)
    return {
        "cube": college_year_cube(rows),
        "totals": notice_count(records),
        "campuses": first_seen(records, "college", "campus", "ord"),
        "measures": measures(with_counters(rows, counters)),
        "index": index(records),
        "latest": latest(records),
    }
