"""Statistics cubes: A1-A10, A13, A18, J4, J5, A7, O4, O5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import NO_YEAR

NO_COLLEGE = "未分类"


def college_year_cube(rows: DataFrame, college: str = "college", year: str = "year") -> DataFrame:
    """Counts of each college and year, of each, and of all, in one pass;
    totals have null in place of the key, ``level`` tells which."""
    return rows.groupBy(F.coalesce(F.col(college), F.lit(NO_COLLEGE)).alias("college"), F.coalesce(F.col(year), F.lit(NO_YEAR)).alias("year")).agg(F.count("*").alias("n")).cube("college", "year").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))


def notice_count(rows: DataFrame) -> DataFrame:
    """A3: the notices behind the lectures; an explicit count of 0 stays 0."""
    n = F.coalesce(F.col("sourceCount"), F.when(F.size(F.coalesce("sources", F.array())) > 0, F.size("sources")), F.lit(1))
    return rows.agg(F.count("*").alias("lectureCount"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("sourceNoticeCount"))


def years(rows: DataFrame, year: str = "year") -> DataFrame:
    """The distinct years, the latest first, the mark of missing ones last."""
    y = F.coalesce(F.col(year), F.lit(NO_YEAR)).alias("year")
    return rows.select(y).distinct().orderBy((F.col("year") == NO_YEAR).asc(), F.desc("year"))


def frequency(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A5: values by how often they occur, then by which came first."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").select(key, "n")


def first_seen(rows: DataFrame, key: str, value: str, order: str, non_empty: bool = False) -> DataFrame:
    """The first value of each key; with ``non_empty`` the first that is one."""
    if non_empty:
        rows = rows.filter(F.coalesce(F.col(value), F.lit("")) != "")
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def with_counters(cells: DataFrame, counters: DataFrame, url: str = "sourceUrl") -> DataFrame:
    """Visits and likes of each row's address; none count as 0. Both sides may be large:
    the join is left to Spark, which broadcasts a small one by its size."""
    joined = cells.join(counters.select(F.col("url").alias("__url"), "visits", "likes"), F.col(url) == F.col("__url"), "left").drop("__url")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("visits", "likes")})


def measures(rows: DataFrame) -> DataFrame:
    """Lectures, visits and likes by college and year, with totals."""
    return rows.cube("college", "year").agg(F.count("*").alias("n"), F.sum("visits").alias("visits"), F.sum("likes").alias("likes"), F.grouping_id().cast("int").alias("level"))


def of_campus(rows: DataFrame, campuses: DataFrame, campus: str | None = None, like: str = "") -> DataFrame:
    """Rows of the colleges of a campus whose name has a text in it."""
    chosen = campuses if campus is None else campuses.filter(F.col("campus") == campus)
    return rows.join(chosen.select("college").distinct(), "college", "left_semi").filter(F.lower("college").contains(like.strip().lower()))


def year_month_matrix(days: DataFrame) -> DataFrame:
    """Visits of (day, n) by year, one column a month; days that aren't dates are left out."""
    d = days.withColumn("d", F.try_to_timestamp(F.col("day").cast("string"), F.lit("yyyy-MM-dd"))).filter("d IS NOT NULL")
    cells = [F.coalesce(F.sum(F.when(F.month("d") == m, F.col("n"))), F.lit(0)).cast("bigint").alias(f"m{m:02d}") for m in range(1, 13)]
    return d.groupBy(F.year("d").alias("year")).agg(*cells)


def visit_summary(days: DataFrame, total: Column | int) -> DataFrame:
    """A10: sums and extremes of (day, n), and what the total has beyond the days."""
    d = days.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("day_sum"), F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.greatest(F.lit(1), F.max("n")).cast("bigint").alias("max_cell"))
    return d.withColumn("legacy", F.greatest(F.lit(0), F.lit(total) - F.col("day_sum")).cast("bigint"))


def sorted_by(rows: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """Rows by any column, ties by college."""
    return rows.orderBy(F.desc(key) if descending else F.asc(key), "college")
