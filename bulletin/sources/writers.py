"""K1-K8: sinks. Spark's committer makes each dataset appear as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.maintain import guard


def write_records(rows: DataFrame, path: str, snapshot: str | None = None) -> None:
    """K1, K2: the records as Parquet, by year so that a year's readers skip the rest; under
    a snapshot's name if one is given."""
    out = rows.withColumn("year", F.coalesce(F.substring("lectureStart", 1, 4).try_cast("int"), F.lit(0)))
    target = f"{path}/snapshot={snapshot}" if snapshot else path
    out.write.mode("overwrite").partitionBy("year").parquet(target)


def write_college(rows: DataFrame, path: str, existing: int, result: int) -> bool:
    """K3, F16: the partitions of the colleges at hand, unless too little came of a run."""
    if not guard(existing, result):
        return False
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("college").parquet(path)
    return True


def write_mark(spark, path: str, at: str, mode: str) -> None:
    """K4: when the last run was."""
    spark.createDataFrame([(at, mode)], "last_scrape string, mode string").coalesce(1).write.mode("overwrite").json(path)


def write_document(rows: DataFrame, path: str, updated: str, order: str = "ord", gzip: bool = False) -> None:
    """K1, K8: the wrapped JSON that a page loads. One document is one value, so only for
    slices of a bounded size."""
    fields = [c for c in rows.columns if c != order]
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("r")))), lambda x: x["r"])
    doc = rows.agg(F.to_json(F.struct(F.lit(updated).alias("updatedAt"), items.alias("data"))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def write_counters(counters: DataFrame, path: str) -> None:
    """K5."""
    counters.write.mode("overwrite").parquet(path)


def visits_report(matrix: DataFrame) -> str:
    """K6: a page with the year and month matrix: a row a year, so small."""
    from html import escape

    rows = matrix.orderBy(F.desc("year")).collect()
    head = "".join(f"<th>{m}</th>" for m in range(1, 13))
    body = "".join("<tr><th>" + escape(str(r["year"])) + "</th>" + "".join(f"<td>{r[f'm{m:02d}']}</td>" for m in range(1, 13)) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><table><tr><th></th>{head}</tr>{body}</table>"


def put_college(colleges: DataFrame, row: DataFrame) -> DataFrame:
    """K7: a source added or replaced by name."""
    return colleges.join(row.select("name"), "name", "left_anti").select(row.columns).unionByName(row)


def drop_college(colleges: DataFrame, name: str) -> DataFrame:
    """K7."""
    return colleges.filter(F.col("name") != name)
