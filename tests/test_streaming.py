"""Streams equal their batch twins over several micro-batches in order of time."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from bulletin.operators import counters
from bulletin.streaming import counters as stream, upsert

AT = datetime.datetime(2024, 1, 1)


def batches(spark, path, frames):
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02 if i else 0)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(path))


def test_throttle_stream_equals_batch(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000 / 240)
    parts = [r.h for r in e.select(hour.alias("h")).distinct().orderBy("h").collect()]
    rows = batches(spark, tmp_path / "in", [e.filter(hour == h) for h in parts])
    q = stream.accept(rows, "user_id", seconds=6 * 3600).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(parts) > 2 and spark.table("hits").count() == counters.accepted(e, ["user_id"], seconds=6 * 3600).count()


def test_versions_are_repeatable(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"), "k string, v int, ord int")
    assert t.version() == -1 and t.read().collect() == []
    one = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], t.schema)
    two = spark.createDataFrame([("b", 2, 0)], t.schema)
    t.merge(one, 0, "k", "ord")
    for _ in range(2):
        t.merge(two, 1, "k", "ord")
    assert t.version() == 1 and sorted((r.k, r.v) for r in t.read().collect()) == [("a", 1), ("b", 2)]


def test_first_batch_of_a_new_run_is_merged_onto_the_table(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"), "k string, v int, ord int")
    for n, k in enumerate("abd"):
        t.merge(spark.createDataFrame([(k, 1, 0)], t.schema), n, "k", "ord", "old")
    t.merge(spark.createDataFrame([("c", 1, 0)], t.schema), 0, "k", "ord", "new")
    t.merge(spark.createDataFrame([("a", 9, 0)], t.schema), 1, "k", "ord", "old")  # known: nothing changes
    assert t.version() == 3 and sorted((r.k, r.v) for r in t.read().collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]


def test_ingest_twice_over_a_table_that_exists(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"), "k string, v int, ord int")
    t.merge(spark.createDataFrame([("z", 1, 0)], t.schema), 0, "k", "ord")
    rows = batches(spark, tmp_path / "in", [spark.createDataFrame([("a", 1, 0)], t.schema), spark.createDataFrame([("b", 2, 0)], t.schema)])
    for _ in range(2):
        upsert.ingest(rows, t, "k", "ord", str(tmp_path / "cp")).awaitTermination()
        assert sorted(r.k for r in t.read().collect()) == ["a", "b", "z"]


def test_rows_after_a_deleted_checkpoint_are_not_lost(spark, tmp_path):
    import shutil

    t = upsert.VersionedTable(spark, str(tmp_path / "t"), "k string, v int, ord int")
    for k in "ab":
        rows = batches(spark, tmp_path / f"in-{k}", [spark.createDataFrame([(k, 1, 0)], t.schema)])
        upsert.ingest(rows, t, "k", "ord", str(tmp_path / "cp")).awaitTermination()
        shutil.rmtree(tmp_path / "cp")
    assert sorted(r.k for r in t.read().collect()) == ["a", "b"]


def test_a_batch_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"), "k string, v int, ord int", buckets=8)
    t.merge(spark.createDataFrame([(str(k), 1, 0) for k in range(100)], t.schema), 0, "k", "ord")
    for n in range(1, 5):
        t.merge(spark.createDataFrame([("7", n, 0), (None, n, 0)], t.schema), n, "k", "ord")
    places = {d.parent.name for d in (tmp_path / "t" / "data").glob("*/bucket=*")}
    assert len(list((tmp_path / "t" / "data" / "4-0-4").glob("bucket=*"))) <= 2
    assert places == {"0-0-0", "3-0-3", "4-0-4"}  # the first still holds untouched buckets
    assert t.read().count() == len({*map(str, range(100))}) + t.read().filter("k IS NULL").count()
    assert [r.v for r in t.read().filter("k = '7'").collect()] == [4]
    t.merge(spark.createDataFrame([], t.schema), 9, "k", "ord")
    assert t.version() == 5 and t.read().filter("k IS NOT NULL").count() == 100
