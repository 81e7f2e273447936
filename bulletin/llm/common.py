"""What the training-data operators share: table reads, scratch tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; only on a local master where that is
    unset (tests, a laptop) a folder of this machine is chosen and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = "file://" + os.path.join(tempfile.gettempdir(), "bulletin-scratch")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished writes now. It does so when the
    driver's garbage is collected, which may otherwise be long after the disk is needed."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written to the shared folder to cut lineage, each under its own name.

    A lost executor costs nothing that was written here: files are committed and shared.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        """Write ``df``, with the writer's ``options``, and return it as read from there."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        schema = df.schema
        df.write.mode("overwrite").options(**options).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        release(self.spark)
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table kept here; nothing lazily built on it may still be pending."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give memory back. Spark keeps Python workers for the next stage, so what one stage
    needed would otherwise count beside what the next one needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over batches that gives its memory back at the end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def tidy_group(run):
    """A function of one group that gives its memory back."""

    def wrapped(pdf):
        out = run(pdf)
        if len(pdf) > 200:
            trim()
        return out

    return wrapped
