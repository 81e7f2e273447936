"""Session settings shared by the jobs, tests and bench of this library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, app: str = "bulletin", **conf) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this library where it isn't installed."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    found = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in found:
        env["PYTHONPATH"] = os.pathsep.join([root, *found])
    return spark


def ready_to_checkpoint(spark: SparkSession) -> None:
    """See that checkpoints have a folder: the shared one that spark.checkpoint.dir names,
    and only on a local master where that is unset one of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "bulletin-checkpoints"))


class Rounds:
    """Tables of an iteration beside the checkpoints, each written before the next round reads it;
    of those under one name only the last stays."""

    def __init__(self, spark: SparkSession, label: str):
        ready_to_checkpoint(spark)
        self.spark, self.root, self.n = spark, f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}", 0
        self.last: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str = "rows") -> DataFrame:
        self.n += 1
        path, schema = f"{self.root}/{name}-{self.n}", df.schema
        df.write.parquet(path)
        if name in self.last:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.last[name])
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.last[name] = path
        return self.spark.read.schema(schema).parquet(path)
