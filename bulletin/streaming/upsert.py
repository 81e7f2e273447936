"""ST3, ST5: incremental ingest: each micro-batch is merged into a new version of the table,
so readers never see half a version. A version bears the run and the batch that made it: a
batch that comes again is known and changes nothing, and one of a new run, whatever its
number, is merged onto what is there. A run is a checkpoint's life: its id is the one that the
checkpoint's metadata bears, which is new when a checkpoint was deleted, whatever its path.

Rows are dealt to buckets by a hash of their key. A batch rewrites the buckets that its keys
fall in and no others; a version's commit says where each of its buckets is, and is made by
one rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.maintain import upsert

BUCKETS, KEEP = 64, 2


class VersionedTable:
    """``<path>/data/<n>-<run>-<batch>/bucket=<b>`` as Parquet, and ``<path>/commits/<n>-<run>-<batch>`` with the
    directory of every bucket. Directories that the last ``keep`` versions don't use are deleted, so a
    reader has that many merges' time; the number of buckets stays for a table's life."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.path, self.schema, self.buckets, self.keep = spark, path.rstrip("/"), schema, buckets, keep

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _list(self, name: str) -> list[str]:
        root = self._path(name)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []

    def commits(self) -> dict[int, str]:
        """The name of every version's commit by its number."""
        return {int(name.split("-")[0]): name for name in self._list("commits") if not name.startswith("_")}

    def version(self) -> int:
        """The number of the current version; -1 of an empty table."""
        return max(self.commits(), default=-1)

    def _places(self, commits: dict[int, str], n: int) -> dict[int, str]:
        """The directory of every bucket of a version; at most one row a bucket."""
        if n not in commits:
            return {}
        return {r.bucket: r.dir for r in self.spark.read.schema("bucket int, dir string").json(f"{self.path}/commits/{commits[n]}").collect()}

    def _rows(self, places) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in places]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        commits = self.commits()
        return self._rows(self._places(commits, max(commits, default=-1) if version is None else version).values())

    def merge(self, fresh: DataFrame, batch: int, key: str, order: str, run: str = "0") -> None:
        """The current version with ``fresh`` merged in, unless this batch of this run is in
        a version already. ``run`` has letters and digits only."""
        commits = self.commits()
        if f"{run}-{batch}" in {name.split("-", 1)[1] for name in commits.values()}:
            return
        n = max(commits, default=-1) + 1
        name, places = f"{n}-{run}-{batch}", self._places(commits, n - 1)
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")
        touched = [r.b for r in fresh.select(bucket.alias("b")).distinct().collect()]  # at most one row a bucket
        merged = upsert(self._rows(places[b] for b in touched if b in places), fresh, key, order).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        places |= {b: f"data/{name}/bucket={b}" for b in touched}
        listed = self.spark.createDataFrame(sorted(places.items()), "bucket int, dir string")
        listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/_new/{name}")
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(self._path("commits"))
        if not fs.rename(self._path(f"_new/{name}"), self._path(f"commits/{name}")):
            raise OSError(f"the commit of {name} could not be made")
        self._clean(commits | {n: name})

    def _clean(self, commits: dict[int, str]) -> None:
        used = {p.split("/")[1] for n in sorted(commits)[-self.keep :] for p in self._places(commits, n).values()}
        for name in self._list("data"):
            if name not in used and int(name.split("-")[0]) < max(commits):
                path = self._path(f"data/{name}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to: written before its first batch."""
    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first().id.replace("-", "")


def ingest(stream: DataFrame, table: VersionedTable, key: str, order: str, checkpoint: str):
    """Everything that has come since the last run, then the query ends."""
    merge = lambda df, n: table.merge(df, n, key, order, run_of(table.spark, checkpoint))
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge).start()
