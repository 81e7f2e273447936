"""Delta-maintained token counts (operator 4).

Totals of documents and tokens by source, language and tokenizer version are additive, so
every change is a signed row: an insert adds, a delete subtracts, a revised count subtracts
the old and adds the new. A batch is reduced to one signed row for each group and written
as one partition of the ledger, ``batch=<id>``. Writing replaces that partition as a whole,
so a batch committed twice, or again after a failure, counts once. Totals are the sum over
the ledger; ``compact`` folds committed batches into one.

All built-in functions: partial sums run before the only shuffle, whose rows are one for
each task and group, however hot a source is.

Defined cases: null source or language is a group of its own; a null text has no tokens but
is a document; repeated rows count each; groups whose documents sum to none are left out
of totals; an empty batch commits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import scratch_dir

KEYS = ("source", "lang", "version")
_DELTA = "source string, lang string, version string, d_docs bigint, d_tokens bigint"


def inserts(counted: DataFrame) -> DataFrame:
    """Signed rows that add documents: (source, lang, version, tokens)."""
    return counted.select(*KEYS, F.lit(1).cast("bigint").alias("d_docs"), F.col("tokens").cast("bigint").alias("d_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Signed rows that take documents out again, with the counts they were added with."""
    return counted.select(*KEYS, F.lit(-1).cast("bigint").alias("d_docs"), (-F.col("tokens")).cast("bigint").alias("d_tokens"))


def revisions(counted: DataFrame) -> DataFrame:
    """Signed rows for documents counted anew: (source, lang, version, old_tokens, tokens)."""
    return counted.select(*KEYS, F.lit(0).cast("bigint").alias("d_docs"), (F.col("tokens") - F.col("old_tokens")).cast("bigint").alias("d_tokens"))


class Ledger:
    """The committed deltas under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch_id: str, signed: DataFrame) -> None:
        """Commit a batch of signed rows; doing so again replaces it."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        delta = signed.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        delta.filter("d_docs <> 0 OR d_tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def batches(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = (s.getPath() for s in fs.listStatus(root))
        return sorted(p.getName()[6:] for p in found if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def deltas(self) -> DataFrame:
        if not (ids := self.batches()):
            return self.spark.createDataFrame([], _DELTA)
        return self.spark.read.schema(_DELTA).parquet(*(f"{self.path}/batch={b}" for b in ids))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens."""
        sums = self.deltas().groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")


def new_ledger(spark: SparkSession, name: str) -> Ledger:
    import uuid

    return Ledger(spark, f"{scratch_dir(spark)}/ledger-{name}-{uuid.uuid4().hex}")


def word_tokens(text: Column) -> Column:
    """Runs that are no ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def letter_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character that is no white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]")), F.lit(0)).cast("bigint")


def byte_tokens(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
