"""The training-data pipeline: documents -> packed sequences.

Each stage works on all that the one before kept, is written as Parquet and read again:
language ID drops what it rejects, the n-gram join keeps one document of each group, the
suffix dedup cuts repeated passages, and best-fit packing fills the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bulletin.llm import langid, packing, partenum, suffixes
from bulletin.llm.common import Scratch, table

#: A document goes if its text has no letters, or if less than this share of its grams is
#: known in any language. The score can't tell: it only compares the languages, is at least
#: one over their number, and is high for gibberish whose few letters are rarer in the others.
LEAST_KNOWN = 0.5

#: Bytes from which a string that stands twice is a repeated passage: fewer than any passage
#: of over 50 words has in running text.
PASSAGE = suffixes.PASSAGE


def columns_of(docs: DataFrame) -> list:
    return [docs[f"`{c}`"] for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Rows alike in id and text share a
    verdict."""
    verdicts = langid.identify(docs, with_share=True)
    bad = verdicts.filter((F.col("lang_pred") == langid.UNKNOWN) | (F.col("known") < LEAST_KNOWN)).select("doc_id", "text_hash").distinct()
    own = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, own, "left_anti").select(*columns_of(docs))


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the least id, and of that id one
    row of each text; of rows without an id one of each text, too."""
    groups = partenum.jaccard_join(docs)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*columns_of(docs))
    return kept.dropDuplicates(["doc_id", "text"])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat."""
    return suffixes.strip_repeats(docs, PASSAGE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language ID", lambda spark, docs, sf_dir: language_id(spark, docs, sf_dir)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: ngram_dedup(spark, docs, sf_dir)),
    ("suffix-array dedup", lambda spark, docs, sf_dir: suffix_dedup(spark, docs, sf_dir)),
    ("best-fit packing", lambda spark, docs, sf_dir: best_fit_packing(spark, docs, sf_dir)),
]

#: Tokenizers aren't expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
