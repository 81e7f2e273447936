"""The pipeline against its parts, and the registered queries of the operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bulletin.llm import queries


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_keep_columns(spark, documents, sf_dir):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns, name
        assert docs.dtypes == documents.dtypes, name


def test_stages_decide(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (2, text + " end", "en", "s", 1), (3, "12345", "en", "s", 5), (None, None, None, None, None), (4, "a short clean text", "en", "s", 5), (4, "a short clean text", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_dedup(spark, kept, sf_dir).collect()) == [1, 4]
    cut = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, docs, sf_dir).collect()}
    assert cut[1].text == "" and cut[2].text.strip() in ("", "end") and cut[3].text == "12345" and cut[None].text is None
    assert cut[1].n_chars == 0


def test_lettered_gibberish_goes(spark, sf_dir, documents):
    short = ["Erinst resh.", "That it.", "Pachque çaneux et.", "The cat sat on the mat."]
    junk = ["zxqv kjwq", "xqzj vkq wxz jjq", "漢字かな", "qwpfxz vbkkj zzxw kqj " * 20]
    rows = [(10_000_000 + i, t, "en", "s", len(t)) for i, t in enumerate(short + junk)]
    docs = documents.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("lang", F.lit(None).cast("string")))
    kept = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf_dir).select("doc_id").collect())
    assert [i for i in kept if i >= 10_000_000] == [10_000_000 + i for i in range(len(short))]
    clean = [r.doc_id for r in documents.filter(F.col("text").rlike("[a-zA-Z]")).select("doc_id").collect()]
    assert [i for i in kept if i < 10_000_000] == sorted(clean)


def test_run_is_its_stages(spark, sf_dir, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    want = sorted(tuple(r)[:5] for r in docs.collect())
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()) == want and want


def test_pipeline_of_nothing(spark, documents, sf_dir):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs_over_all_rows(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "embeddings")}
    rows = got.count()
    assert rows > 0
    if name.split("_")[0] in ("op1", "op2", "op5", "op6", "op9"):
        assert rows == n["documents"]
    if name.startswith("op3"):
        assert rows == n["embeddings"]
