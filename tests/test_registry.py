"""Every registered query of the library runs, and equals its SQL where it has one."""

import duckdb
import pandas as pd
import pytest

from bulletin import page_queries, registry  # noqa: F401  (page_queries registers its own)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def say(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)[:19].removesuffix(" 00:00:00") if not isinstance(v, str | bool) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([say(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_runs_without_the_training_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", None)
    assert set(entry.queries()) == set(registry.QUERIES) and entry.entry(spark).count() > 0


@pytest.mark.parametrize(("name", "t"), [("document_titles", "documents"), ("document_times", "documents"), ("page_dates", "pages"), ("late_events", "events")])
def test_functions_run_over_whole_tables(spark, sf_dir, name, t):
    assert registry.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{t}.parquet").count()


def test_whole_text_is_searched(spark, sf_dir):
    late = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en' AND source = 'src3' AND lower(text) LIKE '%the%'").collect()}
    assert {r.ord for r in registry.QUERIES["facet_search_text"](spark, sf_dir).collect()} == late
