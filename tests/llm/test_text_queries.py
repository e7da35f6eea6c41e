"""The text queries beside their SQL, and the pipeline, on the smallest tables."""

import os

import pytest

import __spark_entry__ as spark_entry
from check import TABLES, canonical

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
WITH_SQL = ("op3_url_filters", "op6_ngram_jaccard_join", "op8_line_dedup", "op10_mixing_sources", "op11_phrase_collocations", "op13_warc")


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = canonical(spark_entry.queries()[name](spark, SMALL).toPandas())
    want = canonical(con.execute(spark_entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_all_operators_and_the_pipeline_are_registered():
    names = spark_entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_stages_only_take_rows_away(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, SMALL))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and ids, name
        before = ids
