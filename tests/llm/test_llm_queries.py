"""The registered queries against their SQL, and the pipeline."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from lakeloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    shown = lambda r: str(tuple(f"{x:.10g}" if isinstance(x, float) else x for x in r))
    assert sorted(map(shown, got)) == sorted(shown([r[i] for i in order]) for r in rel.fetchall())


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        rows = out.collect()
        assert 0 < len(rows) <= len(texts) and {r["doc_id"] for r in rows} <= set(texts)
        assert all(r["text"] == texts[r["doc_id"]] for r in rows) or name == "substring_dedup"
        docs = spark.createDataFrame(rows, docs.schema)
        texts = {r["doc_id"]: r["text"] for r in rows}
    last = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "rate", "copy"} <= set(last.columns) and last.count() > 0


def test_stages_take_any_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").withColumn("part", F.when(F.col("doc_id") >= 0, 1)).withColumn("kept", F.when(F.col("doc_id") >= 0, "x"))
    kind = docs.schema
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (7001, None, "en", "s", 0, 1, "k"), (7002, "", None, "s", 0, 1, "k"), (7003, "word " * 30000, "en", "s", None, 1, None), (7003, "word " * 30000, "en", "s", None, 1, None)], kind)
    given = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SF)
        assert name == "mixing" or out.columns == given.columns
        rows = out.collect()
        assert rows, name
        if name == "near_dedup":
            assert any(r["doc_id"] is None for r in rows) and any(r["doc_id"] == 7001 for r in rows)
        assert stage(spark, given.limit(0), SF).count() == 0, name
