"""The pipeline stage by stage against its contracts, and every corpus query on the smallest tables."""

import duckdb

import __spark_entry__
import corpus_pipeline
from strataframe.llm.common import table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.count()
        assert 0 < after <= before and (name != "line_dedup" or after == before)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r)[:5] for r in pieces}


def test_stages_on_an_empty_table_with_clashing_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("*", "1 as kept", "2 as n_dropped", "3 as class_id")
    for rows in (docs.where("false"), docs.where("doc_id < 20")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, sf_dir).collect()


def test_queries_and_sql(spark, sf_dir):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    names = [n for n in queries if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in queries
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for n in names:
        rows = queries[n](spark, sf_dir).collect()
        assert rows
        if n in sql:
            rel = db.sql(sql[n])
            assert sorted(tuple(r[c] for c in rel.columns) for r in rows) == sorted(rel.fetchall())
