"""The corpus pipeline, stage by stage and as a whole."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    from __spark_entry__ import oracle_sql, queries

    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert {f"op{n}_" for n in range(1, 11)} <= {n[: n.index("_") + 1] for n in names if n != "pipeline"} and "pipeline" in names
    assert {"op4_secrets", "op9_mix", "op10_embeddings"} <= set(oracle_sql())


@pytest.mark.parametrize("name", ["op4_secrets", "op9_mix", "op10_embeddings"])
def test_matches_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries

    from tools.verify import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    assert compare(df.columns, df.collect(), [d[0] for d in cur.description], cur.fetchall()) is None


def test_stages_and_run(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == start, name
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= before and ids, name
        before = ids
    rows = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    final = rows(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert final == rows(corpus_pipeline.run(spark, SF)) and {r[1] for r in final} == set(range(8))


@pytest.mark.parametrize("rows", [0, 3])
def test_stages_on_odd_input(spark, odd, rows):
    import corpus_pipeline

    docs = odd if rows else odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).collect()
        assert len(got) <= docs.count() or name == "source_mixing"
