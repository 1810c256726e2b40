"""Registered queries against their SQL twins at the smallest scale."""

import duckdb
import pytest

from tools.verify import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = [
    "stratified", "error_suite_slices", "coverage", "featurize", "partition_phases", "physics_predict", "corrections", "anchor_gate_blend",
    "penalty_score", "plausibility", "sanity_sweep", "tolerance_join", "nearest_temp", "apply_ledger", "cell_diff", "wilcoxon", "spearman",
    "stratified_split", "ratio_split", "group_split", "filter_rank", "distractors", "extract_choice", "friedman", "scan_tolerant", "flat_export",
    "to_triples", "hop_join", "keyword_search", "vector_search", "knn1", "latest_state_ttl", "stream_validate", "stream_resume",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    msg = compare(df.columns, df.collect(), [d[0] for d in cur.description], cur.fetchall())
    assert msg is None, msg


def test_entry_and_registry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


def test_stream_and_batch_agree(spark, tmp_path):
    from __spark_entry__ import queries
    from meltwise.streaming import jobs

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    jobs.validate_stream(jobs.stream_arrivals(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"))
    rows = lambda df: sorted(map(tuple, df.select("window_start", "check", "n").collect()))
    assert rows(jobs.validated(spark, str(tmp_path / "out"), events.schema)[1]) == rows(queries()["batch_validate"](spark, SF))


def test_state_stream_ends_where_the_batch_does(spark):
    from __spark_entry__ import queries

    out = {(r.reason, r.status): r.n for r in queries()["stream_state"](spark, SF).collect()}
    assert sum(n for (reason, _), n in out.items() if reason == "update") > 0
