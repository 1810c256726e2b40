"""Queries on small tables that hold what only larger ones show."""

import re

import duckdb

from tools.verify import compare


def against_sql(spark, folder, name, **tables):
    """Write the tables, run the query on them, and compare it with its SQL."""
    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, df in tables.items():
        path = str(folder / f"{table}.parquet")
        df.coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = queries()[name](spark, str(folder))
    cur = con.execute(oracle_sql()[name])
    return compare(df.columns, df.collect(), [d[0] for d in cur.description], cur.fetchall())


def test_drivers_counts_the_smallest_phase_shares(spark, tmp_path):
    """0.0065 at% of Re in a phase decides whether its contribution passes 0.01."""
    parts = [(8, 48.0), (9, 1.0), (11, 42.0), (12, 32.0)]
    lines = spark.createDataFrame([(1, idx - 1, q) for idx, q in parts], "l_orderkey long, l_partkey long, l_quantity double")
    assert against_sql(spark, tmp_path, "drivers", lineitem=lines) is None


SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_spread_once_over_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    from __spark_entry__ import queries
    from meltwise.plans import fixtures

    monkeypatch.setattr(fixtures, "LINES_A_TASK", 100)
    lines = fixtures.Tables(spark, SF).lines
    assert lines.rdd.getNumPartitions() == -(-lines.count() // 100)
    for name in ("entity_mean_error", "bootstrap_point", "contribution", "leave_one_out", "best_per_property", "headline_score", "campaign_compare"):
        plan = plan_of(queries()[name](spark, SF))
        assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(entity" not in plan, name


def test_stratified_and_common_rows_shuffle_no_predictions(spark):
    from __spark_entry__ import queries

    plan = plan_of(queries()["stratified"](spark, SF))
    assert "ShuffledHashJoin" in plan and "hashpartitioning(entity#" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning(arm#" in plan and ", entity#" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan_of(queries()["common_rows"](spark, SF))))


def test_order_check_with_equal_values(spark, tmp_path):
    """Equal values stand in the order of the first listing, however the rows lie."""
    from __spark_entry__ import queries

    lines = spark.createDataFrame([(o, s, 4, 100.0) for o in range(30) for s in range(9)], "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = queries()["order_check"](spark, str(tmp_path)).collect()
    assert len(rows) == 30 and all(r.same_order for r in rows)


def test_triples_are_written_where_they_are(spark, tmp_path):
    """One predicate of many rows is not gathered in one task."""
    from pyspark.sql import functions as F

    from meltwise.sources import records

    x = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("s"), "id").alias("s"), F.lit("o").alias("o"), F.lit("data").alias("graph"), F.lit("type").alias("p"))
    records.replace_triples(x, str(tmp_path / "t"))
    assert len(list((tmp_path / "t/graph=data/p=type").glob("*.parquet"))) == 4
    records.replace_triples(x.limit(10), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_near_dup_lays_its_grid_over_every_element(spark, tmp_path, monkeypatch):
    """Compositions that differ only in V, Mn, Si, B, C, Zr, Ru or Cu do not all meet in one cell."""
    from __spark_entry__ import queries
    from meltwise.operators import neighbours

    rows = [(e, p, float(q)) for e in range(1500) for p, q in ((14, e % 40 + 1), (15, e % 37 + 1), (16, e % 29 + 1))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, grid = [], neighbours.near_pairs
    monkeypatch.setattr(neighbours, "near_pairs", lambda points, eps, dims, **more: seen.append(dims) or grid(points, eps, dims, **more))
    assert queries()["near_dup"](spark, str(tmp_path)).count() == 1500
    assert sorted(seen[0]) == list(range(len(neighbours.ELEMENTS)))


def test_patterns_store_only_the_triples_they_follow(spark):
    from meltwise.operators import graph
    from meltwise.plans import fixtures, source_queries

    t = fixtures.Tables(spark, SF)
    held = lambda x: {r.p for r in x.select("p").distinct().collect()}
    assert held(source_queries.composition_triples(t)) == graph.COMPOSITION_CHAIN
    assert held(source_queries.measurement_triples(t)) == graph.MEASUREMENT_CHAIN
    assert held(source_queries.measurement_triples(t, graph.POINTS_CHAIN)) == graph.POINTS_CHAIN


def test_offsets_deal_no_rows_by_property(spark):
    """Rows are counted and joined where they are; only counts, brackets and medians are dealt by property."""
    from meltwise.operators import metrics
    from pyspark.sql import functions as F

    x = spark.range(0, 5000, 1, 4).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 4999 / 3.0).alias("x"))
    got = metrics.exact_quantiles(x, ["g"], "x", [0.5], accuracy=100, small=0, few=True)
    want = {r.g: r.q for r in x.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("q")).collect()}
    assert {r.g: round(r.q500, 9) for r in got.collect()} == {g: round(q, 9) for g, q in want.items()}
    plan = plan_of(metrics.exact_quantiles(x, ["g"], "x", [0.5], few=True))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_vector_search_shuffles_vectors_once(spark):
    """All rows as queries: what is shuffled stays near the vectors' own size, however many blocks there are."""
    import numpy as np

    from meltwise.operators.retrieval import cosine_top_k

    m = np.random.default_rng(3).normal(size=(12_000, 64))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    before = shuffled_bytes(spark)
    got = cosine_top_k(e.selectExpr("vec_id AS qid", "embedding"), e.selectExpr("vec_id AS rid", "embedding"), 5, skip_self=True)
    got = {(r.qid, r["rank"]): r.rid for r in got.collect()}
    assert sum(v for s, v in shuffled_bytes(spark).items() if s not in before) < 4 * m.nbytes
    m /= np.sqrt((m * m).sum(1))[:, None]
    for q in range(0, 12_000, 1_000):
        near = m @ m[q]
        near[q] = -2
        assert [got[q, i] for i in range(1, 6)] == np.argsort(-near)[:5].tolist()


def test_nearest_of_all_on_ties_copies_and_zeros(spark):
    import numpy as np

    from meltwise.operators.retrieval import cosine_top_k

    r = np.random.default_rng(4)
    m = np.round(r.normal(size=(150, 3)))  # many vectors of one direction, and some without any
    m[100:140] = [1.0, 2.0, 2.0]
    m[7] = 0.0
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    for k in (1, 5):
        got = cosine_top_k(e.selectExpr("vec_id AS qid", "embedding"), e.selectExpr("vec_id AS rid", "embedding"), k, skip_self=True).collect()
        size = np.sqrt((m * m).sum(1))[:, None]
        unit = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        far = np.sqrt(((unit[:, None] - unit[None]) ** 2).sum(2)).round(9)
        want = {(q, i + 1): x for q in range(150) for i, x in enumerate([x for x in np.lexsort((np.arange(150), far[q])) if x != q][:k])}
        assert {(x.qid, x["rank"]): x.rid for x in got} == want
