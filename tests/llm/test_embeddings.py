import numpy as np
import pytest


def plain(rows, least=0.93):
    n = len(rows)
    unit = []
    for _, e, label in rows:
        ok = label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        unit.append(np.array(e, float) / np.linalg.norm(np.array(e, float)) if ok else None)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), c, rows[i][0] == c))
    return sorted(out, key=repr)


@pytest.fixture()
def vectors():
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.08 * r.normal(size=16)).tolist(), i % 2) for i in range(160)]
    rows += [(500 + i, base[0].tolist(), 0) for i in range(5)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [1.0, None] + [0.0] * 14, 0), (604, base[0].tolist(), None), (605, [1.0, 2.0], 0), (606, [], 0), (607, [float("inf")] * 16, 1)]
    rows += [(None, base[0].tolist(), 0), (None, base[39].tolist() + [1.0], 1), (500, base[0].tolist(), 0)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_links_and_components(spark, vectors):
    from meltwise.llm.embeddings import near_duplicates

    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(vectors, SCHEMA)).collect()), key=repr)
    want = plain(vectors)
    assert [g[0] for g in got] == [w[0] for w in want]
    links, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and links >= 0.95 * true


@pytest.mark.parametrize("tables", [2, 3, 5])
def test_near_codes_always_meet(spark, tables):
    from meltwise.llm.embeddings import REACH, code_pairs

    r = np.random.default_rng(4)
    codes = []
    for c in r.integers(-(1 << 62), 1 << 62, 40).tolist():
        bits = r.choice(63, REACH, replace=False)
        codes += [c, c ^ sum(1 << int(b) for b in bits)]
    df = spark.createDataFrame([(1, c) for c in codes], "key int, code long").dropDuplicates()
    got = {(r.a, r.b) for r in code_pairs(df, tables, 64).collect()}
    want = {tuple(sorted(p)) for i, a in enumerate(codes) for b in codes[:i] if a != b and bin((a ^ b) % (1 << 64)).count("1") <= REACH for p in [(a, b)]}
    assert want <= got


def test_nothing_and_odd_columns(spark, vectors):
    from pyspark.sql import functions as F

    from meltwise.llm.embeddings import near_duplicates

    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], None)], SCHEMA)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    df = spark.createDataFrame(vectors, SCHEMA).select("*", F.lit(1).alias("_c"), F.lit(2).alias("code"), F.lit(3).alias("n"))
    assert near_duplicates(df).count() == len(vectors)


def test_recall_on_the_given_vectors(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.1"
    got = {r.vec_id: r.n_links for r in queries()["op10_embeddings"](spark, sf).collect()}
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(v.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = ((x @ x.T >= 0.93) & (v.label.to_numpy()[:, None] == v.label.to_numpy())).sum(1) - 1
    assert all(got[i] <= n for i, n in zip(v.vec_id, near, strict=True))
    assert sum(got.values()) >= 0.95 * near.sum()
