import itertools
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from meltwise.operators import correct, graph, joins, metrics, neighbours, ranks
from meltwise.sources.records import parse_tolerant


def vec_table(spark, name, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, vec array<double>")


def test_nearest_matches_brute_force_with_small_blocks(spark):
    rnd = random.Random(3)
    pts = [(i, [rnd.choice([0, 1, 2, 5, 9]) + (0.001 if i % 7 == 0 else 0) for _ in range(4)]) for i in range(300)]
    pts += [(300 + i, [1, 1, 1, 1]) for i in range(100)]  # a quarter of the rows are copies
    got = neighbours.nearest(vec_table(spark, "qid", pts), vec_table(spark, "rid", pts), 3, skip_self=True, block=40).collect()
    found = {}
    for r in got:
        found.setdefault(r.qid, []).append((r["rank"], r.rid, round(r.distance, 6)))
    m = np.array([v for _, v in pts], float)
    for i, (qid, _) in enumerate(pts):
        d = np.sqrt(((m - m[i]) ** 2).sum(1)).round(9)
        best = sorted((d[j], pts[j][0]) for j in range(len(pts)) if j != i)[:3]
        mine = sorted(found[qid])
        assert [x[1] for x in best] == [r for _, r, _ in mine]
        assert np.allclose([x[0] for x in best], [dist for _, _, dist in mine], atol=2e-6)


def test_near_duplicates_match_the_greedy_loop(spark):
    rnd = random.Random(5)
    pts = []
    for i in range(200):
        base = rnd.choice([0.0, 1.0, 2.0])
        pts.append((i, [base + rnd.choice([0, 0.004, 0.008, 0.012, 0.5]), base, rnd.choice([0.499, 0.501])]))
    got = {r.id: (r.accepted, r.duplicate_of) for r in neighbours.near_duplicates(vec_table(spark, "id", pts), 0.01, [0, 1, 2]).collect()}
    kept = []
    for i, v in pts:
        near = [k for k, kv in kept if sum((a - b) ** 2 for a, b in zip(v, kv)) < 0.01 ** 2]
        assert got[i][0] == (not near), i
        if near:
            assert got[i][1] in [k for k, _ in kept] and got[i][1] == near[0]
        else:
            kept.append((i, v))


def test_exact_quantiles_through_the_bracket_path(spark):
    rnd = random.Random(1)
    rows = [("a" if i % 3 else "b", rnd.choice([1.0, 2.0, 2.0, rnd.random() * 100])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q500, r.q900) for r in metrics.exact_quantiles(df, ["g"], "x", [0.5, 0.9], accuracy=200, small=0).collect()}
    for g in "ab":
        v = [x for k, x in rows if k == g]
        assert np.allclose(got[g], np.percentile(v, [50, 90]))


def test_ranks_and_signed_rank(spark):
    rnd = random.Random(2)
    rows = [(i, "g", float(rnd.randint(-6, 6))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, d double")
    r = {x.id: x.k for x in ranks.row_ranks(df, ["g"], "d", "id", "k").collect()}
    assert [i for i, _ in sorted(r.items(), key=lambda kv: kv[1])] == [i for i, _, d in sorted(rows, key=lambda t: (t[2], t[0]))]
    nz = [d for _, _, d in rows if d]
    mags = sorted(abs(d) for d in nz)
    mid = {m: statistics.mean(i + 1 for i, x in enumerate(mags) if x == m) for m in set(mags)}
    w = min(sum(mid[abs(d)] for d in nz if d > 0), sum(mid[abs(d)] for d in nz if d < 0))
    s = ranks.signed_rank(df, ["g"], "d").first()
    assert s.w == w and s.n_nonzero == len(nz) and s.wins == sum(d < 0 for d in nz)


def test_leave_one_out_matches_brute_force(spark):
    sums = [("p", i, 10.0 + i, 12.0 + (i * 7) % 5) for i in range(5)]
    r = metrics.leave_one_out(spark.createDataFrame(sums, "property string, entity long, s_new double, s_ref double"), ["property"]).first()
    change = lambda xs: 100 * (sum(x[2] for x in xs) - sum(x[3] for x in xs)) / sum(x[3] for x in xs)
    rest = [change([x for x in sums if x[1] != e]) for e in range(5)]
    assert abs(r.loo_min - min(rest)) < 1e-9 and abs(r.loo_max - max(rest)) < 1e-9 and abs(r.point - change(sums)) < 1e-9


def test_bootstrap_repeats_and_brackets(spark):
    rows = [("p", i, 9.0 + i % 4, 10.0 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "property string, entity long, s_new double, s_ref double")
    a = metrics.cluster_bootstrap(df, ["property"], draws=100).first()
    b = metrics.cluster_bootstrap(df.repartition(7), ["property"], draws=100).first()
    assert abs(a.lo - b.lo) < 1e-9 and a.lo <= a.point <= a.hi


def test_bootstrap_makes_the_plain_draws_with_blocks_of_any_size(spark):
    """One block or several, groups smaller than a part, and several tasks in a partition."""
    rows = [(g, i, 9.0 + (i * 7) % 11, 10.0 + i % 3) for g, n in (("p", 700), ("q", 3), ("r", 256)) for i in range(n)]
    df = spark.createDataFrame(rows, "property string, entity long, s_new double, s_ref double")
    whole, blocks = (sorted(metrics.cluster_bootstrap(df, ["property"], 50, b).collect()) for b in (None, 256))
    assert [r.n_entities for r in whole] == [700, 3, 256]
    assert all(abs(x - y) < 1e-9 for a, b in zip(whole, blocks, strict=True) for x, y in zip(a[1:], b[1:], strict=True))
    picks = lambda d, n: [(int(metrics.mixed(np.array([metrics.mixed(np.array([i], np.uint32))[0] ^ metrics.mixed(np.array([d + 0x5BD1E995], np.uint32))[0]]))[0]) * n) >> 32 for i in range(n)]
    change = lambda e: 100 * (sum(rows[i][2] for i in e) - sum(rows[i][3] for i in e)) / sum(rows[i][3] for i in e)
    drawn = [change(picks(d, 700)) for d in range(50)]
    assert abs(whole[0].lo - np.quantile(drawn, 0.025)) < 1e-9 and abs(whole[0].hi - np.quantile(drawn, 0.975)) < 1e-9


def test_first_in_list_and_ties(spark):
    m = spark.createDataFrame([(1, "ys", 1, 23, 5.0), (1, "ys", 2, 20, 7.0), (1, "ys", 3, 18, 9.0)], "entity long, property string, pos int, temp_c int, value double")
    rows = spark.createDataFrame([(1, 20)], "entity long, at int")
    assert joins.tolerance_join(rows, m, ["entity"]).first().value == 5.0  # first in list, not nearest
    assert joins.nearest_temperature(m, ["entity"], F.lit(19)).first().value == 7.0  # tie keeps the first


def test_ledger_outcomes(spark):
    cells = spark.createDataFrame([(1, "Cr", 5.0), (1, "Al", 2.0), (2, "Cr", 3.0)], "entity long, component string, value double")
    edits = spark.createDataFrame([(1, "Cr", 6.0), (1, "Al", None), (1, "Y", 1.0), (2, "Al", None)], "entity long, component string, to_value double")
    got = {(r.entity, r.component): (r.value, r.outcome) for r in joins.apply_ledger(cells, edits, ["entity", "component"]).collect()}
    assert got == {(1, "Cr"): (6.0, "set"), (1, "Al"): (None, "withdrawn"), (1, "Y"): (1.0, "added"), (2, "Cr"): (3.0, "kept"), (2, "Al"): (None, "absent")}


def test_corrections_are_idempotent(spark):
    grid = list(itertools.product([300.0, 900.0], [200.0, 1600.0], [5.0, 40.0], [120.0, 260.0], ["cast", "wrought"], ["sss", "gp", "sc_ds"], [10.0, 50.0, 70.0]))
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], "id long, ys double, uts double, el double, em double, route string, alloy_class string, gp double")
    df = df.withColumns({"vrh": F.lit(210.0), "temp_c": F.lit(20)})
    once = correct.corrections(df, ("ys", "uts", "el", "em"))
    cols = ["cor_ys", "cor_uts", "cor_el", "cor_em"]
    again = once.select("id", "route", "alloy_class", "gp", "vrh", "temp_c", *[F.col(x).alias(x[4:]) for x in cols])
    twice = correct.corrections(again, ("ys", "uts", "el", "em"))
    a = {r.id: tuple(round(r[x], 6) for x in cols) for r in once.collect()}
    b = {r.id: tuple(round(r[x], 6) for x in cols) for r in twice.collect()}
    assert a == b


def test_tolerant_lines(spark):
    lines = ["==> a <==", "", '{"alloy": "A", "composition": {"Ni": 60}}', "{'alloy': 'B', 'form': None, 'composition': {'Ni': 50.5}}", "{broken"]
    p = parse_tolerant(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.outcome for r in p.collect()] == ["header", "blank", "json", "literal", "rejected"]
    got = p.where("record is not null").select("record.alloy", F.col("record.composition")["Ni"].alias("ni")).collect()
    assert [(r.alloy, r.ni) for r in got] == [("A", 60.0), ("B", 50.5)]


def test_nearest_returns_only_what_is_within_reach_and_carries_columns(spark):
    """A block searched with a known k-th distance gives back nothing beyond it, and a reference's columns come along."""
    g = np.random.default_rng(2)
    pts = np.where(g.random((900, 6)) < 0.6, 0.0, g.integers(1, 40, (900, 6)) * 1.0)
    ids = np.arange(900)
    known = np.sort(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)), axis=1)[:, 3]
    got = [(i, j) for a, b, d in neighbours._within(pts, ids, known, pts, ids, 50, 51, True) for i, j in zip(a, b)]
    for i, j in got:
        assert np.sqrt(((pts[i] - pts[j]) ** 2).sum()) <= known[i] + 1e-5
    refs = vec_table(spark, "rid", list(enumerate(pts.tolist()))).withColumn("tag", F.concat(F.lit("t"), "rid"))
    rows = neighbours.nearest(vec_table(spark, "qid", list(enumerate(pts.tolist()))), refs, 3, skip_self=True, block=60, carry=("tag",)).collect()
    assert len(rows) == 2700 and all(r.tag == f"t{r.rid}" for r in rows)
    far = {(r.qid, r["rank"]): r.distance for r in rows}
    assert np.allclose([far[i, 3] for i in range(900)], known, atol=1e-6)


def test_compositions_fall_back_to_the_nominal_value(spark):
    quantities = {"Ni": [("numericValue", "55.5"), ("nominal", "50"), ("nominal", "51")], "Cr": [("nominal", "20")], "Al": [("numericValue", "bal."), ("nominal", "5")], "W": [("unitSymbol", "%")]}
    rows = [("variant/1", "hasComposition", "comp/1")]
    for e, values in quantities.items():
        rows += [("comp/1", "hasComponent", f"entry/1_{e}"), (f"entry/1_{e}", "element", f"element/{e}"), (f"entry/1_{e}", "hasMassFraction", f"quantity/1_{e}"), (f"element/{e}", "label", e)]
        rows += [(f"quantity/1_{e}", p, o) for p, o in values]
    got = graph.compositions_from(spark.createDataFrame(rows, "s string, p string, o string")).collect()
    assert sorted(map(tuple, got)) == [("variant/1", "Al", 5.0), ("variant/1", "Cr", 20.0), ("variant/1", "Ni", 55.5)]


def test_a_block_is_searched_exactly_with_few_comparisons(monkeypatch):
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.random((12000, 4)), np.repeat(rng.random((3, 4)), 200, axis=0)])
    ids, few = rng.permutation(len(m)), np.arange(0, len(m), 3)
    known = np.where(few % 2 == 0, np.inf, 0.1)
    compared = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def nonzero(self, x):
            compared.append(x.size if x.ndim == 2 else 0)
            return np.nonzero(x)

        def flatnonzero(self, x):
            compared.append(x.size if x.ndim == 2 else 0)
            return np.flatnonzero(x)

    monkeypatch.setattr(neighbours, "np", Counting())
    got = {i: [] for i in range(len(few))}
    for i, j, d in neighbours._within(m[few], ids[few], known, m, ids, 3, 4, True):
        for a, b, x in zip(i, j, d):
            got[a].append((round(x, 9), ids[b]))
    for a in range(0, len(few), 40):
        d = np.sqrt(((m - m[few[a]]) ** 2).sum(1))
        near = [x for x in np.lexsort((ids, d.round(9))) if ids[x] != ids[few[a]] and d[x] <= known[a]][:3]
        assert [x for _, x in got[a]] == list(ids[near])
    assert sum(compared) / len(few) < 2500
