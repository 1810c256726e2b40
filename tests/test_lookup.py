import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from meltwise.operators import lookup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(measure, a, b):
    return SequenceMatcher(None, a, b).ratio() if measure is lookup.RATIO else 1 - edits(a, b) / max(len(a), len(b))


def some_names(n, seed, longest):
    r = random.Random(seed)
    out = {"".join(r.choice("abcd e1") for _ in range(r.randrange(1, longest))).strip() or "q" for _ in range(n)}
    out |= {x[:2] + r.choice("xyz") + x[3:] for x in list(out)[: n // 3]}
    return sorted(out)


@pytest.mark.parametrize("measure", [lookup.EDIT, lookup.RATIO])
@pytest.mark.parametrize("least", [0.8, 0.7, 0.5, 0.3])
def test_no_pair_over_the_threshold_is_lost(spark, measure, least):
    a, b = some_names(60, 1, 14), some_names(60, 2, 9)
    keys = lambda x: spark.createDataFrame([(i,) for i in x], "k string")
    got = {(r.a, r.b): r.score for r in lookup.similar_pairs(keys(a), keys(b), measure, least).collect()}
    want = {(x, y): plain(measure, x, y) for x in a for y in b if plain(measure, x, y) >= least - 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("measure", [lookup.EDIT, lookup.RATIO])
def test_best_match_is_that_of_all_pairs(spark, measure):
    names = some_names(80, 3, 12) + ["Ünique*", "Rene N5 cast", "rene n5 (forged)"]
    targets = some_names(50, 4, 12) + ["unique", "RENÉ N5", "a", "e1", "", None]
    got = {r.target: (r.match, round(r.score, 6)) for r in lookup.best_match(spark.createDataFrame([(x,) for x in targets], "target string"), spark.createDataFrame([(x,) for x in names], "name string"), measure).collect()}
    keyed = {}
    for r in spark.createDataFrame([(x,) for x in names], "name string").select("name", F.trim(lookup.fold_accents(lookup.core_name(F.col("name")))).alias("k")).collect():
        if r.k:
            keyed[r.k] = min(keyed.get(r.k, r.name), r.name)
    want = {}
    for t in targets:
        k = (t or "").strip().lower().replace("é", "e").replace("ü", "u")
        if not k:
            continue
        scored = sorted((-round(plain(measure, k, b) + (0.5 if k in b else 0), 9), name) for b, name in keyed.items())
        if -scored[0][0] >= 0.5:
            want[t] = (scored[0][1], round(-scored[0][0], 6))
    assert got == want
    assert got["RENÉ N5"][0] == "Rene N5 cast"


def test_a_typo_in_a_single_word_is_found(spark):
    frame = lambda n, *x: spark.createDataFrame([(i,) for i in x], f"{n} string")
    got = lookup.best_match(frame("target", "inconnel"), frame("name", "inconel", "incoloy", "waspaloy")).collect()
    assert [(r.target, r.match) for r in got] == [("inconnel", "inconel")]
