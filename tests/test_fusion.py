import random

import pytest

from meltwise.operators import retrieval as rt


def fused(lists, k, alpha):
    total = {}
    for rows, w in zip(lists, (1 - alpha, alpha), strict=True):
        by = {}
        for q, d, s in rows:
            by.setdefault(q, []).append((-s, d))
        for q, x in by.items():
            for i, (_, d) in enumerate(sorted(x), 1):
                total[q, d] = total.get((q, d), 0) + w / (60 + i)
    out = []
    for q in {q for q, _ in total}:
        best = sorted((-round(s, 9), d) for (x, d), s in total.items() if x == q)[:k]
        out += [(q, d, -s, i) for i, (s, d) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("k,alpha,depth", [(5, 0.5, None), (5, 0.5, 2), (3, 0.9, 1), (10, 0.3, 4)])
def test_fusion_is_that_of_complete_lists(spark, k, alpha, depth):
    """Documents at rank 21 of one list decide, lists differ in length, scores tie, and one query has a single list."""
    r = random.Random(k)
    lexical = [(q, d, float(r.randrange(40))) for q in range(4) for d in r.sample(range(300), (120, 3, 60, 200)[q])]
    dense = [(q, d, -round(r.random(), 2)) for q in (0, 1, 2, 4) for d in r.sample(range(300), 250)]
    # at place 21 of both lists, and in neither head of 20
    lexical += [(9, d, 100.0 - d) for d in range(20)] + [(9, 77, 1.0)] + [(9, 100 + d, 0.5) for d in range(3)]
    dense += [(9, 200 + d, 1.0 - d / 100) for d in range(20)] + [(9, 77, -1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "qid long, doc_id long, score double")
    got = rt.fuse(frame(lexical), frame(dense), k, alpha, depth=depth).collect()
    want = fused((lexical, dense), k, alpha)
    assert sorted((x.qid, x.doc_id) for x in got) == [w[:2] for w in want]
    assert sorted((x.qid, x.doc_id, round(x.score, 9), x["rank"]) for x in got) == [(q, d, pytest.approx(s, abs=1e-9), i) for q, d, s, i in want]
    assert any(x[:2] == (9, 77) for x in want) or alpha != 0.5


def test_lists_worked_out_in_place_are_those_of_the_tables(spark):
    """Ids that repeat in documents, items and queries, a null id, equal texts, and a text without words."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    docs = [(r.randrange(60), " ".join(r.choices(words, k=r.randrange(1, 9)))) for _ in range(80)] + [(None, "w1 w2"), (70, ""), (71, "w1 W1, w3"), (72, "w1 W1, w3")]
    asked = [(q, " ".join(r.sample(words, 3))) for q in range(5)]
    docs, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, text string")
    items = [(r.randrange(40), [float(r.randrange(3)) for _ in range(3)]) for _ in range(60)]
    table, lists = rt.bm25_scores(docs, asked), rt.bm25_lists(docs, asked)
    cosine = rt.cosine_lists(spark.createDataFrame(items[:6], "qid long, embedding array<float>"), spark.createDataFrame(items, "rid long, embedding array<float>"), skip_self=True)
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v]
    pairs = [(q, d, -round(max(0.0, 2 - 2 * sum(x * y for x, y in zip(unit(a), unit(b)))) ** 0.5, 9)) for q, a in items[:6] for d, b in items if q != d]
    for got, want in ((lists, rt.TableLists(table)), (cosine, rt.TableLists(spark.createDataFrame(pairs, "qid long, doc_id long, score double")))):
        rows = lambda df: sorted((x.qid, x.doc_id) + tuple(round(y, 6) for y in x[2:]) for x in df.collect())
        head, length = got.heads(7)
        told, count = want.heads(7)
        assert rows(head) == rows(told.where("doc_id is not null"))
        assert sorted(length.collect()) == sorted(count.collect())
        some = head.select("qid", "doc_id").distinct()
        assert rows(got.ranks(some)) == rows(want.ranks(some))
