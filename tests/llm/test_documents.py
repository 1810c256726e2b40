"""Operators on documents: contracts against plain versions, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# language

def test_code_lengths_are_those_of_plain_ppm():
    from meltwise.llm.language import Trees, grams

    texts = {"a": [b"abracadabra abracadabra", b"banana"], "b": [b"xyzzy xyz zyx", b"banana bread"]}
    langs, lang, gram, n = sorted(texts), [], [], []
    counts = {k: Counter() for k in texts}
    for i, k in enumerate(langs):
        for t in texts[k]:
            p = b"\0\0\0" + t
            for j in range(3, len(p)):
                for o in range(4):
                    counts[k][p[j - o : j + 1]] += 1
            g, c = np.unique(grams(np.frombuffer(p, np.uint8)), return_counts=True)
            lang += [i] * len(g)
            gram += g.tolist()
            n += c.tolist()
    trees = Trees(langs, np.array(lang), np.array(gram, np.int64), np.array(n))

    def cost(k, ctx, sym):
        for o in range(len(ctx), -1, -1):
            c = ctx[len(ctx) - o :]
            seen = {s: v for s, v in ((g[-1:], v) for g, v in counts[k].items() if len(g) == o + 1 and g[:-1] == c)}
            if seen:
                total, kinds = sum(seen.values()), len(seen)
                if sym in seen:
                    return cost.paid - np.log2(seen[sym] / (total + kinds))
                cost.paid -= np.log2(kinds / (total + kinds))
        return cost.paid + 8

    probe = [b"abra banana", b"zzq bread", b"", b"\xff\xfe"]
    got = trees.code_lengths(probe)
    for i, t in enumerate(probe):
        p = b"\0\0\0" + t
        for j, k in enumerate(langs):
            bits = 0.0
            for x in range(3, len(p)):
                cost.paid = 0.0
                bits += cost(k, p[x - 3 : x], p[x : x + 1])
            assert got[i, j] == pytest.approx(bits, rel=1e-4, abs=1e-3)


def test_long_texts_cost_the_same_in_pieces(monkeypatch):
    from meltwise.llm import language

    t = words(300).encode()
    trees = language.Trees(["x"], *[np.array(v) for v in ([0], [int.from_bytes(t[:4], "big")], [1])])
    whole = trees.code_lengths([t])
    monkeypatch.setattr(language, "CHUNK", 64)
    assert trees.code_lengths([t]) == pytest.approx(whole, rel=1e-5)


def test_language_of_held_out_documents(spark):
    from __spark_entry__ import queries

    found = queries()["op1_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()


def test_language_of_odd_rows(odd, clashing, none):
    from meltwise.llm import language

    trees = language.train(odd)
    for df in (odd, clashing, none):
        got = df.select(language.identify(df, trees, df["text"]).alias("p")).select("p.*").collect()
        assert len(got) == df.count()
        assert all(r.lang in {"und", "en", "de", "fr"} for r in got)
    assert sum(r.lang == "und" for r in odd.select(language.identify(odd, trees, odd["text"]).alias("p")).select("p.*").collect()) == 4
    assert language.train(none) is None
    assert {r.p.lang for r in odd.select(language.identify(odd, None, odd["text"]).alias("p")).collect()} == {"und"}


# sharding

def test_shards(spark, odd, clashing, none):
    from meltwise.llm.sharding import shard

    many = spark.createDataFrame([(i, words(20 + i % 50, i // 3), "en", f"s{i % 4}", 0) for i in range(900)], DOCS)
    for df, n in ((clashing, 2), (none, 2), (many, 8)):
        got = shard(df, shards=n).collect()
        assert len(got) == df.count()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            text = (r["text"] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text)) and 0 <= r["shard"] < n
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes, at = Counter(), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        at[r["text"]].add(r["shard"])
    assert max(sizes.values()) < 1.1 * min(sizes.values()) and len(sizes) == 8
    assert all(len(v) == 1 for v in at.values())


def test_a_heavy_group_is_cut_and_leaves_follow_the_target(spark):
    from meltwise.llm.sharding import shard

    df = spark.createDataFrame([(i, "same text" if i % 2 else words(10, i), "en", "s", 0) for i in range(2000)], DOCS)
    total = df.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    got = shard(df, target_bytes=total // 4 + 1).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 4 and max(r.b for r in got) < 1.15 * min(r.b for r in got)


# secrets

def test_trigram_queries_hold_for_every_match():
    from meltwise.llm.secrets import BASE_RULES, OWN_RULES, trigram_query

    texts = {
        "assign": ["PassWord = 'abcdef", "api_key:123456", "apikey\"=xyzxyz", "token  :  aaaaaa"], "access": ["AKIA" + "A" * 16], "github": ["ghp_" + "a" * 36], "slack": ["xoxb-1234567890"],
        "pem": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"], "jwt": ["eyJabcdefgh.eyJabcdefgh.abcdefghi"], "google": ["AIza" + "b" * 35], "stripe": ["sk_live_" + "1" * 16, "rk_test_" + "1" * 16],
    }
    for kind, pattern, *_ in BASE_RULES + OWN_RULES:
        query = trigram_query(pattern)
        assert bool(query) == (kind != "hex")
        for t in texts.get(kind, []):
            assert re.search(pattern, t)
            assert all(any(all(g in t.lower() for g in s) for s in clause) for clause in query), (kind, t)


def plain_spans(text):
    from meltwise.llm.secrets import BASE_RULES, OWN_RULES

    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_RULES + OWN_RULES):
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_secret_spans(spark, odd, odd_rows, clashing, none):
    from meltwise.llm.secrets import scan

    more = [(20, "é token=token:abcdefgh secret=short pw", "x", "s", 0), (21, "deadbeef" * 4 + " token = " + "ab" * 5000 + " ghp_" + "Z" * 40, "x", "s", 0)]
    df = odd.union(spark.createDataFrame(more, DOCS))
    got = sorted((repr(r.doc_id), [s.span for s in r.found]) for r in scan(df).collect())
    assert got == sorted((repr(r[0]), plain_spans(r[1])) for r in [*odd_rows, *more])
    assert scan(none).count() == 0 and scan(clashing).count() == len(odd_rows)


# suffixes

def plain_removal(rows):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"bucket": 3, "hot": 1}])
def test_repeated_bytes(spark, odd, odd_rows, sizes):
    from meltwise.llm.suffixes import remove_repeats

    a, b = words(120, 7), words(150, 8)
    more = [(30, words(9, 1) + a[:250] + words(5, 2), "x", "s", 0), (31, a[40:300] + "é" * 150, "x", "s", 0), (32, "ab" * 400, "x", "s", 0), (33, b[:199], "x", "s", 0), (34, b[:199] + "!", "x", "s", 0), (35, b[:200], "x", "s", 0), (36, b + b, "x", "s", 0)]
    more += [(40 + i, words(30, 50 + i) + a[:220] + words(30, 90 + i), "x", "s", 0) for i in range(12)]
    rows = [(r[0], r[1]) for r in [*odd_rows, *more]]
    assert rows_of(remove_repeats(odd.union(spark.createDataFrame(more, DOCS)), **sizes)) == plain_removal(rows)


def test_pieces_of_long_texts_remove_the_same(monkeypatch):
    from meltwise.llm import suffixes

    t = words(3000, 3).encode()
    monkeypatch.setattr(suffixes, "BATCH", 1000)
    starts = {a + i for batch in suffixes.pieces([t]) for _, a, p in batch for i in range(max(0, len(p) - 199)) if p == t[a : a + len(p)]}
    assert starts == set(range(len(t) - 199))


def test_suffixes_of_nothing_and_of_clashing_columns(none, clashing, odd_rows):
    from meltwise.llm.suffixes import remove_repeats

    assert remove_repeats(none).count() == 0 and remove_repeats(clashing).count() == len(odd_rows)


# licences

def test_licence_expressions():
    from meltwise.llm.licenses import choices, to_postfix

    ask = lambda t: {"&".join(sorted(c)) for c in choices(to_postfix(t))}
    assert ask("mit or apache-2.0") == {"mit", "apache-2.0"}
    assert ask("mit and (bsd or gpl-2.0 with exc)") == {"bsd&mit", "gpl-2.0 with exc&mit"}
    assert ask("mit or bsd and isc") == {"mit", "bsd&isc"}
    assert to_postfix("and mit") is None and to_postfix("") is None and to_postfix("(mit") is None
    assert to_postfix("mit or") == ["mit"]


def test_licence_expressions_of_any_length():
    from meltwise.llm.licenses import automaton, scan_text, to_postfix

    assert to_postfix("mit copyright " + "word " * 300) == ["mit"]
    assert to_postfix("mit or (bsd and " + "(" * 200) == ["mit"] and to_postfix("mit and (bsd) with exc) or isc") == ["mit", "bsd", "exc", "with", "and"]
    text = "SPDX-License-Identifier: "
    assert scan_text(text + "MIT Copyright 2020 " + "word " * 200, automaton())[5:] == ("mit", 1.0, "mit")
    names = [f"l{i:02}" for i in range(14)]
    assert scan_text(text + " AND ".join(names), automaton())[7] == "&".join(names)
    assert scan_text(text + " AND ".join(f"(a{i} OR b{i})" for i in range(20)), automaton())[7].startswith("a0 b0 or a1 b1 or and")


def test_licence_places(odd, odd_rows, clashing, none, spark):
    from meltwise.llm.licenses import BASE_PHRASES, scan

    more = [(50, "CC-BY cc by cc by! General   PUBLIC license. All rights reserved", "x", "s", 0), (51, "SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD)\nx", "x", "s", 0)]

    def plain(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((i, label) for p, label in BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))

    df = odd.union(spark.createDataFrame(more, DOCS))
    got = df.select("doc_id", scan(df["text"]).alias("l")).select("doc_id", "l.*")
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((r[0], *plain(r[1])) for r in [*odd_rows, *more]), key=repr)
    spdx = got.where("doc_id = 51").first()
    assert spdx.labels == "apache-2.0,bsd,mit" and spdx.score == 1.0 and spdx.allowed == "apache-2.0&bsd|mit"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.collect())
    assert clashing.select(scan(clashing["text"])).count() == len(odd_rows) and none.select(scan(none["text"])).count() == 0


# SimHash

def plain_fingerprint(text, k=3):
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints):
    ids = list(range(len(prints)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                ids[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f, least[root(i)]) for i, (d, f) in enumerate(prints)), key=repr)


def test_simhash_classes(spark, odd, odd_rows, clashing, none):
    from meltwise.llm.simhash import near_duplicates

    more = [(60 + i, words(40, 9) + " " + words(i % 3, i), "x", "s", 0) for i in range(30)] + [(95 + i, words(1 + i % 4, i // 2), "x", "s", 0) for i in range(8)]
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in [*odd_rows, *more]])
    got = near_duplicates(odd.union(spark.createDataFrame(more, DOCS))).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == want
    assert near_duplicates(none).count() == 0 and near_duplicates(clashing).count() == len(odd_rows)


def test_simhash_links_of_close_fingerprints(spark):
    from meltwise.llm.components import components
    from meltwise.llm.simhash import links

    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(-(1 << 62), 1 << 62, 30)]
    prints = {b for b in base} | {b ^ (1 << 3) ^ (1 << 60) for b in base[:10]} | {b ^ 1 ^ 2 ^ 4 for b in base[10:20]} | {b ^ (1 << 3) ^ 7 ^ (1 << 60) for b in base[:5]}
    got = {r.v: r.label for r in components(links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    want = plain_components([(p, p % (1 << 64)) for p in sorted(prints)])
    assert {(d, m) for d, _, m in want if d != m or sum(x[2] == m for x in want) > 1} == set(got.items())


def test_components_of_a_chain_and_a_star(spark):
    from meltwise.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(5, 5)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(1000, 1300))}


def test_one_of_each_group_stays(spark, odd, clashing, none):
    from meltwise.llm.simhash import one_of_each

    a = words(300, 11).split()
    near = [(200 + i, " ".join(a[: 10 * i] + ["changed"] + a[10 * i + 1 :]), "x", "s", i) for i in range(12)]
    far = [(300 + i, words(100, 500 + i), "x", "s", i) for i in range(20)]
    kept = [r.doc_id for r in one_of_each(spark.createDataFrame(near + far, DOCS)).collect()]
    assert sorted(kept) == [200, *range(300, 320)]
    got = one_of_each(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(map(repr, ids)) == sorted(map(repr, [1, None, 3, 6, 8, 9]))
    assert one_of_each(clashing).columns == clashing.columns and one_of_each(none).count() == 0


def test_near_copies_by_sets_of_shingles(spark):
    from meltwise.llm.simhash import one_of_each

    line = words(12, 900)
    docs = [(i, " ".join([line] * 10 + [words(100, 910 + i)]), "x", "s", 0) for i in (1, 2)]  # a frequent line alone
    own = words(100, 920)
    docs += [(3, line + " " + own, "x", "s", 0), (4, " ".join([line] * 9 + [own]), "x", "s", 0)]  # sets alike by 0.9
    assert sorted(r.doc_id for r in one_of_each(spark.createDataFrame(docs, DOCS)).collect()) == [1, 2, 3]


def test_every_pair_at_the_bound_is_found(spark):
    from meltwise.llm.simhash import similar_sets

    sets = {1000 * i + j: [1000 * i + k for k in range(90 + 10 * j)] for i in range(1, 301) for j in (0, 1)}  # 300 pairs alike by 0.9
    sets |= {u + 500_000: [x + 500_000 for x in h] + [x + 700_000 for x in h[:12 * (u % 1000)]] for u, h in sets.items()}  # and 300 by 90/112
    got = similar_sets(spark.createDataFrame(list(sets.items()), "u long, h array<long>"), 0.8)
    assert {tuple(x) for x in got.collect()} == {(u, u + 1) for u in sets if u % 1000 == 0}


def test_near_copies_inside_a_family(spark):
    from meltwise.llm.simhash import similar_sets

    r = random.Random(4)
    family = [r.sample(range(40), 30) + [1000 * i + j for j in range(20)] for i in range(1, 600)]  # alike by a half at most
    planted = {(100 + i, 700 + i): family[100 + i][:-2] for i in range(60)}  # alike by 0.96
    sets = dict(enumerate(family)) | {b: h for (_, b), h in planted.items()}
    got = similar_sets(spark.createDataFrame([(u, h) for u, h in sets.items()], "u long, h array<long>"), 0.8)
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert {tuple(x) for x in got.distinct().collect()} == want and set(planted) <= want


def test_texts_with_too_much_of_their_own_are_not_compared(spark, monkeypatch):
    """Of a hundred texts that share a passage only those that can have a near copy are kept for the comparison."""
    from meltwise.llm import simhash

    passage, seen, real = words(60, 700), [], simhash.similar_sets
    docs = [(i, f"{passage} {words(2000, 2000 + i, 10**6)}", "x", "s", 0) for i in range(100)]
    docs += [(500 + i, docs[i][1] + " and more", "x", "s", 0) for i in range(0, 100, 25)]  # alike by 0.99

    def watched(sets, *rest):
        seen.extend(r.u for r in sets.collect())
        return real(sets, *rest)

    monkeypatch.setattr(simhash, "similar_sets", watched)
    assert sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, DOCS)).collect()) == list(range(100))
    assert len(seen) == len(set(seen)) and 8 <= len(seen) < 20


def test_only_sets_that_may_be_alike_are_fetched(spark):
    """Pairs that meet at a least common shingle, and by length and place might be alike, but are far apart."""
    from meltwise.llm.simhash import similar_sets

    r = random.Random(8)
    sets = {i: [i // 2] + [r.getrandbits(62) for _ in range(200)] for i in range(200)}
    sets |= {1000 + i: [5000 + i] + sets[i][:-4] for i in range(0, 200, 20)}  # alike by 0.97
    rows, asked = spark.createDataFrame(list(sets.items()), "u long, h array<long>"), []

    def fetch(names):
        asked.extend(x.u for x in names.collect())
        return rows.join(names, "u", "left_semi")

    got = similar_sets(rows, 0.8, spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)], "a long, b long"), fetch)
    assert {tuple(x) for x in got.distinct().collect()} == {(i, 1000 + i) for i in range(0, 200, 20)}
    assert set(asked) == {u for i in range(0, 200, 20) for u in (i, 1000 + i)}


def test_least_common_shingles_of_a_set_are_one_row(spark):
    from meltwise.llm import simhash

    sets = {u: [*range(100, 140), *range(1000 * u, 1000 * u + 4)] for u in range(1, 30)}  # 44 members, 9 of them least common
    got = simhash._least_common(spark.createDataFrame(list(sets.items()), "u long, h array<long>"), 0.8).collect()
    assert sorted(r.u for r in got) == sorted(sets) and {r.n for r in got} == {44}
    assert all(sorted((x.i, x.s) for x in r.x) == [(i, 96 + i) for i in range(4, 9)] for r in got)


def test_near_copies_of_a_large_group_beside_others(spark, monkeypatch):
    from meltwise.llm import simhash
    from meltwise.llm.components import components

    monkeypatch.setattr(simhash, "SENT", 500)
    monkeypatch.setattr(simhash, "FEW", 0)  # rounds first
    r = random.Random(5)
    sets = {u: [*r.sample(range(40), 36), u + 100] for u in range(200)} | {u: [*range(8), *range(1000 * u, 1000 * u + 32)] for u in range(200, 230)}
    got = {x.v: x.label for x in components(simhash.similar_sets(spark.createDataFrame(list(sets.items()), "u long, h array<long>"), 0.8)).collect()}
    root = {u: u for u in sets}
    for a in sets:
        for b in sets:
            if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {u: low if x == high else x for u, x in root.items()}
    assert {u: got.get(u, u) for u in sets} == root


# toxicity

def test_marginals_are_those_of_all_taggings():
    from itertools import product

    from meltwise.llm.toxicity import marginals

    r = np.random.default_rng(2)
    lengths = np.array([3, 1, 5])
    starts = np.array([0, 4, 6])
    pull, trans = r.normal(size=12), r.normal(size=(2, 2))
    got, pairs = marginals(pull, starts, lengths, trans, pairs=True)
    expected = np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        z, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in product((0, 1), repeat=int(n)):
            w = np.exp(sum(pull[s + i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            z += w
            one += w * np.array(tags)
            for a, b in zip(tags, tags[1:], strict=False):
                two[a, b] += w
        assert got[s : s + n] == pytest.approx(one / z)
        expected += two / z
    assert pairs == pytest.approx(expected)


def test_toxic_words_are_found_with_their_places(spark, odd, clashing, none):
    from meltwise.llm import toxicity

    texts = [words(30, i) + (". You utter blorgface here. " if i % 3 == 0 else ". You kind friend here. ") + words(30, 900 + i) for i in range(120)]
    field = toxicity.fit(texts, np.array([i % 3 == 0 for i in range(120)]))
    rows = field.score(["so BLORGFACED and blorgface!", "so kind", "", None, "İ blorgface"])
    assert rows[0][0] > 0.3 > rows[1][0] and "15:24" not in rows[0][1] and "18:27" in rows[0][1]
    assert rows[2][1] == rows[3][1] == "" and rows[4][1] == "2:11"
    assert toxicity.train(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    for df in (odd, clashing, none):
        got = df.select(toxicity.score(df, field, df["text"]).alias("s")).select("s.*").collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_held_out_documents(spark):
    from __spark_entry__ import queries

    got = queries()["op8_toxicity"](spark, "/root/testdata/sf0.1")
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = got.where("held_out").join(truth, "doc_id").toPandas()
    good, bad = held[held.toxic == 0], held[held.toxic == 1]
    assert (bad.score >= 0.3).mean() > 0.9 and (good.score >= 0.3).mean() < 0.05
    ranks = held.score.rank()
    auc = (ranks[held.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert auc > 0.95


# mixing

def test_targets_are_poured_level_by_level(spark):
    from meltwise.llm.mixing import source_targets

    sizes = {"a": 10, "b": 1000, "c": 400, "d": 3, None: 200, "e": 0}
    df = spark.createDataFrame([(k or "", k is None, v) for k, v in sizes.items()], "_src string, _null boolean, ssize long")
    got = {None if r._null else r._src: r.target for r in source_targets(df).collect()}
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    fixed, total = {}, 1.5 * sum(sizes.values())
    while True:
        left = total - sum(fixed.values())
        w = sum(weight[k] for k in sizes if k not in fixed)
        over = {k: 2.0 * sizes[k] for k in sizes if k not in fixed and weight[k] * left / w > 2 * sizes[k]}
        if not over:
            break
        fixed |= over
    want = {k: fixed.get(k, weight[k] * left / w if w else 0) for k in sizes}
    assert got == pytest.approx(want)


def test_mix(odd, clashing, none):
    from meltwise.llm.mixing import mix, write_copies

    for df in (clashing,):
        got = mix(df).collect()
        assert len(got) == df.count()
        per = defaultdict(lambda: [0, 0.0, 0])
        for r in got:
            assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
            x = per[r["source"]]
            x[0], x[1], x[2] = x[0] + r["taken"], r["target"], r["source_size"]
        assert all(taken == int(target) and target <= 2 * size for taken, target, size in per.values())
        assert rows_of(mix(df)) == rows_of(mix(df))
    copies = write_copies(mix(odd), odd.columns)
    assert copies.columns == odd.columns and copies.count() == sum(r.copies for r in mix(odd).collect())
    assert mix(none).count() == 0


# decontamination

def test_templates_and_leaks(spark, odd, clashing, none):
    from meltwise.llm.decontam import decontaminate, matches, raw_tokens, template

    item = "A train leaves the station at 60 km per hour and meets Anna after 3 hours so how far did Anna go in 60 minutes"
    other = item.replace("60", "85").replace("Anna", "Bertold").replace("3", "7")
    mixed = item.replace("60 km", "85 km").replace("Anna go", "Carl go")  # one value becomes two
    short = "nine lives has every cat"
    items = spark.createDataFrame([(1, item), (2, short), (3, None), (4, ""), (5, words(40, 77))], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, words(30, 1) + " " + item + " " + words(30, 2), "en", "s", 0), (2, words(13, 3) + " " + other + ". " + words(9, 4), "en", "s", 0), (3, mixed, "en", "s", 0),
        (4, words(50, 5), "en", "s", 0), (5, "truly " + short + ", they say", "en", "s", 0), (6, None, "en", "s", 0), (6, None, "en", "s", 0), (7, words(20, 6) + " " + " ".join(words(40, 77).split()[:10]), "en", "s", 0),
    ], DOCS)
    got = matches(docs, items).collect()
    assert sorted((r.item_id, r.changed > 0) for r in got) == [(1, False), (1, True), (2, False)]
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [3, 4, 6, 6, 7]
    both = docs.select(F.size(template(F.col("text"))).alias("a"), F.size(raw_tokens(F.col("text"))).alias("b")).where("a <> b")
    assert both.count() == 0
    for df in (clashing, none):
        kept = decontaminate(df, items)
        assert kept.columns == df.columns and kept.count() == df.count()


def test_leaks_match_a_plain_search(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries()["op2_decontaminate"](spark, sf).collect()}
    tok = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    items = {r.item_id: tok(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        text = " " + " ".join(tok(r.text)) + " "
        want |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in text}
    assert got == want


def _told(spark, texts, items, least=0.5):
    from meltwise.llm.decontam import matches, row_hash

    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in texts.items()], DOCS)
    found = matches(docs, spark.createDataFrame(list(items.items()), "item_id long, text string"), least)
    return {(r.doc_id, r.item_id): r.changed for r in docs.select("doc_id", row_hash(docs).alias("_n")).join(found, F.col("_n") == F.col("_k")).collect()}


def test_leaks_beside_other_places_of_a_template(spark):
    item = "the train leaves the station at 60 km per hour and meets the other train after 3 hours of driving"
    other = item.replace("60", "85").replace("3", "7")
    third = item.replace("60", "40").replace("3", "9")
    texts = {1: item + " " + words(30, 1) + " they drive at 85 km per hour and turn", 2: other + " " + words(9, 2) + " " + item, 3: other + " " + third, 4: item.replace("km", "km " + words(12, 3)) + " at 85 km per hour and"}
    got = _told(spark, texts, {1: item})
    assert set(got) == {(i, 1) for i in texts} and [got[i, 1] for i in (1, 2, 3)] == [0, 0, 2]


def test_leaks_of_items_dense_in_numbers(spark):
    items = {1: "Compute 12 + 7 - 3 + 5 + 9 - 4 + 8 + 6", 2: "Sort the numbers 4 9 2 7 1 8 in order", 3: "Next number in 2 4 8 16 32 64 128 256 512"}
    texts = {10 * i + phase: words(20 + phase, i) + " " + t + " " + words(8, phase) for i, t in items.items() for phase in range(4)}
    texts |= {100 + phase: words(20 + phase, 7) + " Sort the numbers 14 19 12 17 11 18 in order " + words(8, phase) for phase in range(4)}
    got = _told(spark, texts, items)
    assert set(got) == {(10 * i + phase, i) for i in items for phase in range(4)} | {(100 + phase, 2) for phase in range(4)}
    assert all(got[100 + phase, 2] == 6 for phase in range(4))
