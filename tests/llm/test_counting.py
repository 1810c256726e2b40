"""Divergence audit, packing and collocations against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import DOCS, words

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# Minimal perfect hashes and the audit


def test_perfect_hash_is_minimal_and_checks_keys():
    from meltwise.llm.divergence import PerfectHash, key_hashes

    for n in (0, 1, 2, 63, 64, 5000):
        keys = [f"k{i}".encode() for i in range(n)]
        h = PerfectHash(keys)
        if n:
            assert sorted(h.slots(keys, key_hashes(keys)).tolist()) == list(range(n))
        other = [f"x{i}".encode() for i in range(3000)]
        assert (h.slots(other, key_hashes(other)) == -1).all()


def plain_audit(rows, least, most):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for lang, source, text in rows]
    seen, number = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in docs:
        seen[lang].update(set(ts))
        number[lang, source].update(ts)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = sorted({s for x, s, _ in docs if x == lang})

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(number[lang, s]) for s in groups}
        q = share(sum((number[lang, s] for s in groups), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if number[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, n in (("pair", pairs, None), ("term", terms, most)):
                for r, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:n], 1):
                    out.append((lang, s, part, item, value, r))
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture()
def small_rounds(monkeypatch):
    """Several shards, rounds, flushes, blocks and strips on few rows."""
    from meltwise.llm import divergence

    for name, value in {"SHARD_TERMS": 16, "ROUND_BYTES": 4000, "HELD": 40, "CELLS": 64, "STRIP": 2}.items():
        monkeypatch.setattr(divergence, name, value)


def spread(n=120):
    r = random.Random(3)
    vocab = [f"{'abcdeé'[i % 6]}{chr(97 + i // 6)}w" for i in range(60)]
    return [(i, " ".join(r.choice(vocab).upper() if r.random() < 0.2 else r.choice(vocab) for _ in range(r.randrange(40))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d", "e", None]), 1) for i in range(n)]


def test_audit_matches_plain(spark):
    from meltwise.llm.divergence import audit

    rows = spread()
    assert audit_rows(audit(spark.createDataFrame(rows, DOCS))) == plain_audit([(r[2], r[3], r[1]) for r in rows], 10, 10)


def test_audit_in_small_rounds(spark, small_rounds):
    from meltwise.llm.divergence import audit

    rows = spread()
    assert audit_rows(audit(spark.createDataFrame(rows, DOCS))) == plain_audit([(r[2], r[3], r[1]) for r in rows], 10, 10)


def test_audit_odd_input(spark, odd, odd_rows, none, clashing):
    from meltwise.llm.divergence import audit

    plain = [(r[2], r[3], r[1]) for r in odd_rows]
    assert audit_rows(audit(odd)) == plain_audit(plain, 10, 10)  # no term in ten documents: gaps of 0 alone
    assert audit_rows(audit(clashing, least=2)) == plain_audit(plain, 2, 10)
    assert audit(none).collect() == []


# Packing


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    from meltwise.llm.packing import default_tokenizer, token_ids

    texts = ["", " ", "\n\n", "a  b\n\n c  d\te", "é  é\t\té it's I'll 12 34 !!  ??", " \x85 x  y   z　 q ", "日本 語  ", "x" * 5000, words(3000, 9), "\x1c a\x1f  b \x00 c"]
    flat, ends = token_ids([t.encode() for t in texts], default_tokenizer())
    whole = Tokenizer.from_file(default_tokenizer())
    begin = 0
    for t, end in zip(texts, ends, strict=True):
        assert flat[begin:end].tolist() == whole.encode(t, add_special_tokens=False).ids + [2], t[:40]
        begin = end


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("low,high,n", [(1, 1024, 2000), (1, 60, 3000), (400, 1024, 1000), (200, 500, 1000), (10, 10, 500), (1024, 1024, 5), (1, 1, 1025)])
def test_packing_is_complete_and_tight(low, high, n):
    from meltwise.llm.packing import pack_counts

    r = random.Random(low + high)
    lengths = [r.randint(low, high) for _ in range(n)]
    counts = np.bincount(lengths, minlength=1025).tolist()
    taken, fill = Counter(), Counter()
    for s in pack_counts(counts):
        assert s.rank == taken[s.length]
        taken[s.length] += s.each * s.bins
        for b in range(s.bins):
            assert s.offset == fill[s.sequence + b]
            fill[s.sequence + b] += s.each * s.length
    assert all(taken[i] == c for i, c in enumerate(counts)) and max(fill.values()) <= 1024 and set(fill) == set(range(len(fill)))
    assert len(fill) <= best_fit(lengths, 1024)


def check_packed(spark, docs):
    from tokenizers import Tokenizer

    from meltwise.llm.packing import default_tokenizer, pack, sequences

    whole = Tokenizer.from_file(default_tokenizer())
    expected = Counter()
    for r in docs.collect():
        ids = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        k = -(-len(ids) // 1024)
        cuts = [0, *range(len(ids) - 1024 * (k - 1), len(ids) + 1, 1024)]
        for i in range(k):
            own = ids[cuts[i] : cuts[i + 1]]
            expected[r.doc_id, i, cuts[i], len(own), zlib.crc32(own.tobytes())] += 1
    rows = pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length, r.ids_crc32))
    for parts in held.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert set(held) == set(range(len(held)))
    for r in sequences(docs).collect():
        ids = np.array(r.ids, "<u4")
        assert [zlib.crc32(ids[o : o + n].tobytes()) for o, n, _ in sorted(held[r.sequence_id])] == [c for _, _, c in sorted(held[r.sequence_id])]
    return len(held)


def test_pack_documents(spark):
    assert check_packed(spark, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")) > 0


def test_pack_odd_input(spark, clashing, none, monkeypatch):
    from meltwise.llm import packing

    monkeypatch.setattr(packing, "BUCKET_ROWS", 2)
    check_packed(spark, clashing)
    assert packing.pack(none).collect() == [] and packing.sequences(none).collect() == []


# Collocations


def plain_collocations(rows, least=30, most=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            x = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(x)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, n_l, n_r, total[lang], score) for i, (score, a, p, n_l, n_r) in enumerate(kept[:most], 1)]
    return sorted(out)


def test_multikey_quicksort():
    from meltwise.llm.collocations import multikey_quicksort

    r = np.random.default_rng(4)
    for n, least in ((0, 1), (1, 1), (500, 1), (3000, 20)):
        keys = r.integers(0, 6, (n, 4)).astype(np.int32)
        keys[np.cumsum(keys == 0, axis=1) > 0] = 0
        weight = r.integers(1, 9, n)
        got = {(tuple(keys[row, :d].tolist()), c) for row, d, c in multikey_quicksort(keys, weight, least)}
        plain = Counter()
        for k, w in zip(keys.tolist(), weight.tolist(), strict=True):
            for d in range(1, 5):
                if all(k[:d]):
                    plain[tuple(k[:d])] += w
        assert got == {(p, c) for p, c in plain.items() if c >= least}


def collocation_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("part_bytes", [24 << 20, 300])
def test_collocations_match_plain(spark, monkeypatch, part_bytes):
    """Also over many ranges, whose borders cut frequent phrases."""
    from meltwise.llm import collocations

    monkeypatch.setattr(collocations, "PART_BYTES", part_bytes)
    r = random.Random(5)
    some = ["new", "york", "of", "the", "Ünï", "a\x01b", "city", "\x02", "to"]
    rows = [(i, "".join(r.choice(some) + r.choice([" ", " ", "\t", ", ", "\n", " \x0b "]) for _ in range(60)) + " New York city of the " * (i % 3), r.choice(["en", None, "de", "und"]), "s", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    assert collocation_rows(collocations.collocations(docs)) == plain_collocations([(x[2], x[1]) for x in rows])
    assert collocation_rows(collocations.collocations(docs, least=5, most=7)) == plain_collocations([(x[2], x[1]) for x in rows], 5, 7)


def test_collocations_odd_input(spark, odd, odd_rows, none, clashing):
    from meltwise.llm.collocations import collocations

    plain = [(r[2], r[1]) for r in odd_rows]
    assert collocation_rows(collocations(odd)) == plain_collocations(plain)
    assert collocation_rows(collocations(clashing, least=2)) == plain_collocations(plain, 2)
    assert collocations(none).collect() == []


@pytest.mark.parametrize("name", ["op11_divergence", "op13_collocations"])
def test_queries_match_sql(spark, name):
    import duckdb

    from meltwise.llm.queries import ORACLES, QUERIES
    from tools.verify import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert compare(df.columns, df.collect(), [d[0] for d in cur.description], cur.fetchall()) is None
