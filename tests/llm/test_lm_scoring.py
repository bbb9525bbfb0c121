import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.lm_scoring import _STEP, MU, MU3, EliasFano, Trie, _asked, _request, pack, score_documents, unpack


def tokens_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows, mu=MU, mu3=MU3):
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    toks = [tokens_of(t) for _, t in rows]
    uni = Counter(w for h, ws in zip(held, toks) if not h for w in ws)
    two = Counter(p for h, ws in zip(held, toks) if not h for p in zip([None, *ws[:-1]], ws))
    three = Counter(p for h, ws in zip(held, toks) if not h for p in zip([None, *ws], ws, ws[1:]))
    n, v = sum(uni.values()), len(uni)
    out = []
    for (d, _), h, ws in zip(rows, held, toks):
        base = [(uni[w] + 0.1) / (n + 0.1 * (v + 1)) for w in ws]
        full = [(two[a, w] + mu * p) / (uni[a] + mu) for a, w, p in zip([None, *ws[:-1]], ws, base)]
        full[1:] = [(three[a, b, w] + mu3 * p) / (two[a, b] + mu3) for a, b, w, p in zip([None, *ws], ws, ws[1:], full[1:])]
        out.append((d, h, len(ws), sum(uni[w] > 0 for w in ws), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) <= 1e-9 * (1 + abs(w[5]))
        assert abs(g[6] - w[6]) <= w[2] * _STEP + 1e-9  # two roundings of a log probability a token


def test_elias_fano():
    rng = np.random.default_rng(5)
    for top in (1, 5, 1000, 1 << 40, (1 << 63) - 1):
        for n in (0, 1, 2, 63, 64, 65, 1000):
            x = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            e = EliasFano(x)
            assert (e.access(np.arange(n)) == x).all()
            if n:
                q = rng.integers(0, top, 50, dtype=np.uint64)
                at = e.successor(q, np.zeros(50, np.int64), np.full(50, n))
                assert (at == np.searchsorted(x, q)).all()
    x = np.sort(rng.integers(0, 1 << 64, 500, dtype=np.uint64))
    x[-1] = (1 << 64) - 1
    assert (EliasFano(x).access(np.arange(500)) == x).all() and (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0


def test_trie():
    rng = np.random.default_rng(6)
    big = lambda x: np.array(x, np.uint64) * np.uint64(1 << 30)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (500, 2))})
    triples = sorted({(int(a), int(b)) for a, b in np.c_[rng.integers(0, len(pairs), 900), rng.integers(0, 40, 900)]})
    u, v = big(pairs).T
    of, w = np.array([t[0] for t in triples], np.uint64), big([t[1] for t in triples])
    n3 = rng.integers(1, 9, len(w)).astype(float)
    n = rng.integers(1, 9, len(u)) + np.bincount(of.astype(int), n3, len(u))
    trie = Trie(u, v, n, np.full(len(u), 1000.0), of, w, n3, 10.0, 5.0)
    grid = [(a, b) for a in range(42) for b in range(42)]
    grid3 = [(i, c) for i in range(len(grid)) for c in range(0, 42, 3)]
    two, back, three = trie.lookup(*big(grid).T, np.array([g[0] for g in grid3]), big([g[1] for g in grid3]))
    have = dict(zip(pairs, n))
    have3 = {(*pairs[int(i)], c): x for (i, c), x in zip(triples, n3)}
    near = lambda code, p: abs((int(code) - 255) * _STEP - math.log10(p)) <= _STEP / 2 + 1e-12
    for g, c, b in zip(grid, two, back):
        assert (c > 0) == (g in have)
        assert near(b, 5 / (have.get(g, 0) + 5)) and (not c or near(c, have[g] / 1010))
    for (i, x), c in zip(grid3, three):
        assert (c > 0) == ((*grid[i], x) in have3)
        assert not c or near(c, have3[*grid[i], x] / (have[grid[i]] + 5))


def test_requests_round_trip():
    rng = np.random.default_rng(7)
    for size in (1, 5, 400):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 1 << 20, (size, 2))} | {(3, int(b)) for b in rng.integers(0, 50, size)})
        u, v = np.array(pairs, np.uint64).T
        sizes = rng.integers(0, 4, len(u))
        w = np.concatenate([np.zeros(0, np.uint64), *(np.sort(rng.choice(1 << 20, k, replace=False)).astype(np.uint64) for k in sizes)])
        n2, n3 = rng.integers(0, 9, len(u)), rng.integers(0, 9, len(w))
        got = _asked(_request(u, v, n2, sizes, w, n3))
        for x, y in zip(got, (u, v, n2, np.repeat(np.arange(len(u)), sizes), w, n3)):
            assert (x == y).all() and len(x) == len(y)


@pytest.mark.parametrize("options", [{}, {"batch_tokens": 500, "shard_tokens": 400}, {"batch_tokens": 3000, "shard_tokens": 2000, "mu": 5.0, "mu3": 2.0}])
def test_against_brute_force(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (None, "a A b"), (500, ""), (10, "x x x"), (10, "x x x"), (501, "hot " * 3000), (502, "hot cold " * 900)]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in rows], "doc_id long, text string, score double").repartition(5)
    close(score_documents(df, **options).collect(), brute(rows, options.get("mu", MU), options.get("mu3", MU3)))


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert score_documents(df.filter(F.lit(False))).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    close(score_documents(df).collect(), brute([(held, "a b")]))


def test_beats_the_base_on_held_out_text(spark):
    got = [r for r in score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_copied_documents_are_likelier_than_new_ones(spark):
    """A text that occurs twice in training scores above texts of the same words that occur once."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 500) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i]) for i in range(30)]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    twice = [got[i] for i in range(30) if i not in held and 1000 + i not in held]
    once = [got[i] for i in range(30, 300) if i not in held]
    assert np.mean([a > b for a in twice for b in once]) > 0.9
