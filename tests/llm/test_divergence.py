"""Source divergence audit: against plain Python, SQL and edge cases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm.divergence import _counted, oracle, share, source_divergence
from tidemark.llm.entries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(rows, min_docs, top):
    terms = [[t for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))] for _, _, text in rows]
    docs, groups = Counter(), defaultdict(Counter)
    for (lang, source, _), ts in zip(rows, terms):
        docs.update((lang or "", t) for t in set(ts))
        groups[lang or "", source or ""].update(ts)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((groups[lang, s] for s in sources), Counter()))
        p = {s: shares(groups[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[u][t]) for t in kept), u.encode(), u) for u in sources if u != s))
            marks = sorted(((-f(p[s][t], whole[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > whole[t]))
            out += [(lang, s, "pair", u, -v, i) for i, (v, _, u) in enumerate(pairs, 1)] + [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(marks[:top], 1)]
    return sorted(out)


def rows_of(seed, n=160, sources=5):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "DOG", "été", "ÉTÉ", "straße", "x", "naïve", "日本", "a_b", "c3d", "e\x00f", "😀", "İ"]
    pick = lambda xs: rng.choice(xs)
    out = [(pick(["en", "en", "en", "fr", None, ""]), pick([f"s{i}" for i in range(sources)] + [None, "é", "Z"]), " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(12)))) for _ in range(n)]
    return out + [("de", "lone", None), ("de", "other", "1 2 3"), ("en", "quiet", ""), ("en", "s0", "the " * 3000)] + out[:9]


@pytest.mark.parametrize(("tile", "cells"), [(1024, 1 << 18), (3, 8), (1, 1)])
def test_against_plain_python(spark, tile, cells):
    rows = rows_of(tile)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = source_divergence(docs, min_docs=4, top=3, tile=tile, cells=cells)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 3)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_one_language_and_one_source_hold_most_rows(spark):
    rows = [("en", "hot", f"word{'abcdefgh'[i % 8]} common")for i in range(900)] + [("en", f"s{i % 3}", "common wordz") for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence(docs).collect())) == plain(rows, 10, 10)


def test_no_kept_terms_no_rows_and_clashing_columns(spark):
    rows = [("en", "a", "one"), ("en", "b", "two"), ("fr", "a", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'x' as term", "2 as value", "3 as counts")
    assert sorted(map(tuple, source_divergence(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert source_divergence(docs.limit(0)).count() == 0


def test_sql_agrees_with_plain_python():
    rows = rows_of(5)
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    names = ("lang", "source", "part", "item", "value", "rank")
    assert sorted(con.execute(f"select {', '.join(names)} from ({oracle(4, 3)})").fetchall()) == plain(rows, 4, 3)


def test_shares_are_exact():
    rng = random.Random(1)
    for top in (10, 10**6, 9 * 10**15):
        n = [rng.randrange(top) for _ in range(500)] + [0, top]
        assert share(np.array(n), top).tolist() == [1 + 10**9 * x // top for x in n]


def test_partial_counts_are_arrow_tables():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["en"] * 3), pa.array(["a", "a", "b"]), pa.array(["x X y", "x", ""])], names=["lang", "source", "text"])
    assert sorted(map(tuple, (r.values() for r in _counted(batch).to_pylist()))) == [("en", "a", "x", 3, 2), ("en", "a", "y", 1, 1)]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = QUERIES["op13_source_divergence"](spark, SMALL)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op13_source_divergence']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
