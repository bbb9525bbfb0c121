import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.mixing import apply_mix, flight, mix, source_targets


def test_targets():
    assert source_targets([("b", 100), ("a", 100), (None, 100)]) == {"a": 187.5, "b": 75.0, None: 37.5}
    got = source_targets([("a", 10), ("b", 500), ("c", 90)])
    assert got["a"] == 30 and abs(sum(got.values()) - 600) < 1e-9
    assert source_targets([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0} and source_targets([]) == {}


def plain_targets(size):
    """By filling in small equal steps of weight: a source stops at three times its size."""
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weight, stop = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 3 * n for s, n in size.items()}
    got, left, open_ = dict.fromkeys(size, 0.0), float(sum(size.values())), {s for s in size if size[s]}
    while open_ and left > 1e-9:
        step = min([left / sum(weight[s] for s in open_), *((stop[s] - got[s]) / weight[s] for s in open_)])
        for s in open_:
            got[s] += step * weight[s]
        left -= step * sum(weight[s] for s in open_)
        open_ = {s for s in open_ if got[s] < stop[s] - 1e-9}
    return got


def test_plain_targets_agree():
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 40):
        size = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 10 ** rng.integers(1, 7), n))} | {None: 7}
        got, want = source_targets(list(size.items())), plain_targets(size)
        assert all(abs(got[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in size)


def test_flight_balances():
    rng = np.random.default_rng(3)
    size, p = rng.integers(0, 500, 2000), np.full(2000, 0.37)
    q = flight(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs((size * q).sum() - (size * p).sum()) < 1e-3 and abs(q.sum() - p.sum()) < 1e-6


def check(spark, docs, **options):
    docs = docs.cache()
    got = mix(docs, **options).collect()
    again = mix(docs.repartition(7), **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = docs.collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    most = max([r.size for r in got], default=0)
    want = plain_targets(size)
    for s in size:
        assert abs(target[s] - want[s]) <= 1e-6 * (1 + want[s]) and abs(taken[s] - want[s]) <= most
    return got


def test_documents_and_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, docs)
    got = check(spark, docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source"))), chunk=16)
    assert len({r.source for r in got}) > 3


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (3, "", "y"), (None, "c d e", None), (4, "one two", None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(spark, docs)
    n = sum(r.copies for r in mix(docs).collect())
    assert apply_mix(docs).count() == n and apply_mix(docs).columns == docs.columns
    assert mix(docs.filter(F.lit(False))).count() == 0


def test_clashing_names_null_pairs_and_variants_of_a_row(spark):
    rows = [(1, "x", None, 1), (1, None, "x", 1), *[(2, "a b c", "s", i % 2) for i in range(30)], *[(3, "d e", "t", 0)] * 30, (4, "f g h i", None, 0)]
    docs = spark.createDataFrame([(d, t, s, v, "n", 5, "q") for d, t, s, v in rows], "doc_id long, text string, source string, copies long, key string, t long, row string")
    mixed, applied = mix(docs), apply_mix(docs)
    assert applied.columns == docs.columns
    want, got = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        want[r.doc_id, r.source, r.size] += r.copies
    for r in applied.collect():
        assert (r.doc_id, r.text, r.source, r.copies) in rows and (r.key, r.t, r.row) == ("n", 5, "q")
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert len({(r.doc_id, r.key, r.seq) for r in mixed.collect()}) == len(rows)
