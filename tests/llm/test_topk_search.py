import math

from pyspark.sql import functions as F

import numpy as np

from tidemark.llm.topk_search import BallTree, top_k


def brute(rows, k=5, every=50):
    good = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good:
        if q % every == 0:
            best = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -(2**80)), sum(x * y for x, y in zip(a, b)))
            for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.append((q, r, i, max(-(2**63) + 1, min(2**63 - 1, s))))
    return sorted(out)


def got(df, **o):
    return sorted(tuple(r) for r in top_k(df, **o).collect())


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    assert got(df) == want
    assert got(df, shard_rows=100, block_queries=3) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (100, []), (50, [1e6, -1e6]), (8, [1e14, 3e14]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (150, [0.1, 0.2, 0.3]), (9, [-0.001, 0.002])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")
    assert got(df) == brute(rows)
    assert got(df, shard_rows=3, block_queries=1) == brute(rows)
    assert top_k(df.filter(F.lit(False))).count() == 0


def test_many_copies(spark):
    rows = [(i, [0.5, 0.25, -0.5] if i % 3 else [i / 1000, 0.1, 0.2]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df, shard_rows=64, block_queries=4) == brute(rows)


def test_subtrees_are_cut():
    """Clustered vectors: most nodes are never bounded, and the result is the brute-force one."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (64, 8)).astype(float)
    x = np.repeat(centres, 100, axis=0) + rng.integers(-20, 20, (6400, 8))
    tree = BallTree(np.arange(6400), x, leaf=32)
    again = BallTree.unpack(tree.pack(), 8)
    q = centres[:20] * 2
    best, name, seen = again.search(q, np.full(20, -1), np.full(20, -(2**62)), 5)
    want = np.lexsort((np.broadcast_to(np.arange(6400), (20, 6400)), -(q @ x.T)), axis=1)[:, :5]
    assert (name == want).all() and (best == np.take_along_axis(q @ x.T, want, 1)).all()
    assert seen < 20 * len(tree.radius) / 2
    high = best[:, -1].astype(np.int64)
    again_best, _, fewer = again.search(q, np.full(20, -1), high, 5)
    assert (again_best == best).all() and fewer <= seen
