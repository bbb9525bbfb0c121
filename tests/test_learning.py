"""Fitted models and the weight grid against plain NumPy."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid as W
from tidemark.operators import learning as L

c = F.col


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        a, b, x = rng.gauss(0, 1), rng.choice([1.0, 2.0, 3.0, 4.0]), rng.gauss(5, 2)
        rows.append((i, a, b, x, 2 * a - (3.0 if b > 2 else 0.0) + rng.gauss(0, 0.5)))
    rows += [(600, None, 1.0, 1.0, 9.0), (601, 1.0, float("nan"), 1.0, 9.0), (602, 1.0, 1.0, 1.0, None)]
    return rows, spark.createDataFrame(rows, "i int, a double, b double, x double, y double").repartition(4).cache()


def usable(rows):
    return np.array([r for r in rows if all(v is not None and v == v for v in r)], dtype=float)


@pytest.mark.parametrize(("alpha", "ratio"), [(0.1, 0.5), (0.5, 1.0), (0.05, 0.0), (0.0, 0.5)])
def test_elastic_net_is_the_minimum(table, alpha, ratio):
    rows, df = table
    w, b = L.elastic_net(df, ["a", "b", "x"], "y", alpha, ratio)
    m = usable(rows)
    x, y = m[:, 1:4], m[:, 4]
    scale, x0, y0 = y.std(), x - x.mean(0), (y - y.mean()) / y.std()
    v, size = np.zeros(3), 1 / (np.linalg.eigvalsh(x0.T @ x0 / len(x)).max() + alpha)
    for _ in range(20_000):  # proximal gradient steps
        v = v - size * (x0.T @ (x0 @ v - y0) / len(x) + alpha * (1 - ratio) * v)
        v = np.sign(v) * np.maximum(np.abs(v) - size * alpha * ratio, 0)
    assert np.allclose(w, v * scale, atol=1e-7) and np.isclose(b, y.mean() - (v * scale) @ x.mean(0))


def test_elastic_net_of_nothing(spark):
    df = spark.createDataFrame([], "a double, y double")
    assert L.elastic_net(df, ["a"], "y") == ([0.0], 0.0)
    flat = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0)], "a double, y double")
    assert L.elastic_net(flat, ["a"], "y") == ([0.0], 5.0)


def plain_stumps(rows, edges, train, rounds, rate, least):
    names = list(edges)
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], dtype=float)
    y = np.array([np.nan if r[4] is None else r[4] for r in rows], dtype=float)
    fit, check = train & ~np.isnan(y), ~train & ~np.isnan(y)
    pred, chosen = np.full(len(y), y[fit].mean()), []
    for _ in range(rounds):
        best = None
        for i, f in enumerate(names):
            for edge in edges[f]:
                left = x[:, i] <= edge
                if min((fit & left).sum(), (fit & ~left).sum()) < least:
                    continue
                step = np.where(left, (y - pred)[fit & left].mean(), (y - pred)[fit & ~left].mean())
                error = ((y - pred - rate * step)[check] ** 2).sum()
                if best is None or error < best[0] - 1e-9:
                    best = error, f, edge, step
        if best is None:
            break
        chosen.append(best[1:3])
        pred = pred + rate * best[3]
    return pred, chosen


def test_boosted_stumps(table):
    rows, df = table
    train = c("i") % 3 != 0
    edges = L.quantile_edges(df.filter(train & c("a").isNotNull() & ~F.isnan("b")), ["a", "b", "x"], 8)
    assert all(es == sorted(set(es)) for es in edges.values()) and edges["b"] == [1.0, 2.0, 3.0, 4.0]
    model = L.boosted_stumps(df, ["a", "b", "x"], "y", train, ~train, rounds=20, rate=0.4, edges=edges)
    pred, chosen = plain_stumps(rows, edges, np.array([r[0] % 3 != 0 for r in rows]), 20, 0.4, 5)
    assert [(s.feature, s.edge) for s in model.stumps] == chosen and len(chosen) > L.WRITE_EVERY
    got = {r.i: r.p for r in df.select("i", model.prediction().alias("p")).collect()}
    # NaN compares as the largest number in Spark, so it goes right like NULL.
    assert np.allclose([got[r[0]] for r in rows], pred, atol=1e-9)


def test_stumps_without_a_split(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 3.0)], "a double, y double")
    model = L.boosted_stumps(df, ["a"], "y", F.lit(True), F.lit(False), rounds=3)
    assert model.stumps == () and model.base == 3.0
    assert L.boosted_stumps(df.limit(0), ["a"], "y", F.lit(True), F.lit(False), edges={"a": [1.0]}).base == 0.0


def plain_isotonic(points):
    xs = sorted({x for x, _ in points})
    total, n = {x: 0.0 for x in xs}, {x: 0 for x in xs}
    for x, y in points:
        total[x] += y
        n[x] += 1
    t, m = np.r_[0, np.cumsum([total[x] for x in xs])], np.r_[0, np.cumsum([n[x] for x in xs])]
    return {x: max(min((t[b + 1] - t[a]) / (m[b + 1] - m[a]) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "flat"])
def test_isotonic_against_the_max_min_form(spark, shape):
    rng = random.Random(3)
    y = {"noise": lambda x: float(rng.random() < x), "rising": lambda x: x, "falling": lambda x: -x, "flat": lambda x: 1.0}[shape]
    points = [(x, y(x)) for x in (rng.choice([round(rng.random(), 2), 0.5, 0.0, 1.0]) for _ in range(700))]
    df = spark.createDataFrame([*points, (None, 1.0), (float("nan"), 1.0), (0.3, None), (1.5, 1.0), (-0.1, 0.0)], "s double, y double").repartition(5)
    pools = L.isotonic(df, "s", "y").cache()
    want = plain_isotonic(points)
    got = {r.s: r.v for r in L.with_isotonic(spark.createDataFrame([(x,) for x in want], "s double"), "s", pools, "v").collect()}
    assert np.allclose([got[x] for x in want], [want[x] for x in want], atol=1e-9)
    rows = sorted(map(tuple, pools.select("lo", "hi", "value", "n").collect()))
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(rows, rows[1:])) and sum(r[3] for r in rows) == len(points)
    if shape in ("falling", "flat"):
        assert len(rows) == 1


def test_isotonic_between_and_beyond_its_pools(spark):
    pools = L.isotonic(spark.createDataFrame([(0.2, 0.0), (0.4, 0.0), (0.8, 1.0)], "s double, y double"), "s", "y")
    ask = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (2.0,), (None,)], "s double")
    assert [r.v if r.v is None else round(r.v, 9) for r in L.with_isotonic(ask, "s", pools, "v").collect()] == [0.0, 0.0, 0.5, 1.0, None]
    nothing = L.isotonic(ask.withColumn("y", F.lit(None).cast("double")), "s", "y")
    assert {r.v for r in L.with_isotonic(ask, "s", nothing, "v").collect()} == {None}


def test_platt(spark):
    rng = random.Random(9)
    points = [(x, float(rng.random() < 1 / (1 + np.exp(-(3 * x - 1))))) for x in (rng.gauss(0, 1) for _ in range(500))]
    df = spark.createDataFrame([*points, (None, 1.0), (0.5, None)], "s double, y double")
    x, y = np.array(points).T
    for penalty in (0.0, 1.0):
        a, b = L.platt(df, "s", "y", penalty)
        p = 1 / (1 + np.exp(-(a * x + b)))
        assert abs(((p - y) * x).sum() + penalty * a) < 1e-6 and abs((p - y).sum()) < 1e-6
    got = df.select(L.platt_prediction("s", a, b).alias("p")).collect()
    assert np.isclose(got[0].p, p[0]) and got[-2].p is None
    assert L.platt(df.limit(0), "s", "y") == (0.0, 0.0)


def plain_grid(rows, steps, thresholds, gates, block):
    out = {}
    rows = sorted(r for r in rows if all(v is not None for v in r))
    for w, t, g in product(W.simplex(2, steps), thresholds, gates):
        net, other, blocks, trades, gross = [], [], {}, 0, 0.0
        for time, _, a, b, real, cost in rows:
            blend = w[0] * a + w[1] * b
            if abs(blend) <= t or not W.GATES[g](np.array([[a, b]]))[0]:
                continue
            trades, gross = trades + 1, gross + np.sign(blend) * real
            net.append(np.sign(blend) * real - cost)
            other.append(np.sign(blend) * real - 1.0)
            blocks[time // block] = blocks.get(time // block, 0.0) + net[-1]
        if trades:
            path = np.cumsum(net)
            dip = (np.maximum(np.maximum.accumulate(path), 0) - path).max()
            out[";".join(f"{x:g}" for x in w), t, g] = (trades, gross, sum(net), sum(other), np.mean(np.array(net) > 0), dip, np.mean([v > 0 for v in blocks.values()]), min(blocks.values()))
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_weight_grid(spark, batch):
    rng = random.Random(4)
    rows = [(rng.randrange(400), i, rng.gauss(0, 2), rng.gauss(0, 2), rng.gauss(0, 3), abs(rng.gauss(0, 1))) for i in range(500)] + [(5, 900, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t long, i int, a double, b double, real double, cost double").withColumn("one", F.lit(1.0)).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = W.score_grid(df, "t", ["a", "b"], "real", ["cost", "one"], 50, 5, (0.0, 1.5), ("none", "same_sign"), ["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_grid(rows, 5, (0.0, 1.5), ("none", "same_sign"), 50)
    assert len(got) == len(want) == 24
    for r in got:
        assert np.allclose((r.rows, r.gross, r.net0, r.net1, r.win_rate, r.dip, r.good_blocks, r.worst_block), want[r.weights, r.threshold, r.gate], atol=1e-9)


def test_simplex_and_empty_grid(spark):
    assert W.simplex(2, 2) == [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0)] and len(W.simplex(4, 10)) == 286
    df = spark.createDataFrame([], "t long, a double, real double, cost double")
    assert W.ranked_grid(W.score_grid(df, "t", ["a"], "real", ["cost"], 10), 5).count() == 0


def test_softmax_is_the_minimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x @ np.array([[1.0, -1.0, 0.2], [0.5, 0.5, -1.5]]) + rng.gumbel(size=(400, 3))).argmax(axis=1)
    rows = [(float(a), float(b), int(v)) for (a, b), v in zip(x, y)]
    df = spark.createDataFrame([*rows, (None, 1.0, 0), (1.0, float("nan"), 1), (1.0, 1.0, None), (1.0, 1.0, 7)], "a double, b double, y int").repartition(4)
    w = L.softmax_weights(df, ["a", "b"], "y", 3, l2=0.01)
    each = 400 / (3 * np.bincount(y))
    one = np.column_stack([np.ones(400), x])

    def slope(w):
        p = np.exp(one @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        return ((p - np.eye(3)[y]) * each[y][:, None]).T @ one / 400 + 0.01 * w * np.array([0.0, 1.0, 1.0])

    assert np.abs(slope(w)).max() < 1e-7
    got = df.limit(0).unionByName(spark.createDataFrame(rows[:5], "a double, b double, y int")).select(*[p.alias(f"p{i}") for i, p in enumerate(L.softmax_prediction(["a", "b"], w))]).collect()
    p = np.exp(one[:5] @ w.T)
    assert np.allclose([tuple(r) for r in got], p / p.sum(axis=1, keepdims=True))
    assert L.softmax_weights(df.limit(0), ["a", "b"], "y", 3).tolist() == [[0.0] * 3] * 3
    assert np.isfinite(L.softmax_weights(df.filter("y = 1"), ["a"], "y", 3)).all()


def test_isotonic_projection_and_interpolation(spark):
    from tidemark.operators import sequences as Q

    df = spark.createDataFrame([([3.0, 1.0, 2.0, 5.0, 4.0],), ([],), (None,), ([1.0, None],), ([1.0] * 3,)], "x array<double>")
    assert [r.v for r in df.select(Q.isotonic(c("x")).alias("v")).collect()] == [[2.0, 2.0, 2.0, 4.5, 4.5], [], None, None, [1.0] * 3]
    line = spark.createDataFrame([([0.0, 1.0, 3.0], [5.0, 7.0, 3.0], [-1.0, 0.0, 0.5, 1.0, 2.0, 9.0]), ([], [], [1.0])], "x array<double>, y array<double>, at array<double>")
    got = [r.v for r in line.select(Q.interp(c("at"), c("x"), c("y")).alias("v")).collect()]
    assert got == [np.interp([-1.0, 0.0, 0.5, 1.0, 2.0, 9.0], [0.0, 1.0, 3.0], [5.0, 7.0, 3.0]).tolist(), None]


def test_contract_status(spark):
    from tidemark.operators.metrics import contract_survivors

    rows = [("a", 1, 0.0, 50, 3.0), ("a", 2, 0.0, 50, 4.0), ("b", 1, 0.2, 3, 3.0), ("b", 2, 0.3, 2, -1.0), ("c", 1, 0.2, 40, 5.0), ("c", 2, 0.0, 40, None), ("d", 1, 0.2, 40, -5.0), ("d", 2, 0.5, 4, -1.0)]
    df = spark.createDataFrame(rows, "k string, w int, t double, n int, total double")
    got = {r.k: (r.status, r.windows, r.positive_windows, r.sparse_high, r.worst) for r in contract_survivors(df, ["k"], "w", "t", "n", "total", 10).collect()}
    assert got == {"a": ("zero_only", 2, 2, 0, 3.0), "b": ("too_few_rows", 2, 1, 2, -1.0), "c": ("candidate", 2, 1, 0, 5.0), "d": ("unstable", 2, 0, 1, -5.0)}
