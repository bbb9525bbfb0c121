"""As-of joins and recurrences over blocks of time: one key spreads over tasks, results stay those of one pass."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof
from tidemark.operators.indicators import ema_paths, macd, wilder_rsi
from tidemark.operators.sequential import non_overlapping

c = F.col


def plain_asof(left, right, direction, max_age, offset):
    out = []
    for key, i, t in left:
        best = None
        for rkey, seq, rt in right:
            if rkey != key or t is None or rt is None:
                continue
            gap = rt - (t + offset)
            ok = {"backward": gap <= 0, "forward": gap >= 0, "nearest": True}[direction]
            if not ok or max_age is not None and abs(gap) > max_age:
                continue
            rank = (abs(gap), gap > 0, -seq)
            if best is None or rank < best[0]:
                best = rank, seq, abs(gap)
        out.append((i, *(best[1:] if best else (None, None))))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize(("block", "max_age", "offset"), [(10, None, 0), (7, 25, 3), (1, 4, -2), (10_000, None, 0)])
def test_asof_in_blocks(spark, direction, block, max_age, offset):
    rng = random.Random(block)
    key = lambda: rng.choice(["a", "a", "a", "b", None, "only left"])
    left = [(key(), i, rng.randrange(-50, 200)) for i in range(120)]
    right = [(rng.choice(["a", "b", None, "only right"]), s, rng.choice([rng.randrange(-60, 210), 40, 90])) for s in range(60)]
    l = spark.createDataFrame(left, "k string, i int, t long").repartition(3)
    r = spark.createDataFrame(right, "k string, seq int, t long").repartition(3)
    got = asof(l, r, ["k"], "t", ["seq"], direction, "x_", max_age, right_seq="seq", offset=offset, block=block)
    assert sorted((x.i, x.x_seq, x.x_age) for x in got.collect()) == plain_asof(left, right, direction, max_age, offset)
    assert got.columns == ["k", "i", "t", "x_seq", "x_t", "x_age"]


def test_one_key_lies_in_many_tasks(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), c("id").alias("t"), c("id").alias("v"))
    few = rows.filter("t % 1000 = 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = asof(rows, few, ["k"], "t", ["v"], block=50)
        ema = ema_paths(rows.withColumn("x", c("v").cast("double")), ["k"], ["t"], "x", {"y": 0.1}, block=50)
        for df in (got, ema):
            per = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(per) == 4 and max(r["count"] for r in per) < 2500
        assert got.filter("ctx_v != floor(t / 1000) * 1000").count() == 0 and got.count() == 4000
        # No window or fold reads rows by the key alone: its only exchanges are of one row a block.
        plan = asof(rows, few, ["k"], "t", ["v"], block=50)._jdf.queryExecution().executedPlan().toString()
        assert "_block" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", [3, 40, 100_000])
def test_exponential_means_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(k, t, None if rng.random() < 0.2 or t < 8 and k == "late" else rng.gauss(10, 3), rng.gauss(0, 1)) for k in ("a", "late", None) for t in range(150)]
    rows += [("void", t, None, 1.0) for t in range(20)] + [("one", 5, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, t long, x double, z double").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.k, r.t): r for r in ema_paths(df, ["k"], ["t"], "x", {"p": 0.1, "q": ("z", 0.5)}, least=3, block=block).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    frame = pd.DataFrame(rows, columns=["k", "t", "x", "z"]).astype({"x": float, "z": float})
    for key, part in frame.groupby("k", dropna=False):
        part = part.sort_values("t")
        for column, name, alpha in (("x", "p", 0.1), ("z", "q", 0.5)):
            want = part[column].ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=3).mean().to_numpy()
            have = np.array([v if (v := got[None if key != key else key, t][name]) is not None else np.nan for t in part["t"]])
            assert np.allclose(have, want, atol=1e-9, equal_nan=True)


def test_macd_and_wilder_over_blocks(spark):
    rng = random.Random(8)
    day = 86_400_000
    x = np.cumsum([rng.gauss(0, 1) for _ in range(200)]) + 100
    df = spark.createDataFrame([("a", i * day, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    s = pd.Series(x)
    mean = lambda v, span: v.ewm(span=span, adjust=False).mean()
    line = mean(s, 12) - mean(s, 26)
    got = sorted(macd(df, ["k"], ["t"], "x").collect(), key=lambda r: r.t)
    assert np.allclose([r.macd_hist for r in got], line - mean(line, 9), atol=1e-9)
    change = s.diff()
    up, down = (v.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for v in (change.clip(lower=0), (-change).clip(lower=0)))
    rsi = sorted(wilder_rsi(df, ["k"], ["t"], "x", 14).collect(), key=lambda r: r.t)
    assert np.allclose([np.nan if r.rsi_wilder is None else r.rsi_wilder for r in rsi], 100 - 100 / (1 + up / down), atol=1e-6, equal_nan=True)


def plain_selection(rows, horizon):
    free, kept = {}, []
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in free or t >= free[k]:
            kept.append((k, t, i))
            free[k] = t + horizon
    return sorted(kept, key=str)


@pytest.mark.parametrize("horizon, block, span", [(1, 1, 60), (7, 7, 300), (7, 20, 300), (50, 64, 4000), (50, 1000, 4000), (3, None, 900), (1000, None, 900)])
def test_selection_in_blocks(spark, horizon, block, span):
    rng = random.Random(horizon * 1000 + (block or 0))
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(-span, span), i) for i in range(700)]
    rows += [("every", t, 1000 + t) for t in range(200)]  # no two chains meet
    rows += [("far", t, 5000 + t) for t in (-span * 9, 0, span * 50)] + [("one", 5, 1), ("one", 5, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [("a", None, 9999, "x")], "k string, t long, i long, _n string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = non_overlapping(df, ["k"], "t", "i", horizon, block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted([tuple(r) for r in got], key=str) == plain_selection(rows, horizon)


def test_selection_of_one_key_lies_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), c("id").alias("t"), c("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = non_overlapping(rows, ["k"], "t", "i", 7)
        per = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(per) == 4 and sum(per) == -(-20_000 // 7) and max(per) < 0.5 * sum(per)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert non_overlapping(rows, ["k"], "t", "i", 0).count() == 20_000
    assert non_overlapping(rows.limit(0), ["k"], "t", "i", 7).collect() == []
