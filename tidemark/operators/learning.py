"""Models fitted from sums: elastic net, boosted stumps, Platt and isotonic calibration.

Every fit reads the rows as one aggregate a step, of the size of columns, bins or pools; no row reaches the
driver. Rows with a NULL or NaN feature or target take no part in a fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import scratch_path

c = F.col


def _finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for x in columns:
        ok = ok & x.isNotNull() & ~F.isnan(x.cast("double"))
    return ok


# Elastic net ---------------------------------------------------------------------------------------------


def _moments(df: DataFrame, names: Sequence[str], target: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, covariances of the features and the target together, from one aggregate of centred sums."""
    every = [*names, target]
    ok = df.select(*[c(f).cast("double").alias(f"x{i}") for i, f in enumerate(every)]).filter(_finite(*[c(f"x{i}") for i in range(len(every))]))
    pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    r = ok.agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(every))], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    k, cov = len(names), np.zeros((len(every), len(every)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    return r["n"], np.array([r[f"m{i}"] or 0.0 for i in range(len(every))]), cov[:k, :k], cov[:, k]


def elastic_net(df: DataFrame, features: Sequence[str], target: str, alpha: float = 0.01, l1_ratio: float = 0.5, rounds: int = 10_000, tolerance: float = 1e-12) -> tuple[list[float], float]:
    """Weights and intercept: squared error / 2n + alpha * (l1 |w| + (1 - l1) w^2 / 2), the target scaled by its deviation.

    Coordinate descent runs on the Gram matrix, which is the size of the columns; the rows are read once.
    """
    n, mean, gram, moment = _moments(df, features, target)
    scale = float(np.sqrt(moment[-1])) if n and moment[-1] > 1e-24 else 1.0
    want, w = moment[:-1] / scale, np.zeros(len(features))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            pull = want[j] - gram[j] @ w + gram[j, j] * w[j]
            room = gram[j, j] + alpha * (1 - l1_ratio)
            w[j] = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0.0) / room if room > 0 else 0.0
        if np.abs(w - before).max(initial=0.0) <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    w = w * scale
    return w.tolist(), float(mean[-1] - w @ mean[:-1])


# Softmax -------------------------------------------------------------------------------------------------


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def softmax_weights(df: DataFrame, features: Sequence[str], label: str, classes: int, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """(classes, 1 + features) weights, intercept first, of a multinomial logit with classes of equal total weight.

    The loss is the weighted mean log loss plus l2 / 2 times the squared weights (not the intercepts). Each damped
    Newton step is one pass: tasks add up gradient, Hessian and loss, whose size is that of the columns.
    """
    rows = df.select(c(label).cast("int").alias("y"), F.array(*[c(f).cast("double") for f in features]).alias("x")).filter(_finite(c(label), *[c(f) for f in features]) & c(label).between(0, classes - 1))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a class
    n, k = sum(counts.values()), len(features) + 1
    if not n:
        return np.zeros((classes, k))
    each = np.array([n / (classes * counts[y]) if counts.get(y) else 0.0 for y in range(classes)])
    size = classes * k

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad, hess = 0.0, np.zeros(size), np.zeros((size, size))
            for batch in batches:
                y = batch.column(0).to_numpy()
                x = np.column_stack([np.ones(len(y)), batch.column(1).flatten().to_numpy().reshape(len(y), k - 1)])
                p, weight = _softmax(x @ w.T), each[y]
                loss -= float((weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
                grad += ((p - np.eye(classes)[y]) * weight[:, None]).T.dot(x).ravel()
                for a in range(classes):
                    for b in range(classes):
                        q = weight * p[:, a] * ((a == b) - p[:, b])
                        hess[a * k : (a + 1) * k, b * k : (b + 1) * k] += (x * q[:, None]).T @ x
            every = np.concatenate([[loss], grad, hess.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), pa.array(every)], names=["i", "v"])

        got = {r["i"]: r["v"] for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        every = np.array([got[i] for i in range(1 + size + size * size)]) / n
        ridge = np.tile(np.r_[0.0, np.full(k - 1, l2)], classes)
        return every[0] + float((ridge * w.ravel() ** 2).sum()) / 2, every[1 : size + 1] + ridge * w.ravel(), every[size + 1 :].reshape(size, size) + np.diag(ridge)

    w = np.zeros((classes, k))
    now, grad, hess = sums(w)
    for _ in range(rounds):
        step, share = np.linalg.lstsq(hess, grad, rcond=1e-12)[0].reshape(classes, k), 1.0
        while True:
            then = sums(w - share * step)
            if then[0] <= now or share < 1e-6:
                break
            share /= 2
        done = now - then[0] <= 1e-13 * max(1.0, abs(now))
        w, (now, grad, hess) = w - share * step, then
        if done:
            break
    return w - w.mean(axis=0)  # probabilities do not change; intercepts become unique


def softmax_prediction(features: Sequence[str], w: np.ndarray) -> list[Column]:
    """Probability of each class."""
    scores = [F.lit(float(r[0])) + sum((c(f) * F.lit(float(v)) for f, v in zip(features, r[1:])), F.lit(0.0)) for r in w]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


# Boosted stumps ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stump:
    """One split: rows with feature <= edge (NULL goes right) get left, the others right."""

    feature: str
    edge: float
    left: float
    right: float

    def value(self) -> Column:
        return F.when(c(self.feature) <= self.edge, F.lit(self.left)).otherwise(F.lit(self.right))


@dataclass(frozen=True)
class Boosted:
    base: float
    rate: float
    stumps: tuple[Stump, ...]

    def prediction(self) -> Column:
        return F.lit(self.base) + sum((F.lit(self.rate) * s.value() for s in self.stumps), F.lit(0.0))


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct inner quantiles of each feature: (bins - 1) values a feature."""
    cuts = [i / bins for i in range(1, bins)]
    r = df.agg(*[F.percentile_approx(c(f).cast("double"), cuts).alias(f) for f in features]).first()
    return {f: sorted(set(r[f] or [])) for f in features}


def _bin(feature: str, edges: list[float]) -> Column:
    """Number of edges below the value: a row is left of an edge exactly if this is at most the edge's place. NULL is right of all."""
    below = F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < c(feature))
    return F.when(_finite(c(feature)), F.size(below)).otherwise(len(edges)).cast("int")


def boosted_stumps(df: DataFrame, features: Sequence[str], target: str, train: Column, validation: Column, rounds: int = 20, rate: float = 0.1, bins: int = 32, least: int = 5, edges: dict[str, list[float]] | None = None) -> Boosted:
    """Stumps on the residuals of the training rows; each round takes the split with the least validation error.

    Features are binned once. A round is one aggregate of residual sums per (feature, bin), from which the sums on
    both sides of every edge follow; leaves are the training means, and a split needs `least` training rows on
    each side. The residuals are written every WRITE_EVERY rounds, so that a plan stays short.
    """
    edges = edges or quantile_edges(df.filter(train), features, bins)
    bin_of = [_bin(f, edges[f]) for f in features]
    part = F.when(train, 0).when(validation, 1)
    base = df.filter(train & _finite(c(target))).agg(F.avg(c(target).cast("double"))).first()[0] or 0.0
    rows = df.filter(_finite(c(target))).select(part.alias("part"), F.array(*bin_of).alias("bins"), (c(target).cast("double") - base).alias("rest")).filter("part is not null")
    rows, stumps = _written(rows, "binned"), []
    for n in range(rounds):
        cells = rows.select("part", "rest", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin", "part").agg(F.count("*").alias("n"), F.sum("rest").alias("s"))
        count, total = [np.zeros((2, len(features), max(map(len, edges.values())) + 1)) for _ in range(2)]
        for r in cells.collect():  # features x bins x 2
            count[r["part"], r["feature"], r["bin"]], total[r["part"], r["feature"], r["bin"]] = r["n"], r["s"]
        best = None
        for i, f in enumerate(features):
            left, up = np.cumsum(count[:, i], axis=1), np.cumsum(total[:, i], axis=1)
            for j, edge in enumerate(edges[f]):
                size, mass = np.array([left[:, j], left[:, -1] - left[:, j]]), np.array([up[:, j], up[:, -1] - up[:, j]])
                if size[:, 0].min() < least:
                    continue
                mean = mass[:, 0] / size[:, 0]
                gain = float((2 * rate * mean * mass[:, 1] - rate**2 * mean**2 * size[:, 1]).sum())  # fall of the validation error
                if best is None or gain > best[0]:
                    best = gain, i, j, Stump(f, edge, float(mean[0]), float(mean[1]))
        if best is None:
            break
        _, i, j, stump = best
        stumps.append(stump)
        step = F.when(c("bins")[i] <= j, F.lit(stump.left)).otherwise(F.lit(stump.right))
        rows = rows.withColumn("rest", c("rest") - rate * step)
        if n % WRITE_EVERY == WRITE_EVERY - 1:
            rows = _written(rows, "residuals")
    return Boosted(float(base), rate, tuple(stumps))


WRITE_EVERY = 16


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Calibration ---------------------------------------------------------------------------------------------


def platt(df: DataFrame, score: str, label: str, penalty: float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve over a score: Newton steps, each from six sums; penalty on the slope."""
    rows = df.select(c(score).cast("double").alias("x"), c(label).cast("double").alias("y")).filter(_finite(c("x"), c("y")))
    a = b = 0.0
    for _ in range(rounds):
        z = F.least(F.greatest(F.lit(a) * c("x") + F.lit(b), F.lit(-40.0)), F.lit(40.0))
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        r = rows.agg(F.sum((p - c("y")) * c("x")).alias("ga"), F.sum(p - c("y")).alias("gb"), F.sum(w * c("x") * c("x")).alias("aa"), F.sum(w * c("x")).alias("ab"), F.sum(w).alias("bb")).first()
        if r["bb"] is None:
            return 0.0, 0.0
        slope = np.array([r["ga"] + penalty * a, r["gb"]])
        step = np.linalg.solve(np.array([[r["aa"] + penalty, r["ab"]], [r["ab"], r["bb"]]]) + 1e-12 * np.eye(2), slope)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-10 * max(1.0, abs(a), abs(b)):
            break
    return a, b


def platt_prediction(score: str, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(c(score) * F.lit(slope) + F.lit(intercept))))


def _pools(stack: list[list[float]], lo: Iterable[float], hi: Iterable[float], total: Iterable[float], n: Iterable[float]) -> None:
    """Push sorted pools on the stack; neighbours out of order become one."""
    for pool in zip(lo, hi, total, n):
        stack.append(list(pool))
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, top, more, count = stack.pop()
            stack[-1][1], stack[-1][2], stack[-1][3] = top, stack[-1][2] + more, stack[-1][3] + count


def _pool_adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[list[float]] = []
    for batch in batches:
        _pools(stack, *(x.to_pylist() for x in batch.columns))
    if stack:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in zip(*stack)], names=["lo", "hi", "total", "n"])


def isotonic(df: DataFrame, score: str, label: str, digits: int = 6) -> DataFrame:
    """(lo, hi, value, n): the pools of the non-decreasing curve nearest to the labels, by pool-adjacent-violators.

    Scores lie in 0 to 1 and are rounded to `digits` decimals, which bounds the pools by 10^digits + 1; rows with
    other, NULL or NaN scores or labels take no part. Blocks of sorted scores are pooled apart; pooling is
    associative, so pooling their pools once more gives the pools of all rows.
    """
    x = F.round(c(score).cast("double"), digits)
    rows = df.filter(_finite(c(score), c(label)) & x.between(0, 1)).groupBy(x.alias("lo")).agg(F.sum(c(label).cast("double")).alias("total"), F.count("*").cast("double").alias("n"))
    shape = "lo double, hi double, total double, n double"
    blocks = rows.select("lo", c("lo").alias("hi"), "total", "n").repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(_pool_adjacent, shape)
    pools = blocks.coalesce(1).sortWithinPartitions("lo").mapInArrow(_pool_adjacent, shape)
    return pools.select("lo", "hi", (c("total") / c("n")).alias("value"), c("n").cast("long").alias("n"))


def with_isotonic(df: DataFrame, score: str, pools: DataFrame, out: str) -> DataFrame:
    """df with the curve's value: that of the pool, between two pools on the line between them, outside them the nearest."""
    knots = pools.select(F.explode(F.array(F.struct(c("lo").alias("x"), "value"), F.struct(c("hi").alias("x"), "value"))).alias("k")).select("k.*").distinct().orderBy("x").collect()
    shared = df.sparkSession.sparkContext.broadcast((np.array([k.x for k in knots]), np.array([k.value for k in knots])))  # 10^digits pools at most

    @F.pandas_udf("double")
    def curve(x: pd.Series) -> pd.Series:
        at, value = shared.value
        got = np.interp(x.to_numpy(dtype=float), at, value) if len(at) else np.full(len(x), np.nan)
        return pd.Series(got).where(x.notna().to_numpy() & ~np.isnan(got), None)

    return df.withColumn(out, curve(c(score).cast("double")))
