"""Feature redundancy, stability, scalers, baselines, ensembles, linear models."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import safe_div

c = F.col


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every pair, all in one pass over the rows."""
    pairs = list(combinations(sorted(features), 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(f"{a}|{b}").alias("corr")) for a, b in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def redundancy_clusters(pairs: DataFrame, features: Sequence[str], limit: float) -> dict[str, str]:
    """Representative (smallest name) of each feature's cluster; features are columns, so this is small."""
    root = {f: f for f in features}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in pairs.filter(F.abs("corr") >= limit).collect():  # at most one row a pair of columns
        a, b = sorted((find(r["a"]), find(r["b"])))
        root[b] = a
    return {f: find(f) for f in features}


def block_stability(df: DataFrame, position: str, n: int, value: str, target: str, blocks: int = 6) -> DataFrame:
    """Coefficient of variation of block means and agreement of the correlation's sign."""
    b = F.least(F.floor(c(position) * blocks / F.lit(n)), F.lit(blocks - 1))
    per = df.groupBy(b.alias("block")).agg(F.avg(value).alias("m"), F.corr(value, target).alias("r"))
    return per.agg(F.count("*").alias("blocks"), safe_div(F.stddev_pop("m"), F.abs(F.avg("m"))).alias("mean_cv"), (F.abs(F.sum(F.signum("r"))) / F.count("r")).alias("sign_stability"))


def decision(invalid: Column, redundant: Column, unstable: Column) -> Column:
    return F.when(invalid, "invalid").when(redundant, "redundant").when(unstable, "unstable").otherwise("keep")


def fit_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std) with std <= 1e-8 set to 1."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}|m"), F.stddev_pop(f).alias(f"{f}|s")]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), c(f"{f}|m").alias("mean"), F.when(c(f"{f}|s") <= 1e-8, 1.0).otherwise(c(f"{f}|s")).alias("std")) for f in features])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def scale(df: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """Standardise by training rows; NULL becomes the training mean, so 0."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.when(train, c(f))).alias(f"_{f}_m"), F.stddev_pop(F.when(train, c(f))).alias(f"_{f}_s")]
    one = df.agg(*aggs)
    out = df.crossJoin(F.broadcast(one))  # one row of constants
    out = out.withColumns({f"{f}_z": F.coalesce((c(f) - c(f"_{f}_m")) / F.when(c(f"_{f}_s") <= 1e-8, 1.0).otherwise(c(f"_{f}_s")), F.lit(0.0)) for f in features})
    return out.drop(*[f"_{f}_{x}" for f in features for x in "ms"])


def baselines(df: DataFrame, keys: Sequence[str], order: Sequence[str], target: str, train: Column) -> DataFrame:
    """MAE of zero, train mean, train median and persistence on the other rows."""
    stats = df.filter(train).groupBy(*keys).agg(F.avg(target).alias("_mean"), F.percentile(target, 0.5).alias("_median"))
    before = F.lag(target).over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("_before", before).filter(~train).join(stats, list(keys))
    mae = lambda x: F.avg(F.abs(c(target) - x))
    return rows.groupBy(*keys).agg(mae(F.lit(0.0)).alias("zero"), mae(c("_mean")).alias("train_mean"), mae(c("_median")).alias("train_median"), mae(c("_before")).alias("persistence"), F.avg((c(target) > 0).cast("double")).alias("always_long"), F.avg((F.signum(c(target)) == F.signum("_before")).cast("double")).alias("momentum"))


def ensemble(preds: dict[str, float]) -> Column:
    """Weighted mean of predictions; missing ones give their weight to the others."""
    top = sum((F.coalesce(c(k) * w, F.lit(0.0)) for k, w in preds.items()), F.lit(0.0))
    weight = sum((F.when(c(k).isNotNull(), w).otherwise(0.0) for k, w in preds.items()), F.lit(0.0))
    return safe_div(top, weight)


def ridge(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0) -> tuple[list[float], float]:
    """Weights and intercept from the normal equations; sums are one aggregate, the solve is columns-sized."""
    names = list(features)
    ok = df.select(*[c(f).cast("double").alias(f) for f in names], c(target).cast("double").alias("_y")).dropna()
    cols = [F.count("*").alias("n"), F.sum("_y").alias("y")] + [F.sum(f).alias(f"s_{i}") for i, f in enumerate(names)] + [F.sum(c(f) * c("_y")).alias(f"t_{i}") for i, f in enumerate(names)]
    cols += [F.sum(c(a) * c(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    r = ok.agg(*cols).first()
    k = len(names)
    gram = np.zeros((k + 1, k + 1))
    right = np.array([*(r[f"t_{i}"] or 0.0 for i in range(k)), r["y"] or 0.0])
    for i in range(k):
        gram[i, k] = gram[k, i] = r[f"s_{i}"] or 0.0
        for j in range(i, k):
            gram[i, j] = gram[j, i] = r[f"g_{i}_{j}"] or 0.0
        gram[i, i] += penalty
    gram[k, k] = max(1, r["n"])
    w = np.linalg.solve(gram, right)
    return w[:k].tolist(), float(w[k])


def linear_prediction(features: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for f, w in zip(features, weights):
        out = out + c(f) * F.lit(float(w))
    return out


def out_of_fold(df: DataFrame, position: str, folds: Sequence[tuple[int, int, int, int]], features: Sequence[str], target: str, penalty: float = 1.0) -> DataFrame:
    """Ridge predictions for each fold's validation rows from rows before its gap (V8)."""
    parts = []
    for k, train_end, start, end in folds:
        w, b = ridge(df.filter(c(position) < train_end), features, target, penalty)
        parts.append(df.filter((c(position) >= start) & (c(position) < end)).withColumn("fold", F.lit(k)).withColumn("oof", linear_prediction(features, w, b)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ml_model(kind: str, features: Sequence[str], target: str, **options):
    """An unfitted pyspark.ml pipeline: logistic, softmax, elastic_net, gbt, forest, mlp or isotonic."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression, LinearRegression

    makers = {
        "logistic": lambda: LogisticRegression(labelCol=target, **options), "softmax": lambda: LogisticRegression(labelCol=target, family="multinomial", **options),
        "elastic_net": lambda: LinearRegression(labelCol=target, **({"elasticNetParam": 0.5, "regParam": 0.01} | options)), "gbt": lambda: GBTClassifier(labelCol=target, **options),
        "forest": lambda: RandomForestClassifier(labelCol=target, **options), "mlp": lambda: MultilayerPerceptronClassifier(labelCol=target, **options), "isotonic": lambda: IsotonicRegression(labelCol=target, **options),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), makers[kind]()])


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column) -> DataFrame:
    """Number, mean and maximum length of runs per state: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("state", state)
    df = df.withColumn("_new", F.coalesce((F.lag("state").over(w) != c("state")).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = df.groupBy(*keys, "_run").agg(F.first("state").alias("state"), F.count("*").alias("n"))
    return per.groupBy("state").agg(F.count("*").alias("runs"), F.avg("n").alias("mean_length"), F.max("n").alias("max_length"))


def regime_calibration(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column, value: str, qs: Sequence[float] = (0.05, 0.33, 0.67, 0.95)) -> DataFrame:
    """Per state: share of rows, quantiles of a value, and number, mean and quantiles (0.1, 0.5, 0.9) of run lengths."""
    marked = df.withColumn("state", state).filter("state is not null")
    whole = marked.groupBy("state").agg(F.count("*").alias("_n"), F.avg(value).alias("mean"), F.percentile(value, list(qs)).alias("_q"))
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = marked.withColumn("_new", F.coalesce((F.lag("state").over(w) != c("state")).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.first("state").alias("state"), F.count("*").alias("_l"))
    lengths = runs.groupBy("state").agg(F.count("*").alias("runs"), F.avg("_l").alias("mean_length"), F.percentile("_l", [0.1, 0.5, 0.9]).alias("_d"))
    out = whole.join(lengths, "state").crossJoin(F.broadcast(marked.agg(F.count("*").alias("_all"))))  # one row a state; one row
    return out.select("state", (c("_n") / c("_all")).alias("share"), "mean", *[c("_q")[i].alias(f"q{round(q * 100):02d}") for i, q in enumerate(qs)], "runs", "mean_length", *[c("_d")[i].alias(f"length{x}") for i, x in enumerate((10, 50, 90))])


def _nearest(left: pd.DataFrame, right: pd.DataFrame, rows: int = 512) -> pd.DataFrame:
    """Per row of left (name, z) the nearest row of right (other, o) that is not itself; ties to the smaller name."""
    right = right.sort_values("other", ignore_index=True)
    o, out = np.stack(right["o"].to_numpy()), []
    for at in range(0, len(left), rows):
        part = left.iloc[at : at + rows]
        z = np.stack(part["z"].to_numpy())
        d = np.sqrt(sum((z[:, None, i] - o[None, :, i]) ** 2 for i in range(z.shape[1])))
        d[part["name"].to_numpy()[:, None] == right["other"].to_numpy()[None, :]] = np.inf
        best = d.argmin(axis=1)
        out.append(pd.DataFrame({"name": part["name"].to_numpy(), "other": right["other"].to_numpy()[best], "d": d[np.arange(len(part)), best]}))
    found = pd.concat(out) if out else pd.DataFrame({"name": [], "other": [], "d": []})
    return found[np.isfinite(found["d"].to_numpy(dtype=float))]


def nearest_candidate(df: DataFrame, name: str, traits: Sequence[str], cell_rows: int = 1_000) -> DataFrame:
    """For each candidate the other one nearest in z-scored traits, distance / sqrt(k).

    Candidates without a name or with a trait that is NULL or not finite take no part: they get no row, are
    nobody's nearest and do not enter the scales. Candidates of equal traits are twins at distance 0 and stand
    as one in the search. Ties go to the smaller name. The others are dealt to cells between quantiles of the
    traits: the nearest one in its own cell bounds a candidate's distance; it then visits only cells that a box
    of that half-width touches.
    """
    k = len(traits)
    values = [c(t).cast("double") for t in traits]
    usable = F.lit(True)
    for v in (c(name), *values):
        usable = usable & v.isNotNull()
    for v in values:
        usable = usable & ~F.isnan(v) & (F.abs(v) < float("inf"))
    df = df.filter(usable)
    one = df.agg(*[F.avg(v).alias(f"_{t}_m") for t, v in zip(traits, values)], *[F.stddev_pop(v).alias(f"_{t}_s") for t, v in zip(traits, values)])
    every = df.crossJoin(F.broadcast(one)).select(c(name).alias("name"), F.array(*[safe_div(v - c(f"_{t}_m"), c(f"_{t}_s"), 0) for t, v in zip(traits, values)]).alias("z"))
    firsts = every.groupBy("z").agg(F.min("name").alias("first"))
    marked = every.join(firsts, "z")
    z = firsts.withColumnRenamed("first", "name")
    seconds = marked.filter("name != first").groupBy("z").agg(F.min("name").alias("second"))
    twins = marked.join(seconds, "z").select("name", F.when(c("name") == c("first"), c("second")).otherwise(c("first")).alias("other"), F.lit(0.0).alias("d"))
    bins = max(1, round((z.count() / cell_rows) ** (1 / k)))
    cuts = [i / bins for i in range(1, bins)]
    # Driver values: (bins - 1) edges a trait.
    edges = list(z.agg(*[F.percentile_approx(c("z")[i], cuts).alias(f"e{i}") for i in range(k)]).first()) if cuts else [[]] * k

    def bin_of(i: int, x: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges[i] or [])).cast("array<double>"), lambda e: e < x)).cast("long")

    z = z.withColumn("cell", sum((bin_of(i, c("z")[i]) * bins**i for i in range(k)), F.lit(0).cast("long")))
    kind = df.schema[name].dataType.simpleString()
    shape = f"name {kind}, other {kind}, d double"
    home = z.groupBy("cell").applyInPandas(lambda pdf: _nearest(pdf, pdf.rename(columns={"name": "other", "z": "o"})), shape)
    bound = z.join(home.select(c("name").alias("_n"), c("d").alias("near")), c("name") == c("_n"), "left").drop("_n")
    width = F.coalesce(c("near") * (1 + 1e-9), F.lit(float("inf")))
    for i in range(k):
        bound = bound.withColumn(f"b{i}", F.explode(F.sequence(bin_of(i, c("z")[i] - width), bin_of(i, c("z")[i] + width))))
    asked = bound.withColumn("to", sum((c(f"b{i}") * bins**i for i in range(k)), F.lit(0).cast("long"))).filter(c("to") != c("cell")).select("name", "z", "to")
    there = z.select(c("name").alias("other"), c("z").alias("o"), "cell")
    away = asked.groupBy("to").cogroup(there.groupBy("cell")).applyInPandas(lambda a, b: _nearest(a, b) if len(a) and len(b) else pd.DataFrame({"name": [], "other": [], "d": []}), shape)
    best = home.unionByName(away).unionByName(twins).groupBy("name").agg(F.min_by("other", F.struct("d", "other")).alias("nearest"), (F.min("d") / k**0.5).alias("distance"))
    return best.withColumnRenamed("name", name)
