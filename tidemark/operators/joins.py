"""Equi-, semi-, anti- and matched joins, upserts, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import safe_div

c = F.col


def inner_all(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Rows whose key is in every frame; equal keys share one partitioning down the chain."""
    return reduce(lambda a, b: a.join(b, list(on)), frames)


def left_with_flag(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Left join and whether a match was found."""
    return left.join(right.withColumn("_hit", F.lit(1)), list(on), "left").withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_hit")


def map_lookup(df: DataFrame, mapping: DataFrame, key: str, limit: int = 1_000_000) -> DataFrame:
    """Value of a small mapping by key; it is broadcast only while it has at most `limit` rows."""
    small = mapping.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(mapping) if small else mapping, key, "left")


def unseen(new: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of new whose keys are not in seen; NULL keys are equal to each other."""
    known = seen.select(*[c(k).alias(f"_seen_{k}") for k in on])
    same = F.lit(True)
    for k in on:
        same = same & new[k].eqNullSafe(known[f"_seen_{k}"])
    return new.join(known, same, "left_anti")


def scored_by_all(df: DataFrame, key: str, model: str, models: int) -> DataFrame:
    """Rows whose key was scored by all models: relational division."""
    whole = df.groupBy(key).agg(F.countDistinct(model).alias("_m")).filter(c("_m") == models).select(key)
    return df.join(whole, key, "left_semi")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides and in common."""
    both = a.select(key).withColumn("_s", F.lit(1)).unionByName(b.select(key).withColumn("_s", F.lit(2)))
    per = both.groupBy(key).agg(F.max(F.when(c("_s") == 1, 1).otherwise(0)).alias("x"), F.max(F.when(c("_s") == 2, 1).otherwise(0)).alias("y"))
    return per.agg(F.sum("x").alias("left_keys"), F.sum("y").alias("right_keys"), F.sum(c("x") * c("y")).alias("shared"))


def matched_pairs(df: DataFrame, on: Sequence[str], arm: str, left: str, right: str, value: str) -> DataFrame:
    """right - left of rows that agree on everything else, as one aggregate instead of a self-join."""
    per = df.groupBy(*on).agg(F.max(F.when(c(arm) == left, c(value))).alias("left_value"), F.max(F.when(c(arm) == right, c(value))).alias("right_value"))
    return per.filter("left_value is not null and right_value is not null").withColumn("delta", c("right_value") - c("left_value"))


def span_overlap(df: DataFrame, key: str, time: str, a: str, b: str, step: int) -> DataFrame:
    """Overlap of the time spans of two keys, and the rows expected in it."""
    g = df.agg(*[f(F.when(c(key) == k, c(time))).alias(n) for k, n, f in ((a, "a0", F.min), (a, "a1", F.max), (b, "b0", F.min), (b, "b1", F.max))])
    start, end = F.greatest("a0", "b0"), F.least("a1", "b1")
    return g.select(start.alias("start"), end.alias("end"), F.greatest(F.lit(0), F.floor((end - start) / step) + 1).alias("expected_rows"))


def fill_matured(rows: DataFrame, stream: DataFrame, keys: Sequence[str], time: str, price: str, horizon: int, column: str) -> DataFrame:
    """Fill NULL outcomes with the last price in (t, t + h], once the stream has passed t + h."""
    from tidemark.operators.asof import asof

    passed = stream.groupBy(*keys).agg(F.max(time).alias("_passed"))
    found = asof(rows, stream, keys, time, [price], "backward", "exit_", offset=horizon).join(passed, list(keys), "left")
    ok = (c("_passed") >= c(time) + horizon) & (c("exit_t") > c(time))
    return found.withColumn(column, F.coalesce(c(column), F.when(ok, c(f"exit_{price}")))).drop("_passed", f"exit_{price}", "exit_t", "exit_age")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], latest: Sequence[str], time: str) -> DataFrame:
    """Merge by key: first-logged values stay, `latest` columns take the newest value that is not null (U8)."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    at = F.struct("_s", time)
    rest = [x for x in both.columns if x not in (*keys, "_s")]
    return both.groupBy(*keys).agg(*[(F.max_by if x in latest else F.min_by)(x, F.when(c(x).isNotNull(), at)).alias(x) for x in rest])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shifted_union(df: DataFrame, run: str, time: str, gap: int) -> DataFrame:
    """Runs laid end to end: every run's times start where the one before ended, plus a gap.

    Offsets are one row a run; rows meet them in an equi-join.
    """
    spans = df.groupBy(run).agg(F.min(time).alias("_a"), (F.max(time) - F.min(time) + gap).alias("_n"))
    w = Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return df.join(spans, run).withColumn("shifted_t", c(time) - c("_a") + c("_off")).drop("_a", "_off")


def widen(df: DataFrame, index: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """Pivot with the names given, so no extra pass looks for them."""
    return df.groupBy(index).pivot(column, list(names)).agg(F.sum(value))


def expand_costs(df: DataFrame, gross: str, costs: Column) -> DataFrame:
    return df.withColumn("cost", costs).withColumn("net", c(gross) - c("cost")).withColumn("kept_share", safe_div(c("net"), c(gross)))
