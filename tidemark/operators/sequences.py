"""Sequence tensors as array columns."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import Series


def _strided(values: Column, length: int, stride: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.element_at(values, ((k - 1) * stride + 1).cast("int")))


def input_sequence(s: Series, x: Column, length: int, stride: int = 1) -> Column:
    """[x(i - (length-1) stride), ..., x(i)]; NULL unless all are there."""
    span = (length - 1) * stride + 1
    values = F.collect_list(F.struct(x.alias("v"))).over(s.last_n(span))
    picked = F.transform(_strided(values, length, stride), lambda v: v["v"])
    return F.when((F.size(values) == span) & (F.count(x).over(s.last_n(span)) == span), picked)


def output_sequence(s: Series, x: Column, length: int, stride: int = 1) -> Column:
    """[x(i + stride), ..., x(i + length stride)]; NULL unless all are there."""
    span = length * stride
    values = F.collect_list(F.struct(x.alias("v"))).over(s.next_n(span))
    picked = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.element_at(values, (k * stride).cast("int"))["v"])
    return F.when((F.size(values) == span) & (F.count(x).over(s.next_n(span)) == span), picked)


def lookback_window(s: Series, x: Column, length: int) -> Column:
    """[x(i - length), ..., x(i - 1)], without the current row."""
    w = s.before(length)
    return F.when(F.count(x).over(w) == length, F.collect_list(x).over(w))


def signed_clipped(values: Column, sign: Column, limit: float) -> Column:
    return F.transform(values, lambda v: F.least(F.greatest(v * sign, F.lit(-limit)), F.lit(limit)))


def wide(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """x_lag_000, ... columns from an array."""
    return df.withColumns({n: F.element_at(column, k + 1) for k, n in enumerate(names)})


def _rising(values) -> list[float] | None:
    if values is None or any(v is None or v != v for v in values):
        return None
    stack: list[list[float]] = []
    for v in values:
        stack.append([float(v), 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] > stack[-1][0] * stack[-2][1]:
            total, n = stack.pop()
            stack[-1][0], stack[-1][1] = stack[-1][0] + total, stack[-1][1] + n
    return [total / n for total, n in stack for _ in range(n)]


def isotonic(x: Column) -> Column:
    """The nearest rising sequence in least squares, by pooling neighbours on a stack: linear in the length. An array with a NULL gives NULL."""

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        return values.map(_rising)

    return project(x)


def interp(at: Column, xs: Column, ys: Column) -> Column:
    """Values of the line through the points (xs ascending, ys) at each of `at`; outside them the nearest end's value. NULL where there are no points."""
    n = F.size(xs)

    def value(p: Column) -> Column:
        i = F.size(F.filter(xs, lambda x: x <= p))  # points at or before p
        x0, y0 = F.try_element_at(xs, i), F.try_element_at(ys, i)
        x1, y1 = F.try_element_at(xs, i + 1), F.try_element_at(ys, i + 1)
        return F.when(i == 0, F.try_element_at(ys, F.lit(1))).when(i == n, F.try_element_at(ys, n)).otherwise(y0 + (y1 - y0) * (p - x0) / (x1 - x0))

    return F.when(n > 0, F.transform(at, value))


def band(x: Column, n: int, low: int, high: int) -> tuple[Column, Column]:
    """Energy of the frequencies low to high (below n / 2) of a sequence of n values, and its part made of them alone."""
    import math

    def turn(k: int, f) -> Column:
        return F.aggregate(F.transform(x, lambda v, i: v * f(i * F.lit(2 * math.pi * k / n))), F.lit(0.0), lambda s, v: s + v)

    parts = [(k, turn(k, F.cos), turn(k, F.sin)) for k in range(low, high + 1)]
    energy = sum((a * a + b * b for _, a, b in parts), F.lit(0.0))
    wave = lambda t: sum((a * F.cos(t * F.lit(2 * math.pi * k / n)) + b * F.sin(t * F.lit(2 * math.pi * k / n)) for k, a, b in parts), F.lit(0.0)) * (2.0 / n)
    return energy, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), wave)
