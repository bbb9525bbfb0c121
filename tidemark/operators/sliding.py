"""Sliding ranges of time in one pass, at a cost per row that does not grow with the range.

Rows are dealt by (key, time block) with the rows that a block still sees of the one before it, so a busy key
spreads over tasks. A task holds the rows of the longest range and at least as many new ones: sums are
differences of running sums at the edges of a range, extremes come from a table of maxima over powers of two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pandas.api.indexers import BaseIndexer

from tidemark.operators.folds import starts as starts_of

c = F.col

FIELDS = ("n", "first", "high", "low", "sum", "known", "up", "down", "var", "slope")


def extremes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """max(x[lo:hi]) of every range; NaN is no value, a range without values gives NaN."""
    x, out = np.where(np.isnan(x), -np.inf, x), np.full(len(lo), -np.inf)
    size = hi - lo
    level = np.frexp(np.maximum(size, 1))[1] - 1
    step, k = x, 0
    while len(size) and k <= level.max(initial=0):  # step[i] = max(x[i : i + 2^k])
        at = np.flatnonzero((level == k) & (size > 0))
        out[at] = np.maximum(step[lo[at]], step[hi[at] - (1 << k)])
        k += 1
        half = 1 << (k - 1)
        if len(step) <= half:
            break
        step = np.maximum(step[:-half], step[half:])
    return np.where(np.isinf(out), np.nan, out)


def summaries(t: np.ndarray, price: np.ndarray, change: np.ndarray, a: int, b: int, ms: int) -> list[np.ndarray]:
    """FIELDS of the rows a to b over the rows of (t - ms, t], ties of t included."""
    lo, hi = np.searchsorted(t, t[a:b] - ms, "right"), np.searchsorted(t, t[a:b], "right")

    def total(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(np.nan_to_num(x).astype(np.longdouble))])
        return (run[hi] - run[lo]).astype(float)

    known, priced, seconds = ~np.isnan(change), ~np.isnan(price), (t - t[0]) / 1000.0
    n, k = total(known), total(change)
    level = np.nanmean(change) if known.any() else 0.0
    far, square = total(change - level), total((change - level) ** 2)
    with np.errstate(all="ignore"):
        rest = square - far * far / n
        var = np.where(n > 1, np.where(rest < 1e-12 * square, 0.0, rest) / (n - 1), np.nan)
        # regression of price on time, both about a value inside the range
        p, x = price - (np.nanmean(price) if priced.any() else 0.0), np.where(priced, seconds, np.nan)
        m, sx, sp, sxx, sxp = total(priced), total(x), total(p), total(x * x), total(x * p)
        flat = m * sxx - sx * sx
        slope = np.where((m > 1) & (flat > 1e-9), (m * sxp - sx * sp) / flat, np.nan)
    return [(hi - lo).astype(float), price[lo], extremes(price, lo, hi), -extremes(-price, lo, hi), np.where(n > 0, k, np.nan), n, total(change > 0), total(change < 0), var, slope]


def firsts(t: np.ndarray, price: np.ndarray, a: int, b: int, ms: int) -> list[np.ndarray]:
    """FIELDS as in summaries, but only the first price."""
    none = np.full(b - a, np.nan)
    return [price[np.searchsorted(t, t[a:b] - ms, "right")] if f == "first" else none for f in FIELDS]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return pc.cast(table[name], pa.float64()).to_numpy()


def time_ranges(df: DataFrame, keys: Sequence[str], time: str, price: str, change: str, spans: Sequence[int], tie: Sequence[str] = (), first_only: bool = False) -> DataFrame:
    """df with a struct column r<ms> for each span: FIELDS over (t - ms, t] of the same key (NULL where undefined).

    time is in whole ms. Rows without a time get NULLs and are seen by no other. Rows of one time see each other;
    `tie` orders them for the first price of a range. first_only leaves all fields but "first" NULL and saves their work.
    """
    keys, longest = list(keys), max(spans)
    width = 4 * longest
    home, last = F.floor(c(time) / width), F.floor((c(time) + longest - 1) / width)
    rows = df.withColumn("_block", F.explode_outer(F.sequence(home, last))).withColumn("_own", F.coalesce(c("_block") == home, F.lit(True)))
    group = [*keys, "_block"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group, time, *tie)
    shape = T.StructType([T.StructField(f"r{ms}", T.StructType([T.StructField(f, T.DoubleType()) for f in FIELDS])) for ms in spans])
    names = dealt.columns
    at = [names.index(k) for k in group]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, fresh, key = [], 0, 0, None

        def work(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, done, fresh
            table = pa.Table.from_batches(held)
            t = _numbers(table, time)
            end = len(t) if final or np.isnan(t[-1]) else int(np.searchsorted(t, t[-1], "left"))
            if end > done:
                own = table.slice(done, end - done)
                if np.isnan(t[done]):
                    parts = [[np.full(end - done, np.nan)] * len(FIELDS)] * len(spans)
                else:
                    p = _numbers(table, price)
                    parts = [firsts(t, p, done, end, ms) if first_only else summaries(t, p, _numbers(table, change), done, end, ms) for ms in spans]
                for part, ms in zip(parts, spans):
                    own = own.append_column(f"r{ms}", pa.StructArray.from_arrays([pa.array(v, pa.float64(), from_pandas=True) for v in part], names=list(FIELDS)))
                yield from own.filter(own["_own"]).combine_chunks().to_batches(max_chunksize=10_000)
            if final:
                held, done, fresh = [], 0, 0
            else:
                start = len(t) if np.isnan(t[-1]) else int(np.searchsorted(t, t[end] - longest, "right"))
                held, done, fresh = table.slice(start).combine_chunks().to_batches(), max(end - start, 0), len(t) - end

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = starts_of([batch.column(i) for i in at])
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                now = tuple(batch.column(i)[a].as_py() for i in at)
                if now != key and held:
                    yield from work(True)
                key = now
                held.append(batch.slice(a, b - a))
                fresh += b - a
                if fresh >= max(done, 10_000):  # as many new rows as old ones: the work per row stays the same
                    yield from work(False)
        if held:
            yield from work(True)

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, *shape.fields])).drop("_block", "_own")


class _Bounds(BaseIndexer):
    """Windows [start, end) given row by row."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, self.end


def _codes(x: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The rank of each value (NaN for NULL) and the sorted values; the value NaN sorts above all others."""
    values, code = x.drop_null(), np.full(len(x), np.nan)
    known, code[x.is_valid().to_numpy(zero_copy_only=False)] = np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)
    return code, pa.array(known, x.type)


def _pick(values: pa.Array, at: np.ndarray) -> pa.Array:
    """values at the places, NULL where a place is NaN."""
    return values.take(pa.array(at, pa.float64(), from_pandas=True).cast(pa.int64()))


def medians(code: np.ndarray, values: pa.Array, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Medians of the ranges [lo, hi), whose ends do not go back, by an indexable skip list: a row costs its logarithm."""
    rolled = pd.Series(code).rolling(_Bounds(start=lo.astype(np.int64), end=hi.astype(np.int64)), min_periods=1)
    a, b = (_pick(values, rolled.quantile(0.5, interpolation=side).to_numpy()) for side in ("lower", "higher"))
    return pc.if_else(pc.equal(a, b), a, pc.add(pc.multiply(a, 0.5), pc.multiply(b, 0.5)))


def around(df: DataFrame, keys: Sequence[str], time: str, ms: int, columns: Sequence[str], timed: str | None = None, median: str | None = None) -> DataFrame:
    """df with n_ahead and high_<x> and low_<x> of the columns over (t, t + ms] of the same key, at a cost per row that does not grow with the range.

    timed: high_at and low_at, the first times of the extremes of that column (a NULL counts as its highest value). median: the
    median of a column of doubles over [t - ms, t]. Rows without a time see each other. Rows are dealt by (key, time block) with a
    rim of one range; a task holds the rows of a block of four ranges.
    """
    width, read = 4 * ms, list(dict.fromkeys([*columns, *([timed] if timed else []), *([median] if median else [])]))
    home = F.floor(c(time) / width)
    rows = df.withColumn("_block", F.explode_outer(F.sequence(F.floor((c(time) - ms) / width), F.floor((c(time) + ms) / width) if median else home)))
    rows = rows.withColumn("_own", F.coalesce(c("_block") == home, F.lit(True)))
    kinds = {x: df.schema[x].dataType for x in read}
    fields = [T.StructField("n_ahead", T.LongType()), *(T.StructField(f"{side}_{x}", kinds[x]) for x in columns for side in ("high", "low"))]
    fields += [T.StructField(f"{side}_at", df.schema[time].dataType) for side in ("high", "low")] if timed else []
    fields += [T.StructField("median", T.DoubleType())] if median else []
    schema, kept, names = T.StructType([*df.schema.fields, *fields]), df.columns, [f.name for f in fields]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time).combine_chunks()
        clock, mine, n = table[time].combine_chunks(), np.flatnonzero(table["_own"].to_numpy()), table.num_rows
        if clock.null_count:  # a block of its own
            t, lo, hi, since, until = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, n), np.zeros(n, np.int64), np.full(n, n)
        else:
            t = clock.to_numpy()
            until = np.searchsorted(t, t, "right")
            lo, hi, since = until, np.searchsorted(t, t + ms, "right"), np.searchsorted(t, t - ms, "left")
        lo, hi, made = lo[mine], hi[mine], {}
        made["n_ahead"] = pa.array(hi - lo, pa.int64())
        ranks = {x: _codes(table[x].combine_chunks()) for x in read}
        for x in columns:
            code, values = ranks[x]
            made |= {f"high_{x}": _pick(values, extremes(code, lo, hi)), f"low_{x}": _pick(values, -extremes(-code, lo, hi))}
        if timed:
            code = np.where(np.isnan(ranks[timed][0]), n, ranks[timed][0])
            for side, sign in (("high", 1.0), ("low", -1.0)):
                order = np.lexsort((-t, sign * code))  # the last of equal values is the first in time
                place = np.empty(n)
                place[order] = np.arange(n)
                made[f"{side}_at"] = _pick(clock.take(pa.array(order)), extremes(place, lo, hi))
        if median and len(mine):  # rows of the rim get empty ranges
            a, b = (np.full(n, until[mine[-1]]) for _ in range(2))
            a[: mine[0]] = b[: mine[0]] = since[mine[0]]
            a[mine], b[mine] = since[mine], until[mine]
            made["median"] = medians(*ranks[median], a, b).take(pa.array(mine))
        elif median:
            made["median"] = pa.array([], pa.float64())
        own = table.take(pa.array(mine)).select(kept)
        return pa.table([*own.columns, *(made[x] for x in names)], names=[*kept, *names])

    return rows.groupBy(*keys, "_block").applyInArrow(run, schema)
