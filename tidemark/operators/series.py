"""Keyed, ordered series and the window frames every rolling operator uses.

A Series names the partition columns (symbol, venue, run) and the order columns (time, then a tie-break).
All frames of one Series share one exchange and one sort, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.semantics import log_bps, safe_div


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last_n(self, n: int) -> WindowSpec:
        """The current row and n - 1 before it."""
        return self.spec.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.spec.rowsBetween(-n, -1)

    def next_n(self, n: int) -> WindowSpec:
        """The n rows after the current one (looks ahead: labels only)."""
        return self.spec.rowsBetween(1, n)

    def so_far(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    def rest(self) -> WindowSpec:
        return self.spec.rowsBetween(0, Window.unboundedFollowing)

    def all(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def past_ms(self, ms: int, closed: bool = False) -> WindowSpec:
        """(t - ms, t], or [t - ms, t] if closed; the first order column is the time in ms."""
        return Window.partitionBy(*self.keys).orderBy(self.order[0]).rangeBetween(-ms if closed else -ms + 1, 0)

    def previous_ms(self, ms: int) -> WindowSpec:
        """(t - 2 ms, t - ms]."""
        return Window.partitionBy(*self.keys).orderBy(self.order[0]).rangeBetween(-2 * ms + 1, -ms)

    def future_ms(self, ms: int) -> WindowSpec:
        """(t, t + ms]."""
        return Window.partitionBy(*self.keys).orderBy(self.order[0]).rangeBetween(1, ms)

    # -- full-window rolling aggregates: NULL until n non-null values are there (S6) --

    def rolling(self, agg: Column, x: Column, n: int, least: int | None = None) -> Column:
        w = self.last_n(n)
        return F.when(F.count(x).over(w) >= (least or n), agg.over(w))

    def mean(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.rolling(F.avg(x), x, n, least)

    def sum(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.rolling(F.sum(x), x, n, least)

    def max(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.rolling(F.max(x), x, n, least)

    def min(self, x: Column, n: int, least: int | None = None) -> Column:
        return self.rolling(F.min(x), x, n, least)

    def std(self, x: Column, n: int, ddof: int = 0, least: int | None = None) -> Column:
        return self.rolling(F.stddev_samp(x) if ddof else F.stddev_pop(x), x, n, least)

    def quantile(self, x: Column, n: int, q: float, least: int | None = None) -> Column:
        """Exact, linear interpolation; O(n) memory a row."""
        return self.rolling(F.percentile(x, q), x, n, least)

    def slope(self, y: Column, x: Column, n: int) -> Column:
        return self.rolling(F.regr_slope(y, x), y, n)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(self.spec)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(x, n).over(self.spec)

    def diff(self, x: Column, n: int = 1) -> Column:
        return x - self.lag(x, n)

    def returns(self, x: Column, n: int = 1) -> Column:
        return log_bps(x, self.lag(x, n))

    def zscore(self, x: Column, n: int) -> Column:
        """0 where the window is constant."""
        return safe_div(x - self.mean(x, n), self.std(x, n), zero=0)

    def shifted_zscore(self, x: Column, n: int) -> Column:
        """Against the n rows before the current one."""
        w = self.before(n)
        return F.when(F.count(x).over(w) == n, safe_div(x - F.avg(x).over(w), F.stddev_pop(x).over(w), zero=0))

    def percent_rank(self, x: Column, n: int, least: int) -> Column:
        """Average-tie rank of the current value inside the last n rows, over the count."""
        values = F.collect_list(x).over(self.last_n(n))
        below = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
        return F.when(x.isNotNull() & (F.size(values) >= least), (below + 0.5) / F.size(values))

    def forward_fill(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.so_far())

    def backfill(self, x: Column) -> Column:
        """Looks ahead: diagnostics only."""
        return F.first(x, ignorenulls=True).over(self.rest())
