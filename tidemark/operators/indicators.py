"""Technical features over bars and prices (W2-W21, W33, A37). All causal; NULL until warm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import DAY
from tidemark.functions.semantics import log_bps, safe_div
from tidemark.operators.folds import scan
from tidemark.operators.series import Series

c = F.col


def ma_distance(s: Series, price: Column, n: int) -> Column:
    """1e4 ln(price / moving average)."""
    return log_bps(price, s.mean(price, n))


def range_features(s: Series, high: Column, low: Column, price: Column, n: int) -> dict[str, Column]:
    """Rolling range and distance to its ends in bps."""
    top, bottom = s.max(high, n), s.min(low, n)
    return {f"range_{n}": log_bps(top, bottom), f"to_high_{n}": log_bps(price, top), f"to_low_{n}": log_bps(price, bottom)}


def parkinson(s: Series, high: Column, low: Column, n: int) -> Column:
    """sqrt(mean(ln(h/l)^2) / (4 ln 2)), in bps."""
    x = log_bps(high, low)
    return F.sqrt(s.mean(x * x, n) / (4 * 0.6931471805599453))


def candle_anatomy(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Body, wicks and the close's place, as shares of the range (0 for a flat bar)."""
    span = high - low
    upper, lower = high - F.greatest(open_, close), F.least(open_, close) - low
    return {
        "range": span, "body": close - open_, "upper_wick": upper, "lower_wick": lower, "body_share": safe_div(F.abs(close - open_), span, 0),
        "upper_share": safe_div(upper, span, 0), "lower_share": safe_div(lower, span, 0), "wick_asymmetry": safe_div(upper - lower, span, 0), "close_position": safe_div(close - low, span, 0),
    }


def rsi_mean(s: Series, change: Column, n: int) -> Column:
    """RSI from rolling means; a flat window is 50."""
    up, down = s.mean(F.greatest(change, F.lit(0.0)), n), s.mean(F.greatest(-change, F.lit(0.0)), n)
    value = 100 - 100 / (1 + safe_div(up, down))
    return F.when(up.isNotNull(), F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(value))


def rsi_sum(s: Series, change: Column, n: int) -> Column:
    """RSI from rolling sums; without losses it is 100."""
    up, down = s.sum(F.greatest(change, F.lit(0.0)), n), s.sum(F.greatest(-change, F.lit(0.0)), n)
    return F.when(up.isNotNull(), F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + safe_div(up, down))))


def true_range(s: Series, high: Column, low: Column, close: Column) -> Column:
    before = s.lag(close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def oscillators(bars: DataFrame, s: Series, n: int) -> DataFrame:
    """Bollinger, Donchian, stochastic, Williams, CCI, MFI, OBV, VWAP distance, ROC.

    Columns open, high, low, close, volume. Two passes: CCI and MFI need row values of the first.
    """
    close, high, low, volume = c("close"), c("high"), c("low"), c("volume")
    typical = (high + low + close) / 3
    bars = bars.withColumns({"_typical": typical, "_d": s.diff(close), "_dt": typical - s.lag(typical)})
    mid, sd = s.mean(close, n), s.std(close, n)
    top, bottom = s.max(high, n), s.min(low, n)
    flow = c("_typical") * volume
    up, down = s.sum(F.when(c("_dt") > 0, flow).otherwise(0.0), n), s.sum(F.when(c("_dt") < 0, flow).otherwise(0.0), n)
    signed = F.when(c("_d") > 0, volume).when(c("_d") < 0, -volume).otherwise(0.0)
    values = F.collect_list("_typical").over(s.last_n(n))
    mean_typical = s.mean(c("_typical"), n)
    deviation = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean_typical)) / n
    return bars.withColumns({
        "bollinger_width": safe_div(4 * sd, mid, 0), "bollinger_b": safe_div(close - (mid - 2 * sd), 4 * sd, 0), "donchian": safe_div(close - bottom, top - bottom, 0),
        "stochastic": 100 * safe_div(close - bottom, top - bottom, 0), "williams": -100 * safe_div(top - close, top - bottom, 0),
        "cci": safe_div(c("_typical") - mean_typical, 0.015 * deviation, 0), "mfi": F.when(up.isNotNull(), F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + safe_div(up, down)))),
        "obv": F.sum(signed).over(s.so_far()), "vwap_distance": log_bps(close, safe_div(s.sum(flow, n), s.sum(volume, n))), "roc": log_bps(close, s.lag(close, n)),
    }).drop("_typical", "_d", "_dt")


def signed_run(df: DataFrame, s: Series, change: Column, name: str = "run") -> DataFrame:
    """Length of the current run of equal direction, negative for falls, 0 for no change."""
    sign = F.coalesce(F.signum(change), F.lit(0.0)).cast("int")
    df = df.withColumn("_sign", sign)
    df = df.withColumn("_new", (F.coalesce(s.lag(c("_sign")), F.lit(99)) != c("_sign")).cast("int"))
    df = df.withColumn("_group", F.sum("_new").over(s.so_far()))
    inner = Series((*s.keys, "_group"), s.order)
    return df.withColumn(name, c("_sign") * F.row_number().over(inner.spec)).drop("_sign", "_new", "_group")


def path_stats(df: DataFrame, s: Series, step_return: Column) -> DataFrame:
    """Cumulative sum, drawdown, run-up and compounded equity of returns in bps."""
    w = s.so_far()
    df = df.withColumn("_r", F.coalesce(step_return, F.lit(0.0)))
    df = df.withColumn("cumulative", F.sum("_r").over(w))
    growth = F.log1p(F.least(F.greatest(c("_r") / 1e4, F.lit(-0.99)), F.lit(10.0)))
    return df.withColumns({"drawdown": c("cumulative") - F.max("cumulative").over(w), "runup": c("cumulative") - F.min("cumulative").over(w), "equity": F.exp(F.sum(growth).over(w))}).drop("_r")


def ema_paths(df: DataFrame, keys: list[str], order: list[str], value: str, spans: dict[str, float | tuple[str, float]], least: int = 1, block: float = 7 * DAY) -> DataFrame:
    """Exponential means by the recursion y = a x + (1 - a) y, seeded with the first value.

    spans maps a column name to alpha, or to another value column and alpha. NULLs keep the last state.
    The recursion is a scan over blocks of (key, order[0] / block): with b the recursion seeded with the block's own
    first value z, and n its values so far, y is b + (1 - a)^n (y0 - z), where y0 is the mean before the block (z in
    the first one). Blocks are scanned apart, in constant memory; the table of blocks is scanned by key.
    """
    plan = {name: (value, x) if isinstance(x, (int, float)) else x for name, x in spans.items()}
    columns = list(dict.fromkeys(x for x, _ in plan.values()))
    rows = df.withColumns({"_block": F.floor(c(order[0]).cast("double") / block)} | {f"_x{i}": c(x).cast("double") for i, x in enumerate(columns)})
    each = [[(j, a) for j, (x, a) in enumerate(plan.values()) if x == column] for column in columns]
    field = lambda name, kind: T.StructField(name, kind)
    counts, offsets = [field(f"_n{i}", T.LongType()) for i in range(len(columns))], [field(f"_b{i}", T.DoubleType()) for i in range(len(plan))]

    def inside(state: tuple[list[int], list[float]], *xs: float | None) -> tuple:
        n, b = state
        for i, x in enumerate(xs):
            if x is not None and x == x:
                n[i] += 1
                for j, a in each[i]:
                    b[j] = x if b[j] is None else a * x + (1 - a) * b[j]
        return (*n, *b)

    xs = [f"_x{i}" for i in range(len(columns))]
    folded = scan(rows, [*keys, "_block"], order, xs, [*counts, *offsets], lambda: ([0] * len(columns), [None] * len(plan)), inside)
    usable = lambda x: c(x).isNotNull() & ~F.isnan(c(x).cast("double"))
    at = F.struct(*order)
    blocks = folded.groupBy(*keys, "_block").agg(
        *[F.max(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))], *[F.max_by(f"_b{i}", at).alias(f"_b{i}") for i in range(len(plan))],
        *[F.min_by(c(x).cast("double"), F.when(usable(x), at)).alias(f"_f{i}") for i, x in enumerate(columns)],
    )
    carried = [*(field(f"_s{i}", T.LongType()) for i in range(len(columns))), *(field(f"_y{i}", T.DoubleType()) for i in range(len(plan))), *(field(f"_z{i}", T.DoubleType()) for i in range(len(columns)))]
    place = [columns.index(x) for x, _ in plan.values()]

    def across(state: dict, *values) -> tuple:
        n, b, first = values[: len(columns)], values[len(columns) : -len(columns)], values[-len(columns) :]
        seen, y0 = tuple(state["n"]), [first[i] if y is None else y for y, i in zip(state["y"], place)]
        state["y"] = [y if v is None else v + (1 - a) ** n[i] * (y - first[i]) for y, v, i, (_, a) in zip(y0, b, place, plan.values())]
        state["n"] = [p + q for p, q in zip(seen, n)]
        return (*seen, *y0, *first)

    needed = [*(f.name for f in (*counts, *offsets)), *(f"_f{i}" for i in range(len(columns)))]
    before = scan(blocks, keys, ["_block"], needed, carried, lambda: {"n": [0] * len(columns), "y": [None] * len(plan)}, across)
    before = before.select(*[c(k).alias(f"_k_{k}") for k in [*keys, "_block"]], *[f.name for f in carried])
    on = F.lit(True)
    for k in [*keys, "_block"]:
        on = on & folded[k].eqNullSafe(before[f"_k_{k}"])
    out = folded.join(before, on)
    for i, (name, (x, alpha)) in enumerate(plan.items()):
        j = columns.index(x)
        mean = F.when(c(f"_n{j}") == 0, c(f"_y{i}")).otherwise(c(f"_b{i}") + F.pow(F.lit(1.0 - alpha), c(f"_n{j}")) * (c(f"_y{i}") - c(f"_z{j}")))
        out = out.withColumn(name, F.when(c(f"_n{j}") + c(f"_s{j}") >= max(1, least), mean))
    return out.select(*df.columns, *plan)


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def macd(df: DataFrame, keys: list[str], order: list[str], value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal and histogram."""
    df = ema_paths(df, keys, order, value, {"ema_fast": span_alpha(fast), "ema_slow": span_alpha(slow)})
    df = df.withColumn("macd", c("ema_fast") - c("ema_slow"))
    return ema_paths(df, keys, order, "macd", {"macd_signal": span_alpha(signal)}).withColumn("macd_hist", c("macd") - c("macd_signal"))


def sma_seeded_ema(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str) -> DataFrame:
    """EMA that starts with the mean of the first n values."""
    s = Series(tuple(keys), tuple(order))
    df = df.withColumn("_i", F.row_number().over(s.spec)).withColumn("_m", F.avg(value).over(s.last_n(n)))
    df = df.withColumn("_x", F.when(c("_i") == n, c("_m")).when(c("_i") > n, c(value)))
    return ema_paths(df, keys, order, "_x", {name: span_alpha(n)}).drop("_i", "_m", "_x")


def wilder_rsi(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str = "rsi_wilder") -> DataFrame:
    """RSI on Wilder's means (alpha 1/n); flat is 50, without losses 100."""
    s = Series(tuple(keys), tuple(order))
    d = s.diff(c(value))
    df = df.withColumns({"_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))})
    df = df.withColumns({"_up": F.when(s.lag(c(value)).isNotNull(), c("_up")), "_down": F.when(s.lag(c(value)).isNotNull(), c("_down"))})
    df = ema_paths(df, keys, order, "_up", {"_eu": ("_up", 1.0 / n), "_ed": ("_down", 1.0 / n)}, n)
    rsi = F.when(c("_eu").isNotNull(), F.when((c("_eu") == 0) & (c("_ed") == 0), 50.0).when(c("_ed") == 0, 100.0).otherwise(100 - 100 / (1 + safe_div(c("_eu"), c("_ed")))))
    return df.withColumn(name, rsi).drop("_up", "_down", "_eu", "_ed")


def trend_regime(score: Column, volatility_rank: Column, limit: float = 1.0) -> Column:
    """high_vol_chop first, then the sign of a trend score beyond +-limit."""
    return F.when((volatility_rank >= 0.8) & (F.abs(score) < limit), "high_vol_chop").when(score >= limit, "bull").when(score <= -limit, "bear").otherwise("neutral")
