"""Time buckets, bars, roll-ups, spines and flow aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import floor_to
from tidemark.functions.semantics import log_bps, safe_div


def ohlcv(ticks: DataFrame, keys: Sequence[str], ms: int, time: str, price: str, size: str, seq: str) -> DataFrame:
    """Open, high, low, close, volume, trades per key and bucket; ties on time go by seq (A2, A3)."""
    at = F.struct(time, seq)
    return ticks.groupBy(*keys, floor_to(F.col(time), ms).alias("bucket")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(size).alias("volume"), F.count("*").alias("trades"), F.min(time).alias("first_t"), F.max(time).alias("last_t"),
    )


def last_per_bucket(ticks: DataFrame, keys: Sequence[str], ms: int, time: str, columns: Sequence[str], seq: str) -> DataFrame:
    """The last row of each bucket (A1)."""
    at = F.struct(time, seq)
    picked = ticks.groupBy(*keys, floor_to(F.col(time), ms).alias("bucket")).agg(F.max_by(F.struct(*columns), at).alias("_r"))
    return picked.select(*keys, "bucket", "_r.*")


def spine(buckets: DataFrame, keys: Sequence[str], ms: int, bucket: str = "bucket") -> DataFrame:
    """Every bucket from the first to the last of each key."""
    span = buckets.groupBy(*keys).agg(F.min(bucket).alias("_a"), F.max(bucket).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(ms).cast("long"))).alias(bucket))


def gap_filled(buckets: DataFrame, keys: Sequence[str], ms: int, price: str = "price", bucket: str = "bucket") -> DataFrame:
    """Dense buckets with forward-filled price, a presence flag, and log-bps returns (0 where unknown)."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    dense = spine(buckets, keys, ms, bucket).join(buckets.withColumn("_have", F.lit(1)), [*keys, bucket], "left")
    dense = dense.withColumn(price, F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ret = F.coalesce(log_bps(F.col(price), F.lag(price).over(w)), F.lit(0.0))
    return dense.withColumn("return_bps", ret).withColumn("observed", F.coalesce("_have", F.lit(0))).drop("_have")


def roll_up(bars: DataFrame, keys: Sequence[str], ms: int, to_ms: int, bucket: str = "bucket", contiguous: bool = False) -> DataFrame:
    """Larger bars of complete buckets only: as many source rows as fit, or exactly the expected times."""
    n = to_ms // ms
    up = floor_to(F.col(bucket), to_ms)
    out = bars.groupBy(*keys, up.alias("up")).agg(
        F.min_by("open", bucket).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", bucket).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n"), F.countDistinct(bucket).alias("_d"), F.min(bucket).alias("_a"), F.max(bucket).alias("_b"),
    )
    whole = F.col("n") == n
    if contiguous:
        whole = whole & (F.col("_d") == n) & (F.col("_a") == F.col("up")) & (F.col("_b") == F.col("up") + (to_ms - ms))
    return out.filter(whole).withColumn("close_t", F.col("up") + to_ms).drop("_d", "_a", "_b")


def trade_flow(trades: DataFrame, keys: Sequence[str], ms: int, time: str, price: str, size: str, is_buy: Column, seq: str) -> DataFrame:
    """Per-bucket flow: counts, signed volumes, imbalance, VWAP, range, sizes, realised volatility."""
    w = Window.partitionBy(*keys, "bucket").orderBy(time, seq)
    t = trades.withColumn("bucket", floor_to(F.col(time), ms)).withColumn("_buy", is_buy).withColumn("_q", F.col(price) * F.col(size))
    t = t.withColumn("_r", log_bps(F.col(price), F.lag(price).over(w)))
    buy, sell = F.sum(F.when(F.col("_buy"), F.col(size)).otherwise(0.0)), F.sum(F.when(~F.col("_buy"), F.col(size)).otherwise(0.0))
    out = t.groupBy(*keys, "bucket").agg(
        F.count("*").alias("trades"), F.count_if("_buy").alias("buys"), buy.alias("buy_volume"), sell.alias("sell_volume"),
        F.sum(F.when(F.col("_buy"), F.col("_q")).otherwise(0.0)).alias("buy_quote"), F.sum(F.when(~F.col("_buy"), F.col("_q")).otherwise(0.0)).alias("sell_quote"),
        F.sum("_q").alias("quote"), F.max(price).alias("high"), F.min(price).alias("low"), F.avg(size).alias("mean_size"), F.percentile(size, 0.5).alias("median_size"), F.max(size).alias("max_size"),
        F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("realized_bps"),
    )
    volume = F.col("buy_volume") + F.col("sell_volume")
    return out.withColumns({
        "signed_volume": F.col("buy_volume") - F.col("sell_volume"), "imbalance": safe_div(F.col("buy_volume") - F.col("sell_volume"), volume, zero=0),
        "vwap": safe_div(F.col("quote"), volume), "range_bps": log_bps(F.col("high"), F.col("low")),
    })


def large_trades(trades: DataFrame, keys: Sequence[str], ms: int, time: str, quote: Column, n: int, q: float = 0.95, least: int = 2) -> DataFrame:
    """Trades above the rolling quantile of earlier buckets' largest trade."""
    t = trades.withColumn("bucket", floor_to(F.col(time), ms)).withColumn("_q", quote)
    top = t.groupBy(*keys, "bucket").agg(F.max("_q").alias("_top"))
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(-n, -1)
    limit = top.withColumn("threshold", F.when(F.count("_top").over(w) >= least, F.percentile("_top", q).over(w))).drop("_top")
    over = F.coalesce(F.col("_q") >= F.col("threshold"), F.lit(False))
    return t.join(limit, [*keys, "bucket"]).groupBy(*keys, "bucket").agg(F.max("threshold").alias("threshold"), F.count_if(over).alias("large_trades"), F.sum(F.when(over, F.col("_q")).otherwise(0.0)).alias("large_quote"))


def metric_summary(rows: DataFrame, keys: Sequence[str], ms: int, time: str, metrics: Sequence[str], seq: str) -> DataFrame:
    """mean, min, max, last and last - first of each metric per bucket."""
    at = F.struct(time, seq)
    cols = []
    for m in metrics:
        cols += [F.avg(m).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.max_by(m, at).alias(f"{m}_last"), (F.max_by(m, at) - F.min_by(m, at)).alias(f"{m}_change")]
    return rows.groupBy(*keys, floor_to(F.col(time), ms).alias("bucket")).agg(*cols)
