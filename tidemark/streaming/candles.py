"""Streaming buckets, candles, ledgers and labels."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import DAY
from tidemark.operators.joins import unseen
from tidemark.sources.sinks import holds_table, table_or_none

c = F.col
#: The day of ledger rows without a time.
NO_DAY = -(1 << 30)


def trade_buckets(trades: DataFrame, time: str = "ts", width: str = "1 minute", late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, quote, buy and sell volume per event-time bucket; state older than `late` is dropped."""
    w = F.window(time, width)
    return trades.withWatermark(time, late).groupBy(w, *keys).agg(
        F.count("*").alias("trades"), F.sum(c("price") * c("size")).alias("quote"), F.sum(F.when(c("side") == "buy", c("size")).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(c("side") == "sell", c("size")).otherwise(0.0)).alias("sell_volume"),
    ).select(c("window.start").alias("start"), *keys, "trades", "quote", "buy_volume", "sell_volume")


def candles(trades: DataFrame, time: str = "ts", seq: str = "trade_id", width: str = "1 minute", late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """OHLCV in append mode: a candle leaves once, after the watermark has passed it; later trades for it
    are dropped and counted by Spark (T3, T4)."""
    at = F.struct(time, seq)
    return trades.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trades"),
    ).select(c("window.start").alias("start"), *keys, "open", "high", "low", "close", "volume", "trades")


def sliding(trades: DataFrame, time: str, width: str, slide: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hopping windows."""
    return trades.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"), F.avg("price").alias("mean")).select(c("window.start").alias("start"), *keys, "n", "mean")


def sessions(trades: DataFrame, time: str, gap: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    """Gap sessions per key."""
    return trades.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(c("session_window.start").alias("start"), c("session_window.end").alias("end"), *keys, "n")


def ledger(rows: DataFrame, time: str, identity: list[str], late: str) -> DataFrame:
    """Each identity once, with state bounded by the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


def matured(decisions: DataFrame, prices: DataFrame, key: str, horizon: str, late: str) -> DataFrame:
    """Decisions joined with the prices of (t, t + horizon]: emitted as both watermarks pass."""
    d = decisions.withWatermark("decision_ts", late).alias("d")
    p = prices.withWatermark("price_ts", late).alias("p")
    on = (c(f"d.{key}") == c(f"p.{key}")) & (c("p.price_ts") > c("d.decision_ts")) & (c("p.price_ts") <= c("d.decision_ts") + F.expr(f"INTERVAL {horizon}"))
    return d.join(p, on).select(c(f"d.{key}"), "decision_ts", "price_ts", c("p.price").alias("price"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process all that is there and stop: the replay form of a forward run."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def predict_each(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, identity: list[str], time: str | None = None):
    """Micro-batch predictions: each batch is scored, rows already in the ledger are left out, the rest added.

    A batch is a partition of the ledger named by its checkpoint and number. A batch that runs again after its
    write (the driver died before it was marked as done) overwrites its own partition and looks for known rows in
    the others only, so it leaves one copy. NULL identities are equal to each other. With `time`, a column of the
    identity in ms, the ledger is kept by day too, and a batch reads only the days that it holds itself.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, n: int) -> None:
        if time is None:
            add_batch(predict(batch), path, f"{writer}-{n}", identity)
        else:
            add_dated_batch(predict(batch), path, f"{writer}-{n}", identity, time)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def add_batch(rows: DataFrame, path: str, batch: str, identity: list[str]) -> None:
    """Write the rows whose identity no other batch of the ledger holds, once each, as the partition `batch`."""
    rows = rows.dropDuplicates(identity)
    held = table_or_none(rows.sparkSession, path)
    if held is not None:
        rows = unseen(rows, held.filter(c("batch") != batch), identity)
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def add_dated_batch(rows: DataFrame, path: str, batch: str, identity: list[str], time: str) -> None:
    """As add_batch, in a ledger partitioned by batch and day of `time`.

    Rows of one identity have one time, so a known row can only lie in a day between the batch's first and last, or,
    for rows without a time, in a day of its own: those partitions alone are read, and no file's footer to learn the columns.
    """
    if time not in identity:
        raise ValueError(f"{time} is no part of the identity {identity}")
    spark, columns = rows.sparkSession, rows.columns
    day = c("day") != NO_DAY
    dated = rows.dropDuplicates(identity).withColumn("day", F.coalesce(F.floor(c(time) / DAY).cast("int"), F.lit(NO_DAY))).persist()
    try:
        low, high, void = dated.agg(F.min(F.when(day, c("day"))), F.max(F.when(day, c("day"))), F.bool_or(~day)).first()
        new = dated
        if holds_table(spark, path):
            shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), T.StructField("batch", T.StringType()), T.StructField("day", T.IntegerType())])
            new = unseen(dated, held_days(spark.read.schema(shape).parquet(path), batch, low, high, bool(void)), identity)
        new.select(*columns, "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")
    finally:
        dated.unpersist()


def held_days(held: DataFrame, batch: str, low: int | None, high: int | None, void: bool) -> DataFrame:
    """The ledger's partitions of other batches that can hold rows of a batch of days low to high."""
    near = c("day").between(low, high) if low is not None else F.lit(False)
    return held.filter((c("batch") != batch) & (near | (c("day") == NO_DAY) if void else near))


def staleness(rows: DataFrame, keys: list[str], time: str, now: int, limit: int) -> DataFrame:
    """Age of the newest row per key and whether it is stale."""
    return rows.groupBy(*keys).agg((F.lit(now) - F.max(time)).alias("age_ms")).withColumn("stale", c("age_ms") > limit)
