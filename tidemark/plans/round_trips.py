"""Readers, sinks and streams as queries: what is written to the shared folder and read again (SRC2-SRC5, SNK*, V9, T2-T11)."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from tidemark.functions.calendar import HOUR
from tidemark.operators import splits as V
from tidemark.plans.bars import BARS, hourly
from tidemark.plans.labelling import placed
from tidemark.plans.registry import EV, events, query, table
from tidemark.plans.streams import messages, trades
from tidemark.sources import files as S
from tidemark.sources import sinks as K
from tidemark.sources import tapes as X
from tidemark.sources import tensors as N
from tidemark.streaming import book as B
from tidemark.streaming import candles as C

c = F.col
#: The middle of the events' time range: what comes first and what comes later.
MIDDLE = "(SELECT (min(t) + max(t)) // 2 FROM ev)"


def middle(e):
    low, high = e.agg(F.min("t"), F.max("t")).first()
    return (low + high) // 2 if low is not None else 0


@query("SRC2_zipped_klines", f"WITH {BARS} SELECT event_type || '-1h-2024-01.zip' AS source_file, bucket AS open_time, open, high, low, close, volume FROM bars", l="open_time", d="open high low close volume", s="source_file")
def _(spark, d):
    lines = hourly(spark, d).withColumn("day", F.floor(c("bucket") / (24 * HOUR)))
    line = F.concat_ws(",", "bucket", "open", "high", "low", "close", "volume", c("bucket") + HOUR - 1, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"))
    members = lines.groupBy("event_type", "day").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))  # at most 24 lines

    path = K.scratch_path(spark, "archives")

    def pack(batches):
        for pdf in batches:
            for kind, day, text in zip(pdf["event_type"], pdf["day"], pdf["text"]):
                fs, at = X.file_system(f"{path}/{day}/{kind}-1h-2024-01.zip")
                fs.create_dir(at.rsplit("/", 1)[0])
                with fs.open_output_stream(at) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    lines = text.split("\n")
                    for i, some in enumerate((lines[:12], lines[12:])):  # two members, the second one perhaps empty
                        z.writestr(f"{i}.csv", "".join(x + "\n" for x in some))
                    z.writestr("notes.txt", "no candles")
            yield pdf[["day"]]

    members.mapInPandas(pack, "day long").write.format("noop").mode("overwrite").save()
    return X.read_zipped_klines(spark, path)


@query("SRC7b_sorted_range", f"WITH {EV}, r AS (SELECT min(t) + (max(t) - min(t)) // 2 AS low, min(t) + (max(t) - min(t)) * 3 // 5 AS high FROM ev) SELECT event_id, t AS timestamp_ms, value AS price, k AS size, event_type AS side FROM ev, r WHERE t >= low AND t < high", l="event_id timestamp_ms size", d="price", s="side")
def _(spark, d):
    """A tenth of the time range of sorted tapes: only the bytes around it are read."""
    path, e = K.scratch_path(spark, "tape"), events(spark, d)
    first, last = e.agg(F.min("t"), F.max("t")).first()
    low, high = first + (last - first) // 2, first + (last - first) * 3 // 5
    tape = e.select("event_id", c("t").alias("timestamp_ms"), c("value").alias("price"), c("k").alias("size"), c("event_type").alias("side"))
    tape.repartitionByRange(4, "timestamp_ms").sortWithinPartitions("timestamp_ms").write.option("header", True).csv(path)
    return X.read_tape(spark, path, low, high, split_bytes=1 << 16).withColumn("t", c("timestamp_ms").cast("long")).filter((c("t") >= low) & (c("t") < high))


@query("SRC3_row_budget", f"WITH {EV}, f AS (SELECT *, event_type || '-1m-2024-01.csv' AS source_file FROM ev), o AS (SELECT *, row_number() OVER (ORDER BY source_file, t, event_id) AS i, count(*) OVER () AS n FROM f) SELECT event_id, source_file, event_type AS symbol, '2024-01' AS year_month FROM o WHERE i <= n // 2", l="event_id", s="source_file symbol year_month")
def _(spark, d):
    e = events(spark, d)
    rows = S.with_lineage(e, F.concat(F.lit("data/"), c("event_type"), F.lit("-1m-2024-01.csv")))
    return S.within_budget(rows, "source_file", ["t", "event_id"], e.count() // 2)


SUFFIX = "CASE p_partkey % 3 WHEN 0 THEN '-1m-2024-02.zip' WHEN 1 THEN '-1m-2024-02.csv' ELSE '-2024-02_flow.csv' END"


@query("SRC4_file_choice", f"WITH f AS (SELECT 'P' || p_partkey // 2 AS symbol, 'P' || p_partkey // 2 || {SUFFIX} AS source_file, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kind FROM part) SELECT symbol, source_file, '2024-02' AS year_month FROM f QUALIFY kind = min(kind) OVER (PARTITION BY symbol)", s="symbol source_file year_month")
def _(spark, d):
    k = c("p_partkey")
    suffix = F.when(k % 3 == 0, "-1m-2024-02.zip").when(k % 3 == 1, "-1m-2024-02.csv").otherwise("-2024-02_flow.csv")
    return S.choose_files(table(spark, d, "part").select(F.concat(F.lit("x/P"), F.floor(k / 2).cast("string"), suffix).alias("path")))


@query("SRC5_trade_source_kind", f"WITH {EV}, p AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'a/aggTrades/' WHEN 1 THEN 'a/agg-trades_' WHEN 2 THEN 'a/Book_Ticker/' WHEN 3 THEN 'a/trades/' ELSE 'a/other/' END || event_id AS path FROM ev) SELECT event_id, CASE WHEN contains(replace(replace(lower(path), '-', ''), '_', ''), 'aggtrades') THEN 'aggtrades' WHEN contains(replace(replace(lower(path), '-', ''), '_', ''), 'bookticker') THEN 'bookticker' WHEN contains(lower(path), 'trades') THEN 'trades' ELSE 'unknown' END AS kind FROM p", l="event_id", s="kind")
def _(spark, d):
    k = c("k") % 5
    folder = F.when(k == 0, "a/aggTrades/").when(k == 1, "a/agg-trades_").when(k == 2, "a/Book_Ticker/").when(k == 3, "a/trades/").otherwise("a/other/")
    return events(spark, d).withColumn("kind", S.trade_source_kind(F.concat(folder, c("event_id").cast("string"))))


@query("SNK1_overwritten_table", f"WITH {EV} SELECT event_id, user_id, value, event_type FROM ev WHERE k >= 50", l="event_id user_id", d="value", s="event_type")
def _(spark, d):
    path, e = K.scratch_path(spark, "table"), events(spark, d)
    for rows in (e, e.filter("k >= 50")):  # the second write replaces the first as a whole
        K.write_table(rows, path, ["event_type"], ["t"])
    return spark.read.parquet(path)


@query("SNK2_json_report", f"WITH {EV} SELECT event_type, count(*) AS n, sum(k) AS total FROM ev GROUP BY event_type", l="n total", s="event_type")
def _(spark, d):
    path = K.scratch_path(spark, "report")
    K.write_json(events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total")), path)
    return spark.read.schema("event_type string, n long, total long").json(path)


SNK3 = f"""WITH {EV}, e AS (SELECT event_id, CASE WHEN k % 10 = 3 THEN NULL ELSE user_id % 20 END AS key, CASE WHEN k % 40 = 7 THEN NULL ELSE t // {HOUR} * {HOUR} END AS slot, k, t FROM ev),
a AS (SELECT *, NULL AS late, max(slot) OVER w AS before FROM e WHERE t < {MIDDLE} WINDOW w AS (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT * FROM a WHERE slot IS NOT NULL AND coalesce(slot > before, TRUE)), l AS (SELECT key, max(slot) AS last FROM x GROUP BY key),
b AS (SELECT e.*, 2 * k AS late, greatest(max(slot) OVER w, last) AS before FROM e LEFT JOIN l ON e.key IS NOT DISTINCT FROM l.key WINDOW w AS (PARTITION BY e.key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT * FROM b WHERE slot IS NOT NULL AND coalesce(slot > before, TRUE)), n AS (SELECT (SELECT count(*) FROM a) - (SELECT count(*) FROM x) + (SELECT count(*) FROM b) - (SELECT count(*) FROM y) AS refused)
SELECT event_id, key, slot, late, refused FROM (SELECT event_id, key, slot, late FROM x UNION ALL SELECT event_id, key, slot, late FROM y), n"""


@query("SNK3_appended_rows", SNK3, l="event_id key slot late refused")
def _(spark, d):
    """Rows of the first half, then all rows again with a new column: only newer ones are added, in the order of events.

    Times are whole hours, so many rows of a key share one; some keys and times are NULL.
    """
    path, e = K.scratch_path(spark, "append"), events(spark, d)
    half = c("t") < middle(e)
    e = e.select("event_id", F.when(c("k") % 10 != 3, c("user_id") % 20).alias("key"), F.when(c("k") % 40 != 7, F.floor(c("t") / HOUR) * HOUR).alias("slot"), "k", half.alias("half"))
    refused = K.append_rows(e.filter("half").select("event_id", "key", "slot"), path, ["key"], "slot", ["event_id"])
    refused += K.append_rows(e.select("event_id", "key", "slot", (2 * c("k")).alias("late")), path, ["key"], "slot", ["event_id"])
    return spark.read.option("mergeSchema", True).parquet(path).withColumn("refused", F.lit(refused))


@query("SNK4_checked_append", f"WITH {EV} SELECT event_id, value, 1 AS refused FROM ev", l="event_id refused", d="value")
def _(spark, d):
    path, e = K.scratch_path(spark, "checked"), events(spark, d).select("event_id", "value")
    K.write_table(e.filter("event_id % 2 = 0"), path)
    refused = 0
    try:
        K.append_checked(e.withColumn("value", c("value").cast("string")), path)
    except ValueError:
        refused = 1
    K.append_checked(e.filter("event_id % 2 = 1").select("value", "event_id"), path)
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query("SNK5_tensor_table", "SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings", l="vec_id n", d="total", digits=4)
def _(spark, d):
    path = K.scratch_path(spark, "tensors")
    K.write_table(table(spark, d, "embeddings").select("vec_id", "embedding"), path, sort_by=["vec_id"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("n"), total.alias("total"))


WEEK = N.Contract(tuple(f"f{i}" for i in range(8)), tuple(f"low_h{h}" for h in (1, 2, 3, 5)), 8, "path")


@query("SRC15b_tensor_faults", "WITH m AS (SELECT vec_id % 11 = 3 AS short, vec_id % 13 = 5 AS hole, vec_id % 17 = 2 AS narrow, vec_id % 19 = 4 AS few FROM embeddings) SELECT count(*) AS n, count(*) FILTER (short) AS wrong_steps, count(*) FILTER (narrow) AS wrong_width, count(*) FILTER (few) AS wrong_targets, count(*) FILTER (hole) AS missing, count(*) FILTER (short OR narrow OR few OR hole) AS faulty, 8 AS steps FROM m", l="n wrong_steps wrong_width wrong_targets missing faulty steps")
def _(spark, d):
    """Embeddings as 8 steps of 8 values and 4 targets, some cut, narrowed or with holes, written and read with a contract."""
    path, v = K.scratch_path(spark, "sequences"), c("vec_id")
    e = table(spark, d, "embeddings").withColumn("e", c("embedding").cast("array<double>"))
    step = lambda i: F.slice("e", 8 * i + 1, F.when((v % 17 == 2) & (i == 0), 7).otherwise(8))
    x = F.transform(F.sequence(F.lit(0), F.when(v % 11 == 3, 6).otherwise(7)), step)
    y = F.transform(F.slice("e", 1, F.when(v % 19 == 4, 3).otherwise(4)), lambda z, i: F.when((i == 1) & (v % 13 == 5), F.when(v % 2 == 0, float("nan"))).otherwise(z))
    N.write_tensors(e.select("vec_id", x.alias("x"), y.alias("y")), path, WEEK, ["vec_id"])
    df, held = N.read_tensors(spark, path, WEEK)
    return N.tensor_faults(df, held).withColumn("steps", F.lit(held.steps))


@query("V9_split_files", f"WITH {EV}, p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM ev) SELECT CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'holdout' END AS split, count(*) AS rows_in, min(event_id) AS first_id, max(event_id) AS last_id, sum(value) AS total FROM p GROUP BY ALL", l="rows_in first_id last_id", d="total", s="split", digits=3)
def _(spark, d):
    path, (e, n) = K.scratch_path(spark, "splits"), placed(spark, d)
    K.write_table(e.withColumn("split", V.chronological(c("i"), F.lit(n))), path, ["split"], ["t"])
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows_in"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum("value").alias("total"))


def in_two_runs(spark, d, rows, start, late_first=True):
    """Write the later half of rows, run the stream to its end, add the earlier half, and run it again."""
    source, out, checkpoint = (K.scratch_path(spark, x) for x in ("in", "out", "ck"))
    half = middle(rows)
    parts = [rows.filter(c("t") >= half), rows.filter(c("t") < half)]
    for part in parts if late_first else parts[::-1]:
        part.write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.schema).parquet(source), out, checkpoint)
    return spark.read.parquet(out)


CLOSED = f"t >= {MIDDLE} AND t // {HOUR} * {HOUR} + {HOUR} <= (SELECT max(t) - 60000 FROM ev)"


@query("T2_stream_buckets", f"WITH {EV} SELECT t // {HOUR} * {HOUR} AS start_ms, count(*) AS trades, sum(value * k) AS quote FROM ev WHERE {CLOSED} GROUP BY ALL", l="start_ms trades", d="quote")
def _(spark, d):
    """Buckets leave once the watermark has passed them; the second run's rows are all too late."""
    start = lambda s, out, ck: C.run_available(C.trade_buckets(s, width="1 hour", late="1 minute"), out, ck)
    return in_two_runs(spark, d, trades(spark, d), start).withColumn("start_ms", F.unix_millis("start"))


@query("T4_late_data", f"WITH {EV} SELECT t // {HOUR} * {HOUR} AS start_ms, count(*) AS trades, max(value) AS high, min(value) AS low FROM ev WHERE {CLOSED} GROUP BY ALL", l="start_ms trades", d="high low")
def _(spark, d):
    """Candles of a stream whose second half is late: a candle that has left is never made again."""
    start = lambda s, out, ck: C.run_available(C.candles(s, width="1 hour", late="1 minute"), out, ck)
    return in_two_runs(spark, d, trades(spark, d), start).withColumn("start_ms", F.unix_millis("start"))


@query("T8_stream_predictions", f"WITH {EV} SELECT CASE WHEN event_id % 50 = 9 THEN NULL ELSE event_id END AS ident, avg(CASE WHEN event_id % 50 = 9 THEN 1.0 ELSE value * 2 END) AS score, 1 AS copies FROM ev GROUP BY ident", l="ident copies", d="score")
def _(spark, d):
    """Every row is scored once over the runs, also where the second run sees it again; NULL is one identity."""
    e = events(spark, d).select("event_id", "t", "value")
    unknown = c("event_id") % 50 == 9
    predict = lambda b: b.select(F.when(~unknown, c("event_id")).alias("ident"), F.when(unknown, 1.0).otherwise(c("value") * 2).alias("score"))
    again = e.unionByName(e.filter(c("t") >= middle(e)).withColumn("t", F.lit(0).cast("long")))
    out = in_two_runs(spark, d, again, lambda s, out, ck: C.predict_each(s, predict, out, ck, ["ident"]))
    return out.groupBy("ident").agg(F.avg("score").alias("score"), F.count("*").alias("copies"))


@query("T8b_dated_ledger", f"WITH {EV} SELECT DISTINCT user_id, CASE WHEN user_id % 25 = 4 THEN NULL ELSE t END AS at_ms, user_id * 2 AS score, 1 AS copies FROM ev", l="user_id at_ms copies", d="score")
def _(spark, d):
    """A ledger by user and time, kept by day: all rows come in the first run or the second, the later half in both."""
    e = events(spark, d).select("user_id", "t", c("t").alias("known"))
    predict = lambda b: b.select("user_id", F.when(c("user_id") % 25 != 4, c("known")).alias("at_ms"), (c("user_id") * 2).alias("score"))
    again = e.unionByName(e.filter(c("t") >= middle(e)).withColumn("t", F.lit(0).cast("long")))
    out = in_two_runs(spark, d, again, lambda s, out, ck: C.predict_each(s, predict, out, ck, ["user_id", "at_ms"], "at_ms"))
    return out.groupBy("user_id", "at_ms").agg(F.avg("score").alias("score"), F.count("*").alias("copies"))


@query("T9_ledger_identity", f"WITH {EV} SELECT user_id, count(DISTINCT k) AS n FROM ev GROUP BY user_id", l="user_id n")
def _(spark, d):
    """A ledger takes every (user, size) once, whatever run brings it: inside a run by stream state, across runs by its batches."""
    rows = trades(spark, d).select("user_id", "size", "ts", "t").unionByName(trades(spark, d).select("user_id", "size", "ts", F.lit(0).cast("long").alias("t")))

    def start(s, out, checkpoint):
        once = C.ledger(s, "ts", ["user_id", "size"], "3650 days")
        return C.predict_each(once, lambda b: b.select("user_id", "size"), out, checkpoint, ["user_id", "size"])

    return in_two_runs(spark, d, rows, start).groupBy("user_id").agg(F.count("*").alias("n"))


@query("T11_incremental_run", f"WITH {EV} SELECT event_id, user_id, 1000 * k + event_id % 7 AS feature FROM ev", l="event_id user_id feature")
def _(spark, d):
    """A forward run in two parts gives the rows of a run over everything."""
    rows = events(spark, d).select("event_id", "user_id", "t", "k")
    start = lambda s, out, ck: C.run_available(s.withColumn("feature", 1000 * c("k") + c("event_id") % 7), out, ck)
    return in_two_runs(spark, d, rows, start)


@query("T5b_book_stream", l="seq t", d="best_bid best_ask mid_price spread_percent bid_depth_10bps order_book_imbalance_25bps", s="symbol status")
def _(spark, d):
    """The rows of T5 from a stream that is stopped half-way: the second run finds the books in their state store."""
    out = in_two_runs(spark, d, messages(spark, d), lambda s, o, ck: C.run_available(B.book_stream(s), o, ck), late_first=False)
    return B.book_metrics(out)


@query("T2b_timed_books", l="t levels", s="symbol")
def _(spark, d):
    """Books at every sixth hour by timers of the stream, also where no message arrives."""
    timed = lambda s, o, ck: C.run_available(B.book_stream(s, every_ms=6 * HOUR, late="0 seconds", emit=False), o, ck)
    out = in_two_runs(spark, d, messages(spark, d), timed, late_first=False).filter("status = 'timer'")
    return out.withColumn("levels", F.size("bids") + F.size("asks"))
