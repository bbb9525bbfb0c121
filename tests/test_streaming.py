import pytest
"""Streams over files, run to the end of what is there, equal their batch form."""

import glob
import os

from pyspark.sql import functions as F

from tidemark.plans.registry import events
from tidemark.plans.streams import messages, trades
from tidemark.streaming import book as K
from tidemark.streaming import candles as C

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, path, parts=4):
    order = df.columns.index("t") if "t" in df.columns else 0
    df.repartitionByRange(parts, df.columns[order]).write.mode("overwrite").parquet(path)
    for i, f in enumerate(sorted(glob.glob(f"{path}/part-*"))):  # files are taken by their time
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_candles_equal_batch_but_for_open_windows(spark, tmp_path):
    t = trades(spark, SF)
    s = as_stream(spark, t, f"{tmp_path}/in")
    C.run_available(C.candles(s, width="1 hour", late="30 days"), f"{tmp_path}/out", f"{tmp_path}/ck")
    batch = C.candles(t, width="1 hour")
    got = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out")
    # Append mode emits windows that the watermark has passed; with 30 days none has, then flush by a small delay.
    C.run_available(C.candles(as_stream(spark, t, f"{tmp_path}/in2", 1), width="1 hour", late="1 minute"), f"{tmp_path}/out2", f"{tmp_path}/ck2")
    done = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out2")
    assert set(rows(got, *batch.columns)) <= set(rows(batch, *batch.columns))
    all_rows = rows(batch, *batch.columns)
    assert set(rows(done, *batch.columns)) <= set(all_rows) and done.count() >= len(all_rows) - 1


def test_ledger_once(spark, tmp_path):
    t = trades(spark, SF).withColumn("ident", F.col("trade_id") % 50)
    s = as_stream(spark, t, f"{tmp_path}/in")
    C.run_available(C.ledger(s, "ts", ["ident"], "60 days"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("ident").distinct().count() == t.select("ident").distinct().count()


def test_book_stream_equals_batch(spark, tmp_path):
    m = messages(spark, SF)
    s = as_stream(spark, m, f"{tmp_path}/in")
    C.run_available(K.book_stream(s), f"{tmp_path}/out", f"{tmp_path}/ck")
    batch = K.book_rows(m)
    got = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out")
    assert rows(got, *batch.columns) == rows(batch, *batch.columns)
    assert {r.status for r in batch.select("status").distinct().collect()} >= {"snapshot", "applied"}


def test_book_gap_and_old_updates():
    b = K.Book(depth=2)
    assert b.apply("delta", 1, 2, [], []) == "waiting"
    assert b.apply("snapshot", 0, 10, [(99.0, 1.0), (98.0, 1.0), (97.0, 1.0)], [(101.0, 2.0)]) == "snapshot" and len(b.bids) == 2
    assert b.apply("delta", 5, 9, [], []) == "old_update"
    assert b.apply("delta", 11, 12, [(99.0, 0.0)], [(101.0, 3.0)]) == "applied" and b.levels() == ([(98.0, 1.0)], [(101.0, 3.0)])
    assert b.apply("delta", 20, 21, [], []) == "gap" and b.last is None


def test_predictions_are_appended_once(spark, tmp_path):
    e = events(spark, SF).select("event_id", "t", "value")
    predict = lambda b: b.select("event_id", (F.col("value") * 2).alias("score"))
    for n in range(2):
        C.predict_each(as_stream(spark, e, f"{tmp_path}/in{n}"), predict, f"{tmp_path}/out", f"{tmp_path}/ck{n}", ["event_id"])
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == e.count() == got.select("event_id").distinct().count()


def test_matured_labels(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00")], "k int, s string").select("k", F.col("s").cast("timestamp").alias("decision_ts"))
    p = spark.createDataFrame([(1, "2024-01-01 00:00:30", 5.0), (1, "2024-01-01 02:00:00", 6.0), (2, "2024-01-01 00:00:10", 7.0), (1, "2024-01-05 00:00:00", 8.0)], "k int, s string, price double").select("k", F.col("s").cast("timestamp").alias("price_ts"), "price")
    out = C.matured(as_stream(spark, d, f"{tmp_path}/d", 1), as_stream(spark, p, f"{tmp_path}/p", 1), "k", "1 HOUR", "1 minute")
    C.run_available(out, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [r.price for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [5.0]


def test_null_identities_enter_the_ledger_once(spark, tmp_path):
    e = spark.createDataFrame([(1, 1.0), (None, 1.0), (None, 1.0), (2, 3.0)], "ident long, score double")
    for n in range(2):
        C.predict_each(as_stream(spark, e, f"{tmp_path}/in{n}"), lambda b: b.select("ident", "score"), f"{tmp_path}/out", f"{tmp_path}/ck{n}", ["ident"])
    assert sorted(str(r.ident) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "None"]


def test_a_batch_that_dies_after_its_write_leaves_one_copy(spark, tmp_path):
    e = spark.createDataFrame([(i, float(i)) for i in range(20)], "ident long, score double")
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    e.repartition(2).write.parquet(source)
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    real, calls = C.add_batch, []

    def dies(rows, path, batch, identity):
        real(rows, path, batch, identity)
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("the driver dies here")

    C.add_batch = dies
    try:
        with pytest.raises(Exception, match="dies here"):
            C.predict_each(stream(), lambda b: b, out, checkpoint, ["ident"])
        assert spark.read.parquet(out).count() == 20
        C.predict_each(stream(), lambda b: b, out, checkpoint, ["ident"])
    finally:
        C.add_batch = real
    assert calls[1] == calls[2] and sorted(r.ident for r in spark.read.parquet(out).collect()) == list(range(20))


def test_a_dated_ledger_reads_the_days_of_its_batch(spark, tmp_path):
    day, out = 86_400_000, f"{tmp_path}/out"
    shape = "user long, at long, v double"
    add = lambda batch, some: C.add_dated_batch(spark.createDataFrame(some, shape), out, batch, ["user", "at"], "at")
    kept = lambda: sorted(((r.user, r.at, r.v) for r in spark.read.parquet(out).collect()), key=str)
    first = [(u, d * day + u, 1.0) for u in range(3) for d in range(-2, 8)] + [(1, None, 1.0), (None, None, 1.0), (None, 5, 1.0)]
    add("w-0", first)
    add("w-0", first)  # a batch that runs again leaves one copy
    assert kept() == sorted(first, key=str)
    second = [(1, 3 * day + 1, 2.0), (1, 3 * day + 9, 2.0), (1, 3 * day + 9, 2.0), (1, None, 2.0), (2, None, 2.0), (None, 5, 2.0)]
    add("w-1", second)
    add("w-2", [])
    assert kept() == sorted([*first, (1, 3 * day + 9, 2.0), (2, None, 2.0)], key=str)
    held = spark.read.parquet(out)
    plan = C.held_days(held, "w-2", 3, 4, False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(day" in plan
    assert {r.day for r in C.held_days(held, "w-2", 3, 4, False).select("day").distinct().collect()} == {3, 4}
    assert C.held_days(held, "w-2", None, None, False).count() == 0 and C.held_days(held, "w-2", None, None, True).count() == 3
    with pytest.raises(ValueError, match="no part"):
        C.add_dated_batch(spark.createDataFrame([], shape), out, "w-3", ["user"], "at")


def book_messages(spark, rows):
    levels = lambda side: [{"p": float(p), "q": float(q)} for p, q in side]
    shape = "symbol string, seq long, t long, kind string, first long, final long, bids array<struct<p:double,q:double>>, asks array<struct<p:double,q:double>>"
    return spark.createDataFrame([(*r[:6], levels(r[6]), levels(r[7])) for r in rows], shape)


def test_book_state_survives_a_restart_and_writes_no_json(spark, tmp_path):
    first = [("x", 1, 1000, "snapshot", 0, 10, [(99, 1), (98, 2)], [(101, 1)]), ("y", 2, 1000, "delta", 1, 1, [], []), ("x", 3, 1500, "delta", 11, 11, [(99, 0)], [(102, 5)])]
    second = [("x", 4, 2500, "delta", 12, 13, [(97, 3)], [(101, 0)]), ("x", 5, 2600, "delta", 20, 21, [], []), ("y", 6, 2600, "snapshot", 0, 5, [(9, 1)], [(11, 1)])]
    source = f"{tmp_path}/in"
    for part in (first, second):
        book_messages(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(book_messages(spark, first).schema).parquet(source)
        C.run_available(K.book_stream(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    batch = K.book_rows(book_messages(spark, first + second))
    got = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out")
    assert rows(got, *batch.columns) == rows(batch, *batch.columns)
    assert {r.seq: r.status for r in got.collect()} == {1: "snapshot", 2: "waiting", 3: "applied", 4: "applied", 5: "gap", 6: "snapshot"}
    import inspect

    assert "json" not in inspect.getsource(K.BookProcessor)


def test_timers_emit_aligned_books(spark, tmp_path):
    rows_ = [("x", 1, 1200, "snapshot", 0, 10, [(99, 1)], [(101, 1)]), ("x", 2, 2100, "delta", 11, 11, [(98, 4)], []), ("x", 3, 9000, "delta", 12, 12, [(97, 1)], [])]
    source, shape = f"{tmp_path}/in", book_messages(spark, rows_).schema
    for r in rows_:
        book_messages(spark, [r]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        C.run_available(K.book_stream(stream, every_ms=1000, late="0 seconds"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r.t: (r.seq, [b.p for b in r.bids]) for r in spark.read.parquet(f"{tmp_path}/out").filter("status = 'timer'").collect()}
    assert got[2000] == (10, [99.0]) or got[2000] == (11, [99.0, 98.0])
    assert all(t % 1000 == 0 for t in got) and {2000, 3000, 4000, 8000} <= set(got) and max(got) <= 9000
    with pytest.raises(ValueError):
        K.book_stream(spark.readStream.schema(shape).parquet(source), every_ms=1, ttl_ms=1)


def test_book_queries_on_streams(spark):
    from tidemark import plans

    key = lambda r: (r.symbol, r.seq)
    stream, batch = (sorted(plans.QUERIES[q](spark, SF).collect(), key=key) for q in ("T5b_book_stream", "T5_order_book_state"))
    assert stream == batch and len(batch)
    timed = plans.QUERIES["T2b_timed_books"](spark, SF).collect()
    assert timed and all(r.t % (6 * 3_600_000) == 0 for r in timed) and len({(r.symbol, r.t) for r in timed}) == len(timed)


def test_book_processor_emits_slices_in_order(monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    monkeypatch.setattr(K, "SLICE", 4)
    side = SimpleNamespace(iterator=lambda: iter([]), removeKey=lambda k: None, updateValue=lambda k, v: None)
    kept = []
    last = SimpleNamespace(exists=lambda: False, clear=lambda: None, update=kept.append)
    p = K.BookProcessor()
    p.init(SimpleNamespace(getValueState=lambda *a, **o: last, getMapState=lambda *a, **o: side))
    level = lambda x, q: [{"p": x, "q": q}]
    rows = pd.DataFrame([("a", i, 1000 + i, "delta" if i else "snapshot", i, i, None if i == 5 else level(99.0 - i % 3, float(i % 4)), level(101.0 + i % 3, 2.5)) for i in range(11)], columns=["symbol", "seq", "t", "kind", "first", "final", "bids", "asks"])
    want = K._fold(K.Book(), rows)
    mixed = rows.sample(frac=1.0, random_state=3)
    got = list(p.handleInputRows(("a",), iter([mixed[:5], mixed[5:]]), None))
    assert [len(x) for x in got] == [4, 4, 3] and kept == [(10, 1010)]
    pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), want)


def test_a_large_micro_batch_is_sorted_in_runs_on_disk(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(K, "SLICE", 4)
    monkeypatch.setattr(K, "RUN", 10)
    monkeypatch.setattr(K, "RUNS", 3)
    seqs = [*range(60), *[7] * 9, *range(40, 97), None]
    random.Random(5).shuffle(seqs)
    columns = lambda part: [part, [0 if x is None else x for x in part], ["delta"] * len(part), part, part, [[1.0, 2.0]] * len(part), [None] * len(part)]
    made = []

    def batches():
        for at in range(0, len(seqs), 3):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns(seqs[at : at + 3]), K.PACKED)], schema=K.PACKED)

    real = K._kept
    monkeypatch.setattr(K, "_kept", lambda run: made.append(1) or real(run))
    got = [x for b in K._in_order(batches()) for x in b["seq"].to_pylist()]
    assert got == sorted((x for x in seqs if x is not None)) + [None] and len(made) > 10


def test_timed_books_without_rows_of_messages(spark, tmp_path):
    rows_ = [("x", i, 1000 * i, "delta" if i % 9 else "snapshot", i, i, [(99 - i % 4, i % 3)], [(101 + i % 5, 1)]) for i in range(1, 40)]
    source, shape = f"{tmp_path}/in", book_messages(spark, rows_).schema
    book_messages(spark, rows_).coalesce(1).write.parquet(source)
    got = {}
    for emit in (True, False):
        stream = spark.readStream.schema(shape).parquet(source)
        C.run_available(K.book_stream(stream, every_ms=7000, late="0 seconds", emit=emit), f"{tmp_path}/out{emit}", f"{tmp_path}/ck{emit}")
        got[emit] = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{emit}").orderBy("t", "seq").collect()]
    assert got[False] and got[False] == [r for r in got[True] if r[3] == "timer"]
