"""Order-book state from snapshots and deltas, and metrics of book rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.semantics import safe_div
from tidemark.operators.folds import fold

c = F.col
OUT = "symbol string, seq long, t long, status string, bids array<struct<p:double,q:double>>, asks array<struct<p:double,q:double>>"


class Book:
    """Levels of both sides; a delta applies if it continues the last update, else the book awaits a snapshot."""

    def __init__(self, last: int | None = None, bids: dict[float, float] | None = None, asks: dict[float, float] | None = None, depth: int = 50):
        self.last, self.bids, self.asks, self.depth = last, bids or {}, asks or {}, depth

    def apply(self, kind: str, first: int, final: int, bids: list, asks: list) -> str:
        if kind == "snapshot":
            self.bids, self.asks, self.last = {p: q for p, q in bids if q > 0}, {p: q for p, q in asks if q > 0}, final
            self._prune()
            return "snapshot"
        if self.last is None:
            return "waiting"
        if final <= self.last:
            return "old_update"
        if first > self.last + 1:
            self.last, self.bids, self.asks = None, {}, {}
            return "gap"
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for p, q in levels:
                if q > 0:
                    side[p] = q
                else:
                    side.pop(p, None)
        self.last = final
        self._prune()
        return "applied"

    def _prune(self) -> None:
        for side, reverse in ((self.bids, True), (self.asks, False)):
            for p in sorted(side, reverse=reverse)[self.depth :] if len(side) > self.depth else ():
                del side[p]

    def levels(self) -> tuple[list, list]:
        return sorted(self.bids.items(), reverse=True), sorted(self.asks.items())


def _pairs(levels) -> list[tuple[float, float]]:
    return [(float(x["p"]), float(x["q"])) for x in (levels if levels is not None else [])]


def _fold(book: Book, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r in pdf.sort_values("seq", kind="stable").to_dict("records"):
        status = book.apply(r["kind"], int(r["first"]), int(r["final"]), _pairs(r["bids"]), _pairs(r["asks"]))
        b, a = book.levels()
        rows.append((r["symbol"], r["seq"], r["t"], status, [{"p": p, "q": q} for p, q in b], [{"p": p, "q": q} for p, q in a]))
    return pd.DataFrame(rows, columns=["symbol", "seq", "t", "status", "bids", "asks"])


def book_rows(messages: DataFrame, depth: int = 50) -> DataFrame:
    """Batch form: the book after each message (symbol, seq, t, kind, first, final, bids, asks). The state is the book."""

    def step(pdf: pd.DataFrame, book: Book | None) -> tuple[pd.DataFrame, Book]:
        book = book or Book(depth=depth)
        return _fold(book, pdf), book

    return fold(messages, ["symbol"], ["seq"], step, OUT)


#: State that transformWithState can keep: maps, timers and time limits need this provider.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Messages whose book rows a worker holds at once, messages that it sorts in memory, sorted runs that it reads side by side.
SLICE, RUN, RUNS = 1_000, 100_000, 64
PACKED = pa.schema([("seq", pa.int64()), ("t", pa.int64()), ("kind", pa.string()), ("first", pa.int64()), ("final", pa.int64()), ("bids", pa.list_(pa.float64())), ("asks", pa.list_(pa.float64()))])


def _packed(pdf: pd.DataFrame) -> pa.RecordBatch:
    """Messages of a symbol as numbers in Arrow, some hundred bytes each where objects take thousands; a side is p, q, p, q ..."""
    flat = {s: [None if x is None else [v for level in x for v in (level["p"], level["q"])] for x in pdf[s]] for s in ("bids", "asks")}
    return pa.RecordBatch.from_arrays([pa.array(flat.get(f.name, pdf.get(f.name)), f.type, from_pandas=True) for f in PACKED], schema=PACKED)


def _sorted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = pa.Table.from_batches(held, PACKED).combine_chunks()
    order = pc.sort_indices(batch["seq"])
    for at in range(0, len(batch), SLICE):
        yield from batch.take(order[at : at + SLICE]).combine_chunks().to_batches()


def _kept(run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The run written to an unnamed local file, which goes with its reader."""
    file = tempfile.TemporaryFile()
    with pa.ipc.new_stream(file, PACKED) as out:
        for batch in run:
            out.write_batch(batch)
    file.seek(0)
    return iter(pa.ipc.open_stream(file))


def _merged(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as one, a slice of each in memory: what does not pass the end of any slice can go."""
    if len(runs) == 1:
        yield from runs[0]
        return
    order = lambda x: pc.fill_null(x["seq"], np.iinfo(np.int64).max).to_numpy()
    heads = [next(run, None) for run in runs]
    while live := [i for i, head in enumerate(heads) if head is not None]:
        end, ready = min(order(heads[i])[-1] for i in live), []
        for i in live:
            n = int(np.searchsorted(order(heads[i]), end, side="right"))
            ready.append(heads[i].slice(0, n))
            heads[i] = heads[i].slice(n) if n < len(heads[i]) else next(runs[i], None)
        yield from _sorted(ready)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages by seq. Above RUN of them they lie in sorted runs on the worker's disk, so memory does not grow with the micro-batch."""
    runs, held, size = [], [], 0
    for batch in batches:
        if size and size + len(batch) > RUN:
            runs.append(_kept(_sorted(held)))
            held, size = [], 0
            if len(runs) == RUNS:
                runs = [_kept(_merged(runs))]
        held.append(batch)
        size += len(batch)
    yield from _merged([*runs, _sorted(held)])


def _apply(book: Book, symbol, batch: pa.RecordBatch, emit: bool) -> pd.DataFrame:
    """The book after each packed message, as _fold gives it; only the book is changed without emit."""
    rows, pairs = [], lambda x: list(zip(x[::2], x[1::2])) if x is not None else []
    for seq, t, kind, first, final, bids, asks in zip(*(x.to_pylist() for x in batch.columns)):
        status = book.apply(kind, first, final, pairs(bids), pairs(asks))
        if emit:
            b, a = book.levels()
            rows.append((symbol, seq, t, status, [{"p": p, "q": q} for p, q in b], [{"p": p, "q": q} for p, q in a]))
    return pd.DataFrame(rows, columns=["symbol", "seq", "t", "status", "bids", "asks"])


class BookProcessor(StatefulProcessor):
    """A symbol's book as state: a map of price to quantity for each side and the last update.

    Only levels that a batch has changed are written. With every_ms, a timer at each multiple of it emits the book
    as it stands (status "timer", seq of the last update), whether or not messages arrive; timers follow the
    watermark and stop while the book awaits a snapshot. With ttl_ms, a book that nothing has touched for so long is forgotten.
    Without emit, messages change books but give no rows of their own.
    """

    def __init__(self, depth: int = 50, every_ms: int | None = None, ttl_ms: int | None = None, emit: bool = True):
        self.depth, self.every_ms, self.ttl_ms, self.emit = depth, every_ms, ttl_ms, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {} if self.ttl_ms is None else {"ttl_duration_ms": self.ttl_ms}
        self.last = handle.getValueState("last", "last long, t long", **ttl)
        self.sides = [handle.getMapState(name, "p double", "q double", **ttl) for name in ("bids", "asks")]

    def _read(self) -> tuple[Book, int | None]:
        at = self.last.get() if self.last.exists() else None
        levels = [{p[0]: q[0] for p, q in side.iterator()} if at is not None else {} for side in self.sides]
        return Book(at[0] if at is not None else None, *levels, depth=self.depth), at[1] if at is not None else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, _ = self._read()
        old = [dict(book.bids), dict(book.asks)]
        times = []

        def packed() -> Iterator[pa.RecordBatch]:
            for part in rows:
                times.extend(int(x) for x in (part["t"].min(), part["t"].max()) if not pd.isna(x))
                yield from (_packed(part.iloc[a : a + SLICE]) for a in range(0, len(part), SLICE))

        for batch in _in_order(packed()):
            out = _apply(book, key[0], batch, self.emit)
            if self.emit:
                yield out
        for side, before, now in zip(self.sides, old, (book.bids, book.asks)):
            for p in before.keys() - now.keys():
                side.removeKey((p,))
            for p, q in now.items():
                if before.get(p) != q or self.ttl_ms is not None:
                    side.updateValue((p,), (q,))
        if book.last is None:
            self.last.clear()
        else:
            self.last.update((book.last, max(times, default=None)))
        if self.every_ms is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer((min(times) // self.every_ms + 1) * self.every_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, book = expiredTimerInfo.getExpiryTimeInMs(), self._read()[0]
        if book.last is None:
            return
        b, a = ([{"p": p, "q": q} for p, q in side] for side in book.levels())
        due = range(at, max(at, timerValues.getCurrentWatermarkInMs()) + 1, self.every_ms)  # the watermark can pass several at once
        yield pd.DataFrame([(key[0], book.last, t, "timer", b, a) for t in due], columns=["symbol", "seq", "t", "status", "bids", "asks"])
        self.handle.registerTimer(due[-1] + self.every_ms)

    def close(self) -> None:
        pass


def book_stream(messages: DataFrame, depth: int = 50, every_ms: int | None = None, late: str = "1 minute", ttl_ms: int | None = None, emit: bool = True) -> DataFrame:
    """Streaming form: the same fold, its state kept per symbol between micro-batches (T5), with timed snapshots.

    every_ms: emit each book at multiples of it in event time, once the watermark (`late` behind the newest t) has
    passed. ttl_ms: forget books untouched for so long in processing time; not together with every_ms.
    emit: a row a message; without it the timed books alone.
    """
    if every_ms is not None and ttl_ms is not None:
        raise ValueError("books have timers or a time limit, not both")
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "eventTime" if every_ms is not None else "processingTime" if ttl_ms is not None else "none"
    if every_ms is not None:
        messages = messages.withColumn("_ts", F.timestamp_millis("t")).withWatermark("_ts", late)
    return messages.groupBy("symbol").transformWithStateInPandas(BookProcessor(depth, every_ms, ttl_ms, emit), OUT, "append", mode)


def _depth(levels: Column, keep) -> Column:
    return F.aggregate(F.filter(levels, keep), F.lit(0.0), lambda a, x: a + x["q"])


def book_metrics(rows: DataFrame) -> DataFrame:
    """Best prices, mid (one side if the other is empty), spread ratio, depth in 10 and 25 bps, imbalance, largest walls."""
    bid, ask = F.try_element_at("bids", F.lit(1))["p"], F.try_element_at("asks", F.lit(1))["p"]
    out = rows.withColumns({"best_bid": bid, "best_ask": ask})
    out = out.withColumn("mid_price", F.coalesce((c("best_bid") + c("best_ask")) / 2, c("best_bid"), c("best_ask")))
    out = out.withColumn("spread_percent", safe_div(c("best_ask") - c("best_bid"), c("mid_price")))
    cols = {}
    for bps in (10, 25):
        k = bps / 1e4
        b, a = _depth(c("bids"), lambda x, k=k: x["p"] >= c("mid_price") * (1 - k)), _depth(c("asks"), lambda x, k=k: x["p"] <= c("mid_price") * (1 + k))
        cols |= {f"bid_depth_{bps}bps": b, f"ask_depth_{bps}bps": a, f"order_book_imbalance_{bps}bps": safe_div(b - a, b + a, 0)}
    for side in ("bid", "ask"):
        wall = F.array_max(F.transform(f"{side}s", lambda x: F.struct(x["q"].alias("q"), x["p"].alias("p"))))
        cols |= {f"large_{side}_wall_size": wall["q"], f"large_{side}_wall_distance": F.abs(safe_div(wall["p"], c("mid_price")) - 1)}
    return out.withColumns(cols)


def valid_books(rows: DataFrame) -> DataFrame:
    """Rows that may be emitted: both sides there, not crossed."""
    return rows.filter((c("best_bid") > 0) & (c("best_ask") > c("best_bid")))
