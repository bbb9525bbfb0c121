"""Reads by position: members of archives, and ranges of tapes sorted by time (SRC2, SRC7).

Files are opened where their bytes are needed, by any address that pyarrow's file systems know, and never held whole.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.sources.files import KLINE, TIME_NAMES, typed_klines

#: Bytes read at once when a line is sought.
PROBE = 1 << 14


def file_system(path: str) -> tuple[pf.FileSystem, str]:
    """The file system of an address, and the path in it; without a scheme, and for file:, the local one."""
    if path.startswith("file:"):
        return pf.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)


class _Raw(io.RawIOBase):
    """A pyarrow file that refuses positions before its begin as plain files do; zipfile counts on that."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.file.tell(), self.file.size())[whence]
        if to < 0:
            raise OSError(f"position {to} before the begin of the file")
        return self.file.seek(to)

    def readinto(self, buffer: memoryview) -> int:
        return self.file.readinto(buffer)


@contextmanager
def archive(path: str) -> Iterator[zipfile.ZipFile]:
    """A ZIP archive, of which only the parts asked for are read."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f, zipfile.ZipFile(io.BufferedReader(_Raw(f))) as z:
        yield z


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member and size of the CSV members of archives under a path, from their central directories alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                with archive(name) as z:
                    held = [(name, m.filename, m.file_size) for m in z.infolist() if m.filename.lower().endswith(".csv")]
                yield pd.DataFrame(held, columns=["path", "member", "size"])

    return listed.mapInPandas(run, "path string, member string, size long")


def read_zipped_klines(spark: SparkSession, path: str, nrows: int | None = None, tasks: int | None = None) -> DataFrame:
    """Candles of the CSV members of all archives under a path, a member a unit of work (SRC2).

    A member is read as a stream of chunks, so neither it nor its archive need fit in memory; a header line is left
    out. nrows keeps the first lines of each member; members are dealt to `tasks` (four a core unless given).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, member in zip(pdf["path"], pdf["member"]):
                with archive(name) as z:
                    if not z.getinfo(member).file_size:
                        continue
                    with z.open(member) as lines:
                        for part in pd.read_csv(lines, header=None, names=list(KLINE), dtype=str, chunksize=50_000, nrows=nrows):
                            yield part[part["open_time"] != "open_time"].assign(source_file=PurePosixPath(name).name)

    members = zip_members(spark, path).repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "path", "member")
    return typed_klines(members.mapInPandas(run, ", ".join(f"{k} string" for k in KLINE) + ", source_file string"))


def to_ms(text: str) -> int | None:
    """Epoch milliseconds of a time as written on a tape: seconds, milli- or microseconds by size, else None."""
    try:
        x = float(text)
    except ValueError:
        return None
    size = abs(x)
    return int(x * 1000) if 1e8 <= size < 1e11 else int(x) if 1e11 <= size < 1e14 else int(x // 1000) if 1e14 <= size < 1e17 else None


def cells(line: bytes) -> list[str]:
    """The cells of a line; none where quotes make it unreadable."""
    text = line.decode("utf-8-sig", "replace")
    if '"' not in text:
        return text.split(",")
    try:
        return next(csv.reader([text]), [])
    except csv.Error:
        return []


@dataclass
class ByteRange(InputPartition):
    """Lines that begin in [start, end) of a file."""

    path: str
    start: int
    end: int


class Tape:
    """One CSV file with a header: whole lines at byte positions. `read` counts the bytes that were asked for."""

    def __init__(self, path: str):
        self.path, self.read, self.held = path, 0, (0, b"")
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        head, self.first = self.line(0)
        self.columns = cells(head) if head else []

    def line(self, at: int) -> tuple[bytes | None, int]:
        """The line at a position and the position after it; None at the end of the file."""
        begin, block = self.held  # what the line before was found in
        held = block[at - begin :] if begin <= at < begin + len(block) else b""
        part = held
        while at + len(held) < self.size or b"\n" in part:
            if b"\n" in part:
                self.held = at, held
                one = held[: held.index(b"\n") + 1]
                return one.rstrip(b"\r\n"), at + len(one)
            self.file.seek(at + len(held))
            part = self.file.read(PROBE)
            self.read += len(part)
            held += part
        return (held.rstrip(b"\r\n"), self.size) if held else (None, self.size)

    def begin(self, at: int) -> int:
        """The first begin of a line at or after a position."""
        return self.first if at <= self.first else self.line(at - 1)[1]

    def seek(self, column: int, limit: int, below: bool) -> int:
        """By halving: with `below`, the last begin found with a time below limit (else the first line); without it, the
        first begin found with a time of at least limit (else the end). Lines without a readable time are stepped over."""
        low, high, found = self.first, self.size, self.first if below else self.size
        while low < high:
            middle = (low + high) // 2
            here, t = self.begin(middle), None
            at = here
            while t is None and at < high:
                text, after = self.line(at)
                row = cells(text) if text is not None else []
                t = to_ms(row[column]) if len(row) > column else None
                here, at = at, after
            if t is None or t >= limit:
                high, found = middle, here if t is not None and not below else found
            else:
                low, found = at, here if below else found
        return found

    def rows(self, start: int, end: int, chunk: int = 1 << 20) -> Iterator[list[tuple[int, list[str]]]]:
        """(position, cells) of the lines that begin in [start, end), in lists of about a chunk of bytes."""
        at, held = start, b""
        self.file.seek(at)
        while at < end:
            part = self.file.read(min(chunk, max(end - at - len(held), PROBE)))
            self.read += len(part)
            held += part
            lines = held.split(b"\n")
            held = lines.pop()
            if not part and held:
                lines, held = [*lines, held], b""
            out = []
            for x in lines:
                if at < end and x.strip():
                    out.append((at, cells(x.rstrip(b"\r"))))
                at += len(x) + 1
            if out:
                yield out
            if not part:
                return


class SortedTape(DataSource):
    """spark.read.format("sorted_tape"): the lines of CSV tapes that can hold a time in [start, end) (SRC7).

    Options: path (a file or a folder of .csv files), start and end in ms, time (name of its column; a usual name is
    found without it), slack (ms that a line may lie behind an earlier one; 0), split_bytes (16 MB). Columns: those of the
    first file's header as strings, source_file, and line_at, a line's byte position. A tape is cut by
    halving: a line more than the slack below start proves that all lines before it are too early, one at least the
    slack past end that all after it are too late. So a few probes a file replace the lines outside the range, which
    are neither read nor counted. Lines at the edges may lie outside the range: filter them.
    """

    @classmethod
    def name(cls) -> str:
        return "sorted_tape"

    def files(self) -> list[str]:
        path = self.options["path"].rstrip("/")
        fs, at = file_system(path)
        if fs.get_file_info(at).type == pf.FileType.File:
            return [path]
        root = path[: len(path) - len(at)] if path.endswith(at) else ""
        found = fs.get_file_info(pf.FileSelector(at, recursive=True))
        return sorted(root + x.path for x in found if x.type == pf.FileType.File and x.path.endswith(".csv"))

    def schema(self) -> StructType:
        names = next((x for x in (Tape(f).columns for f in self.files()) if x), [])
        return StructType([*(StructField(x, StringType()) for x in names), StructField("source_file", StringType()), StructField("line_at", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return TapeReader(self.files(), schema, self.options)


class TapeReader(DataSourceReader):
    def __init__(self, files: Sequence[str], schema: StructType, options: dict):
        self.files, self.names = list(files), schema.names[:-2]
        number = lambda x, default: int(options[x]) if x in options else default
        self.start, self.end, self.slack, self.split = number("start", None), number("end", None), number("slack", 0), number("split_bytes", 1 << 24)
        self.time = options["time"] if "time" in options else None
        self.probed = 0

    def ranges(self, path: str) -> list[ByteRange]:
        tape = Tape(path)
        if not tape.columns:
            return []
        lower = [x.strip().lower() for x in tape.columns]
        column = lower.index(next(x for x in ([self.time.lower()] if self.time else TIME_NAMES) if x in lower))
        low = tape.first if self.start is None else tape.seek(column, self.start - self.slack, True)
        high = tape.size if self.end is None else tape.seek(column, self.end + self.slack, False)
        cuts = [low, *range(low + self.split, high, self.split), high]
        self.probed += tape.read
        return [ByteRange(path, a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def partitions(self) -> list[ByteRange]:
        with ThreadPoolExecutor(16) as pool:
            found = [x for some in pool.map(self.ranges, self.files) for x in some]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        tape = Tape(partition.path)
        place = {x: i for i, x in enumerate(tape.columns)}
        for part in tape.rows(tape.begin(partition.start), partition.end):
            cell = lambda name: pa.array([row[place[name]] if name in place and place[name] < len(row) else None for _, row in part], pa.string())  # noqa: B023, E731
            columns = [cell(x) for x in self.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([PurePosixPath(partition.path).name] * len(part)), pa.array([at for at, _ in part], pa.int64())], names=[*self.names, "source_file", "line_at"])


def read_tape(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, **options: object) -> DataFrame:
    """Lines of sorted tapes around [start, end); see SortedTape."""
    spark.dataSource.register(SortedTape)
    given = {"path": path, "start": start, "end": end, **options}
    return spark.read.format("sorted_tape").options(**{k: str(v) for k, v in given.items() if v is not None}).load()
