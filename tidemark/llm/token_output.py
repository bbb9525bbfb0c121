"""Token ids in Huffman-coded blocks.

Texts are encoded once with a public tokenizer; global id counts give one canonical code whose words
are at most MAX_BITS long (package-merge over the vocabulary, which bounds what the driver holds).
Documents are range-partitioned by id; every partition (a shard) writes blocks of whole documents.
A block can be decoded alone: it stores the bit offset of every 128th token, so a reader starts at any
of them and decodes all segments side by side with one table look-up a token.

Layout of a dataset folder: codebook/ (id, length) and blocks/ (shard, block, first_token within the
shard, n_tokens, doc_ids, doc_tokens, checkpoints, payload), both Parquet, written by Spark's commit
protocol. Shards and blocks ascend with doc_id (null first; equal ids by their tokens).

Defined results: null or empty text is one end id; repeated rows are written again; an empty table
gives a dataset without blocks. Other columns are dropped, so clashing names cannot occur.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import input_bytes, materialise, parts_for, shared_dir

STEP = 128  # tokens between checkpoints
BLOCK_TOKENS = 1 << 18
MAX_BITS = 16
CACHE_CHUNKS = 500_000
_MARK = "\x01"
#: A Latin letter before signs at the end of a chunk: letters and signs never share a pre-token.
_LETTER_THEN_STOP = r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}])([!#$%&*,.]+)([\x20\x09-\x0D]|$)"


class _Index(dict):
    """Chunk to number; a chunk seen for the first time gets the next one and is listed in `new`."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self)
        return n


class ChunkEncoder:
    """Ids of whole texts; encodes every distinct chunk between white space once and remembers it.

    Cutting at ASCII white space changes nothing for tokenizers whose pre-tokens never hold white space
    (it is dropped). Others keep it; probes tell, and their texts are encoded whole, one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes that hold an id of this vocabulary.
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.lowers = '"Lowercase"' in self.tokenizer.to_str().split('"model"')[0]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = ["ab", "c1", "7", "..", "\u00e9x", "\u65e5\u672c", _MARK]
        alone = [self._ids(w) for w in words]
        self.cuts = all(self._ids(f"{x}{x.join(words)}{x}") == list(chain.from_iterable(alone)) for x in (*"\x20\t\n\x0b\x0c\r", "\x20\n\x20"))
        self.mark = alone[-1]
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        """Forget all chunks; number 0 is the end id."""
        self.index = _Index()
        self.index["\x20"] = 0
        self.flat, self.starts, self.used = np.zeros(1 << 16, f"<u{self.width}"), np.array([0, 1], np.int64), 1
        self.hits = np.zeros(1, np.int64)

    def _shrink(self) -> None:
        """Keep the half of the chunks that was met most often."""
        words, keep = list(self.index), 1 + np.sort(np.argsort(-self.hits[1:], kind="stable")[: CACHE_CHUNKS // 2])
        ids = [self.flat[self.starts[i] : self.starts[i + 1]] for i in keep.tolist()]
        hits = self.hits[keep] // 2
        self.clear()
        self.index.update(zip((words[i] for i in keep.tolist()), range(1, len(keep) + 1)))
        self.flat, self.hits = np.concatenate([self.flat[:1], *ids]), np.r_[0, hits]
        self.starts = np.r_[0, 1, 1 + np.cumsum([len(x) for x in ids])]
        self.used = len(self.flat)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks after one another, and their numbers.

        One call encodes them with a mark between; if the mark's id stands anywhere else too, each chunk
        is encoded alone.
        """
        if len(self.mark) == 1:
            ids = np.array(self._ids(f"\x20{_MARK}\x20".join(chunks)), np.int64)
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) == len(chunks) - 1:
                return np.delete(ids, at), np.diff(np.r_[-1, at, len(ids)]) - 1
        some = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(some)), np.int64), np.array([len(x) for x in some], np.int64)

    def _chunks(self, texts: pa.Array) -> pa.Array:
        """Texts cut at white space; where the tokenizer cuts anyway, also before signs at a chunk's end."""
        if self.lowers and not any(pc.any(pc.match_substring(texts, s, ignore_case=True)).as_py() for s in self.special):
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_THEN_STOP, r"\1 \2\3")
        return pc.ascii_split_whitespace(texts)

    def _learn(self) -> None:
        for k in range(0, len(self.index.new), 1024):
            ids, lens = self._encode_chunks(self.index.new[k : k + 1024])
            total = self.used + len(ids)
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(total, self.flat.dtype)])
            self.flat[self.used : total] = ids
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens)])
            self.used = total
        self.index.new.clear()
        self.hits = np.concatenate([self.hits, np.zeros(len(self.index) - len(self.hits), np.int64)])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and the number of ids of each text, its end id included."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            some = [[*e.ids, end] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array(list(chain.from_iterable(some)), self.flat.dtype), np.array([len(x) for x in some], np.int64)
        if len(self.index) > CACHE_CHUNKS:
            self._shrink()
        self.flat[0] = end
        words = self._chunks(texts)
        sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.index.__getitem__, distinct), np.int32, len(distinct))
        self._learn()
        self.hits[known] += 1
        # Chunk numbers of all texts, a 0 after each; the ids are then copied chunk by chunk.
        last = np.cumsum(sizes + 1) - 1
        at = np.zeros(len(coded) + len(sizes), np.int32)
        inner = np.ones(len(at), bool)
        inner[last] = False
        if len(distinct):
            at[inner] = known[coded.indices.to_numpy(zero_copy_only=False)]
        book = pa.Array.from_buffers(pa.large_binary(), len(self.starts) - 1, [None, pa.py_buffer(self.starts * self.width), pa.py_buffer(self.flat)])
        taken = book.take(pa.array(at))
        edge = np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1] // self.width
        ids = np.frombuffer(taken.buffers()[2], self.flat.dtype)[: int(edge[-1])] if len(at) else np.zeros(0, self.flat.dtype)
        return ids, np.diff(edge[np.r_[0, last + 1]]) if len(sizes) else np.zeros(0, np.int64)


def _slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + limit)))
        yield batch.slice(start, end - start)
        start = end


def _crcs(ids: np.ndarray, edge: np.ndarray) -> list[int]:
    """crc32 of each stretch of ids between two edges."""
    view, at = memoryview(ids).cast("B"), (edge * ids.itemsize).tolist()
    return [zlib.crc32(view[a:b]) for a, b in zip(at[:-1], at[1:])]


_encoders: dict[str, ChunkEncoder] = {}


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, width, ids): ids packed as little-endian integers of `width` bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, ChunkEncoder(tokenizer))
        for whole in batches:
            for batch in _slices(whole, 1, 8 << 20):
                ids, n = encoder.encode(batch.column(1), end_id)
                edge = np.r_[0, np.cumsum(n)]
                crc = pa.array(_crcs(ids.astype("<u4"), edge), pa.int64())
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edge * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                width = pa.array(np.full(len(n), encoder.width, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), crc, width, packed], names=["doc_id", "n_tokens", "ids_crc32", "width", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, width int, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): every task adds up its own counts first, so the shuffle holds a row per id and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"<u{batch.column(0)[0].as_py()}")
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have], pa.int64())], names=["id", "n"])

    return tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(weights: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); weights > 0, in any order."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    level, from_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        from_leaf.append(by < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for flags in reversed(from_leaf):
        k = int(flags[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


class Code:
    """Canonical code: words ascend with (length, id), so the lengths alone restore it."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(lengths.max(initial=1))
        span = np.left_shift(1, self.bits - lengths)
        first = np.cumsum(span) - span
        top = int(ids.max(initial=0)) + 1
        self.word, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.word[ids], self.length[ids] = first >> (self.bits - lengths), lengths
        self.table_id = np.zeros(1 << self.bits, np.uint32)
        self.table_length = np.ones(1 << self.bits, np.int64)
        self.table_id[: int(span.sum())] = np.repeat(ids, span)
        self.table_length[: int(span.sum())] = np.repeat(lengths, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and the bit offsets of every STEP-th token, as little-endian 64-bit integers."""
        length = self.length[ids]
        end = np.cumsum(length)
        begin = end - length
        word, shift = begin >> 5, (64 - (begin & 31) - length).astype(np.uint64)
        both = self.word[ids] << shift
        n = int(end[-1] >> 5) + 2 if len(end) else 2
        # Bits of different tokens never overlap, so adding is or-ing; sums stay below 2**53.
        out = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        n_bytes = (int(end[-1]) + 7) // 8 if len(end) else 0
        return out.astype(np.uint64).astype(">u4").tobytes()[:n_bytes], begin[::STEP].astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """All segments advance together, one token a step."""
        b = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        last = len(window) - 1
        out = np.zeros((len(at), STEP), np.uint32)
        mask = (1 << self.bits) - 1
        for k in range(STEP):
            w = window[np.minimum(at >> 3, last)].astype(np.int64)
            code = (w >> (32 - self.bits - (at & 7))) & mask
            out[:, k] = self.table_id[code]
            at = at + self.table_length[code]
        return out.reshape(-1)[:n]


def write_tokens(tokens: DataFrame, path: str, target_bytes: int = 32 << 20) -> str:
    """Write the dataset; tokens must be a stored table (it is read for counts and for the blocks)."""
    spark = tokens.sparkSession
    # One row per id of the vocabulary: bounded by the tokenizer, not by the corpus.
    counts = np.array([(r.id, r.n) for r in id_counts(tokens).collect()], dtype=np.int64).reshape(-1, 2)
    ids, lengths = counts[:, 0], code_lengths(counts[:, 1])
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, lengths)], "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    code = spark.sparkContext.broadcast((ids, lengths))
    kind = tokens.schema["doc_id"].dataType
    parts = parts_for(spark, input_bytes(tokens, spark), target_bytes)
    ordered = tokens.repartitionByRange(parts, "doc_id", "ids_crc32", "n_tokens").sortWithinPartitions("doc_id", "ids_crc32", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, block, first = Code(*code.value), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, block, first
            parts = [np.frombuffer(x, f"<u{w}") for _, x, w in held]
            payload, checkpoints = coder.encode(np.concatenate(parts))
            row = {"shard": shard, "block": block, "first_token": first, "n_tokens": size, "doc_ids": [d for d, _, _ in held], "doc_tokens": [len(p) for p in parts], "checkpoints": checkpoints, "payload": payload}
            held, block, first, size = [], block + 1, first + size, 0
            return row

        fields = None
        for batch in batches:
            fields = fields or pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])
            for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "ids", "width"))):
                held.append(row)
                size += len(row[1]) // row[2]
                if size >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([flush()], schema=fields)
        if held:
            yield pa.RecordBatch.from_pylist([flush()], schema=fields)

    ordered.select("doc_id", "ids", "width").mapInArrow(run, f"shard int, block long, first_token long, n_tokens long, doc_ids array<{kind.simpleString()}>, doc_tokens array<long>, checkpoints binary, payload binary").write.parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files of write_tokens()."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codebook").collect()
    code = spark.sparkContext.broadcast((np.array([r.id for r in book], np.int64), np.array([r.length for r in book], np.int64)))
    # One number per shard.
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    base = dict(zip([r.shard for r in totals], np.cumsum([0, *(r.n for r in totals)]).tolist()))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Code(*code.value)
        for batch in batches:
            for i in range(batch.num_rows):
                x = {k: batch.column(k)[i] for k in ("shard", "first_token", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "payload")}
                ids = coder.decode(x["payload"].as_py(), x["checkpoints"].as_py(), x["n_tokens"].as_py()).astype("<u4")
                n = x["doc_tokens"].values.to_numpy()
                edge = np.r_[0, np.cumsum(n)]
                parts = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                columns = [x["doc_ids"].values, pa.array(edge[:-1] + x["first_token"].as_py() + base[x["shard"].as_py()]), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([p.tobytes() for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> str:
    """Tokenize, code and write whole texts; returns the dataset's folder."""
    path = path or f"{shared_dir(docs.sparkSession)}/tidemark-tokens-{uuid.uuid4().hex}"
    return write_tokens(materialise(tokenize(docs, tokenizer, end_id), "ids"), path)
