"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token starts as a linked list of bytes. Every neighbouring pair that the vocabulary joins waits, by
its left position, in the bucket of its merge rank; two levels of bitmaps mark the buckets in use, so the
lowest rank is two find-first-set steps away, whatever the length of the pre-token. A merge puts at most
two new pairs into buckets and leaves old entries behind: an entry counts only while its position still
holds that rank, and is skipped as stale otherwise. All pre-tokens that a batch has not seen before share
one list, with a separator between them, so a pre-token of a million bytes and a million short ones cost
about the same, n log n at most. Pre-tokens already encoded by this worker come from a bounded memory.

Defined results: a null or empty text has no ids (an empty binary). Rows are kept one for one, repeated
rows too; columns of the input other than the two named are dropped, so clashing names cannot occur.
Bytes that are not UTF-8 become U+FFFD first. Special strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.llm.batches import blocks

#: Pre-tokens a worker remembers before it starts afresh; bounds its memory whatever the corpus.
KNOWN_PIECES = 700_000
#: Bytes of new pre-tokens merged in one list (more only for a longer one): the list then stays in cache.
MERGE_BYTES = 1 << 16
#: Longer texts are split at spaces between words, which always separate pre-tokens.
TEXT_PIECE = 1 << 20
_GAP, _DEAD, _NONE = 0xFFFF, -2, -1
_WORD = 256
_LIST_SYMBOLS = 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _class_ranges(chars: str) -> str:
    """The characters as ranges of a character class."""
    at = np.unique(np.frombuffer(chars.encode("utf-32-le"), dtype=np.uint32))
    cut = np.flatnonzero(np.diff(at) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]))


def splitter(pattern: str) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    """(pattern for most texts, pattern for the others, test for those others).

    This module and the library carry different versions of Unicode. The library is asked which characters
    it takes for letters and numbers; where the two disagree the second pattern follows the library.
    """
    single = {bytes([i]): i for i in range(256)}
    exact, others = pattern, ""
    for name in (r"\p{L}", r"\p{N}"):
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        own = "".join(regex.findall(name, every))
        its = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        less, more = "".join(set(own) - set(its)), "".join(set(its) - set(own))
        others += less + more
        spelled = f"[[{name}{_class_ranges(more) if more else ''}]{f'--[{_class_ranges(less)}]' if less else ''}]"
        exact = exact.replace(name, spelled)
    fast = regex.compile(pattern)
    if not others:
        return fast, fast, None
    return fast, regex.compile(exact, regex.V1), regex.compile(f"[{_class_ranges(others)}]")


class RankQueue:
    """Buckets (heaps) of list positions by merge rank, under two levels of bitmaps."""

    def __init__(self, ranks: int):
        self.words, self.top = [0] * (-(-ranks // _WORD)), 0
        self.buckets: list[list[int] | None] = [None] * ranks

    def put(self, rank: int, places: list[int]) -> None:
        """Gives an empty bucket its positions, ascending; those of a bucket in use go straight onto its heap."""
        self.buckets[rank] = places
        self.words[rank // _WORD] |= 1 << rank % _WORD
        self.top |= 1 << rank // _WORD

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use and its positions, which leave the queue; None when it is empty."""
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits ^ low
        if bits == low:
            self.top ^= 1 << word
        rank = word * _WORD + low.bit_length() - 1
        bucket, self.buckets[rank] = self.buckets[rank], None
        return rank, bucket


class ByteBpe:
    """Encodes with one rank file; a worker keeps one of them."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        if max(self.ranks.values()) >= _GAP:
            raise ValueError(f"ids of {_GAP} and more are not supported")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        get = self.ranks.get
        self.pairs = {
            a << 16 | b: rank
            for token, rank in self.ranks.items() for cut in range(1, len(token))
            if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None
        }
        self.first = np.full((256, 256), _NONE, dtype=np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.fast, self.exact, self.differs = splitter(pattern)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str, find: regex.Pattern) -> Iterator[list[str]]:
        """The pre-tokens of a text, some at a time."""
        at = 0
        while len(text) - at > TEXT_PIECE and (m := self.cut.search(text, at + TEXT_PIECE)):
            yield find.findall(text[at : m.start()])
            at = m.start()
        yield find.findall(text[at:] if at else text)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece after all merges, by the queue."""
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", dtype=np.uint8)
        gaps = np.cumsum(np.array([0, *(len(p) + 1 for p in pieces)], dtype=np.int64))
        start = np.append(self.first[raw[:-1], raw[1:]], np.int32(_NONE))
        start[gaps], start[gaps[1:] - 1] = _NONE, _NONE
        symbols = self.byte[raw]
        symbols[gaps] = _GAP
        waiting = np.flatnonzero(start >= 0)
        waiting = waiting[np.argsort(start[waiting], kind="stable")]
        order = start[waiting]
        cuts = np.flatnonzero(np.diff(order, prepend=-1)).tolist()
        places, queue, n = waiting.tolist(), self.queue, len(raw)
        for a, b in zip(cuts, [*cuts[1:], len(places)]):
            queue.put(int(order[a]), places[a:b])

        def column(values: np.ndarray) -> list[int] | array:  # lists are faster, arrays a third of the size
            return values.tolist() if n < _LIST_SYMBOLS else array("i", values.astype(np.int32).tobytes())

        token, rank_at, after, before = column(symbols), column(start), column(np.arange(1, n + 1)), column(np.arange(-1, n - 1))
        join, put, buckets = self.pairs.get, queue.put, queue.buckets
        while (least := queue.take()) is not None:
            rank, bucket = least
            shifted = rank << 16
            while bucket:
                p = heappop(bucket)  # the leftmost of equal ranks merges first
                if rank_at[p] != rank:
                    continue  # stale: one of its symbols has merged since
                q = after[p]
                r, o = after[q], before[p]
                token[p], after[p], before[r], rank_at[q] = rank, r, p, _DEAD
                right, left = join(shifted | token[r], _NONE), join(token[o] << 16 | rank, _NONE)
                rank_at[p], rank_at[o] = right, left
                if right >= 0:
                    if (waits := buckets[right]) is None:
                        put(right, [p])
                    else:
                        heappush(waits, p)
                if left >= 0:
                    if (waits := buckets[left]) is None:
                        put(left, [o])
                    else:
                        heappush(waits, o)
                if 0 <= right < rank or 0 <= left < rank:  # a lower rank has come up: it goes first
                    if bucket:
                        put(rank, bucket)
                    break
        ids = np.array(token, dtype=np.int64)[np.array(rank_at) != _DEAD]
        ends = (np.flatnonzero(ids == _GAP) * 4).tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[a + 4 : b] for a, b in zip(ends, ends[1:])]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, all merged together. A piece that is a token is that token, however merges would go."""
        raws = {p: p.encode() for p in pieces}
        out = {p: self.ranks[raw].to_bytes(4, "little") for p, raw in raws.items() if raw in self.ranks}
        todo = [p for p in pieces if p not in out]
        ends = np.cumsum([len(raws[p]) for p in todo], dtype=np.int64)
        a = 0
        while a < len(todo):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MERGE_BYTES)))
            out.update(zip(todo[a:b], self.merge([raws[p] for p in todo[a:b]])))
            a = b
        return out

    def _encode_long(self, text: str) -> bytes:
        out = []
        for ps in self.pieces(text, self.exact):
            own = self.learn(set(ps))
            out.append(b"".join(map(own.__getitem__, ps)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; new pieces are merged together."""
        cut = [self.fast.findall(t) if 0 < len(t) <= TEXT_PIECE else [] for t in texts]
        every = set().union(*cut)
        new = every.difference(self.known)
        apart = {i for i, t in enumerate(texts) if len(t) > TEXT_PIECE}
        if self.differs and self.differs.search("".join(new)):  # such pieces are never remembered, so they are always new
            odd = {p for p in new if self.differs.search(p)}
            apart |= {i for i, ps in enumerate(cut) if not odd.isdisjoint(ps)}
            every, new = every - odd, new - odd
        if len(self.known) + len(new) > KNOWN_PIECES:
            self.known.clear()
            new = every
        if new:
            self.known.update(self.learn(new))
        get = self.known.__getitem__
        return [self._encode_long(t) if i in apart else b"".join(map(get, ps)) for i, (t, ps) in enumerate(zip(texts, cut))]


class ByteDecoder:
    """Bytes of ids, by one look-up an id."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian ids; an id outside the vocabulary raises."""
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        except (IndexError, TypeError) as e:
            raise ValueError("an id is not in the vocabulary") from e


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    """The worker's own encoder of a rank file."""
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> ByteDecoder:
    return ByteDecoder(path)


def encode_texts(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens long, ids binary) of every whole text; a map without a shuffle.

    ranks: a rank file at the same path on every executor; pattern: cuts texts into pre-tokens. ids hold
    little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, pattern)
        for batch in blocks(batches, 1):
            ids = own.encode_all([(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for in the binary column out_col; null ids stay null."""
    rows = encoded.drop(out_col)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(ranks)
        for batch in blocks(batches, at):
            raw = pa.array([None if i is None else own.decode(i) for i in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out_col, BinaryType())]))
