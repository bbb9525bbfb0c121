"""Language-model scores from Elias-Fano n-gram tries.

Tokens are runs without ASCII white space, A-Z lowered, and one end token per text, which is also the
context of the first token. The model mixes trigrams, bigrams and a smoothed unigram (Dirichlet priors):

    p(w | u v) = (c(u,v,w) + MU3 p(w | v)) / (c(u,v) + MU3)     (the first token has no u)
    p(w | v)   = (c(v,w) + MU p(w)) / (c(v) + MU),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

Documents are packed into batches of about BATCH_TOKENS tokens, written once. Each batch sends its
distinct words with training counts to shards by hash; a shard answers with total counts and numbers
(word ids, frequent words first). Then each batch sends its distinct bigrams and trigrams, with training
counts, as sorted id differences; the shard of an n-gram follows from its first word, and a first word
above a share of a shard is spread by the second one as well. A shard adds up the counts, builds its trie
and answers every batch in the order of its request, so a probability travels as one byte. Batches then
meet their answers and sum them up per document. All data moves in packed rows keyed by shard or batch;
only totals and the list of the most frequent words (at most a few a shard) reach the driver. Words are
told apart by 64-bit hashes.

A shard's trie is one memory-mapped file of three levels: first words; second words, with one byte of
quantised log probability and one of back-off weight; third words, with one byte of log probability.
Ids and child pointers are monotone Elias-Fano sequences (children are made monotone by adding the last
value before their context, as in Pibiri and Venturini's tries) and never decoded as a whole: an n-gram
is found by successor search inside its context's range, level by level, on the compressed sequences.

Defined results: null or empty texts are one end token; null ids are not held out; with no training
document N and V are 0 and scores equal base scores; repeated rows count and are scored each. Other
columns are dropped.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise

MU, MU3 = 1000.0, 20.0  # near the best held-out likelihood on prose of 6,000 documents
BATCH_TOKENS, SHARD_TOKENS = 1_000_000, 1_000_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_STEP, _CODES = 12.0 / 254, 255  # log10 p in [-12, 0] as codes 1..255; 0 is absent
_TABLE = np.r_[0.0, 10.0 ** (-(_CODES - np.arange(1, _CODES + 1)) * _STEP)]


_PARTS = ("heads", "sizes", "v", "n2", "sizes3", "w", "n3")


# ---- packed columns ---------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest whole bytes, byte planes apart, compressed if there are many."""
    top = int(values.max(initial=0))
    width = max(1, (top.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width | 16]) + planes if len(planes) < 64 else bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    width, raw = data[0] & 15, data[1:]
    planes = np.frombuffer(raw if data[0] & 16 else zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of values that ascend between the places `first`, where they stand whole."""
    out = np.diff(values, prepend=values[:1] * 0)
    out[first] = values[first]
    return out


def _unstep(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values back from the steps of groups of the given sizes."""
    total = np.cumsum(steps)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat(np.r_[np.zeros(1, steps.dtype), total][first], sizes[sizes > 0])


def _tags(hashes: np.ndarray) -> np.ndarray:
    """The half of the hashes that deals words to shards."""
    return hashes >> np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


# ---- the trie ---------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary, select by a rank directory."""

    def __init__(self, values: np.ndarray):
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        self.n, self.low_bits = n, max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)
        words = np.zeros(int(high[-1]) // 64 + 1 if n else 1, np.uint64)
        if n:
            at, first = np.unique(high // 64, return_index=True)
            words[at] = np.bitwise_or.reduceat(np.uint64(1) << (high % 64).astype(np.uint64), first)
        before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
        bits = self.low_bits * np.arange(n)
        low = np.zeros(self.low_bits * n // 64 + 2, np.uint64)
        if self.low_bits and n:
            part, shift = values & np.uint64((1 << self.low_bits) - 1), (bits % 64).astype(np.uint64)
            at, first = np.unique(bits // 64, return_index=True)
            low[at] |= np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift + np.uint64(self.low_bits) > 64)
            low[bits[over] // 64 + 1] |= part[over] >> (np.uint64(64) - shift[over])
        self.arrays = {"words": words, "before": before, "low": low}

    def access(self, i: np.ndarray) -> np.ndarray:
        a = self.arrays
        word = np.searchsorted(a["before"], i, "right") - 1
        rest, x, at = (i - a["before"][word]).astype(np.int64), a["words"][word], word * 64
        for width in (32, 16, 8, 4, 2, 1):
            half = x & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(half).astype(np.int64)
            right = rest >= ones
            rest -= np.where(right, ones, 0)
            x = np.where(right, x >> np.uint64(width), half)
            at = at + np.where(right, width, 0)
        high = (at - i).astype(np.uint64)
        if not self.low_bits:
            return high
        bit = i * self.low_bits
        word, shift = bit // 64, (bit % 64).astype(np.uint64)
        low = a["low"][word] >> shift
        spill = np.where(shift > 0, a["low"][word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), 0)
        return (high << np.uint64(self.low_bits)) | ((low | spill) & np.uint64((1 << self.low_bits) - 1))

    def successor(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in [low, high) whose value is at least `value`; high if there is none."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            less = self.access(mid) < value[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        return low


def _level(child: np.ndarray, first: np.ndarray) -> EliasFano:
    """Children ascend inside each context, which begins at `first`; shifted behind the value before it, all do."""
    if not len(child):
        return EliasFano(child)
    last = child[np.r_[first[1:], len(child)] - 1]
    shift = np.cumsum(last + 1) - (last + 1)
    return EliasFano(child + np.repeat(shift, np.diff(np.r_[first, len(child)])))


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(_CODES + np.log10(p) / _STEP), 1, _CODES).astype(np.uint8)


class Trie:
    """Bigrams and trigrams of one shard with quantised probabilities."""

    def __init__(self, u: np.ndarray, v: np.ndarray, count: np.ndarray, total: np.ndarray, of: np.ndarray, w: np.ndarray, count3: np.ndarray, mu: float, mu3: float):
        """(u, v) pairs are sorted, with count and c(u); trigrams are sorted by the number `of` of their pair and by w."""
        new = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
        new3 = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        sizes = np.bincount(of.astype(np.int64), minlength=len(u))
        self.levels = [EliasFano(u[new]), _level(v, new), _level(w, new3)]
        self.pointers = [EliasFano(np.r_[new, len(u)]), EliasFano(np.r_[0, np.cumsum(sizes)])]
        self.codes = {"two": _code(count / (total + mu)), "back": _code(mu3 / (count + mu3)), "three": _code(count3 / (count[of.astype(np.int64)] + mu3)) if len(of) else np.zeros(0, np.uint8)}
        self._map()

    def _map(self) -> None:
        """Move all arrays into one memory-mapped file; it has no name, so it goes with this object."""
        with tempfile.TemporaryFile() as f:
            spots = []
            for holder in [*(e.arrays for e in (*self.levels, *self.pointers)), self.codes]:
                for key, a in holder.items():
                    spots.append((holder, key, f.tell(), a.dtype, len(a)))
                    f.write(a.tobytes() + b"\0" * (-a.nbytes % 8 or 8))
            f.flush()
            self.file_bytes = os.fstat(f.fileno()).st_size
            for holder, key, at, dtype, n in spots:
                holder[key] = np.memmap(f, dtype, "r", at, (n,)) if n else np.zeros(0, dtype)

    def _child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words under their parents (-1: none), for parents that exist."""
        children, pointers = self.levels[level], self.pointers[level - 1]
        low, high = pointers.access(parent).astype(np.int64), pointers.access(parent + 1).astype(np.int64)
        base = np.zeros(len(low), np.uint64)
        inner = np.flatnonzero((low > 0) & (low < high))
        base[inner] = children.access(low[inner] - 1) + np.uint64(1)
        value = word + base
        at = children.successor(value, low, high)
        hit = np.flatnonzero(at < high)
        hit = hit[children.access(at[hit]) == value[hit]]
        out = np.full(len(low), -1)
        out[hit] = at[hit]
        return out

    def lookup(self, u: np.ndarray, v: np.ndarray, of: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of bigrams and of their back-off weights, and codes of trigrams (of: number of the bigram, w)."""
        two, back, three = np.zeros(len(u), np.uint8), np.full(len(u), _CODES, np.uint8), np.zeros(len(w), np.uint8)
        top = self.levels[0]
        if top.n and len(u):
            first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            at = top.successor(u[first], np.zeros(len(first), np.int64), np.full(len(first), top.n))
            inside = np.flatnonzero(at < top.n)
            found = np.full(len(first), -1)
            found[inside] = np.where(top.access(at[inside]) == u[first][inside], at[inside], -1)
            context = np.repeat(found, np.diff(np.r_[first, len(u)]))
            have = np.flatnonzero(context >= 0)
            pair = np.full(len(u), -1)
            pair[have] = self._child(1, context[have], v[have])
            have = np.flatnonzero(pair >= 0)
            two[have], back[have] = self.codes["two"][pair[have]], self.codes["back"][pair[have]]
            parent = pair[of]
            have = np.flatnonzero(parent >= 0)
            leaf = self._child(2, parent[have], w[have])
            three[have[leaf >= 0]] = self.codes["three"][leaf[leaf >= 0]]
        return two, back, three


# ---- batches and requests ---------------------------------------------------------------------------


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1  # 0 is the end token
        return n


def _batches(docs: DataFrame, batch_tokens: int) -> DataFrame:
    """Packed batches: documents, their token numbers, and the hashes and training counts of the words."""
    from xxhash import xxh3_64_intdigest

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = seq = None
        index, parts, ids, held_out, size = _Index(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal index, parts, ids, held_out, size
            tokens, n = np.concatenate(parts), np.array([len(p) for p in parts])
            hashes = np.array([0, *(xxh3_64_intdigest(w) or 1 for w in index)], np.uint64)
            counts = np.bincount(tokens[np.repeat(~np.array(held_out), n)], minlength=len(hashes))
            # The most frequent words get the smallest numbers, which pack well; the end stays 0.
            order = np.r_[0, 1 + np.argsort(-np.bincount(tokens, minlength=len(hashes))[1:], kind="stable")]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row = {"batch": (TaskContext.get().partitionId() << 32) + seq, "doc_ids": ids, "held": held_out, "n_tokens": len(tokens), "lengths": pack(n), "tokens": pack(place[tokens]), "hashes": pack(hashes[order]), "counts": pack(counts[order])}
            index, parts, ids, held_out, size = _Index(), [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=fields)

        seq = 0
        for batch in batches:
            fields = fields or pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.int64()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
                a = np.zeros(len(words) + 1, np.uint32)
                a[:-1] = np.fromiter(map(index.__getitem__, words), np.uint32, len(words))
                parts.append(a)
                ids.append(batch.column(0)[i].as_py())
                held_out.append(batch.column(1)[i].as_py())
                size += len(a)
                if size >= batch_tokens:
                    yield flush()
                    seq += 1
        if parts:
            yield flush()

    return rows.mapInArrow(run, f"batch long, doc_ids array<{kind}>, held array<boolean>, n_tokens long, lengths binary, tokens binary, hashes binary, counts binary")


class _Grams:
    """Distinct bigrams and trigrams of a batch in the order of word ids, and which of them each token ends."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        n, self.by = len(ids), order
        t = rank[tokens.astype(np.int64)]
        start = np.zeros(len(t), bool)
        start[np.cumsum(lengths)[:-1]] = True
        start[0] = True
        context = np.r_[rank[0], t[:-1]]
        context[start] = rank[0]
        key, self.two = np.unique(context * n + t, return_inverse=True)
        self.u, self.v = order[key // n], order[key % n]  # numbers of words in the batch
        self.later = np.flatnonzero(~start)
        key, self.three = np.unique(self.two[self.later - 1] * n + t[self.later], return_inverse=True)
        self.of, self.w = key // n, order[key % n]


def _shard_of(u: np.ndarray, v: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """By the first word; frequent ones spread over several shards by the second."""
    out = _mix(u + np.uint64(1))
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], u), len(hot[0]) - 1)
        out = out + np.where(hot[0][at] == u, _mix(v ^ np.uint64(0x5555)) % hot[2][at], 0).astype(np.uint64)
    return (out % np.uint64(shards)).astype(np.int64)


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for g in np.split(order, cut) if len(order) else []:
        yield int(shard[g[0]]), g


def _rows(fields: list[tuple[str, list]]) -> pa.RecordBatch:
    types = {"shard": pa.int64(), "batch": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.binary())) for k, v in fields], names=[k for k, _ in fields])


def _request(u: np.ndarray, v: np.ndarray, n2: np.ndarray, sizes3: np.ndarray, w: np.ndarray, n3: np.ndarray) -> list[bytes]:
    """Sorted n-grams of one batch for one shard: ids as steps, counts, and group sizes."""
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    heads, some = u[first], np.flatnonzero(sizes3)
    first3 = (np.cumsum(sizes3) - sizes3)[some]
    return [pack(_steps(heads, np.zeros(1, np.int64))), pack(np.diff(np.r_[first, len(u)])), pack(_steps(v, first)), pack(n2), pack(sizes3), pack(_steps(w, first3)), pack(n3)]


def _asked(row: list[bytes]) -> tuple[np.ndarray, ...]:
    """(u, v, n2, number of the bigram of each trigram, w, n3) of a request."""
    heads, sizes, v, n2, sizes3, w, n3 = map(unpack, row)
    sizes, sizes3 = sizes.astype(np.int64), sizes3.astype(np.int64)
    return np.repeat(np.cumsum(heads), sizes), _unstep(v, sizes), n2, np.repeat(np.arange(len(v)), sizes3), _unstep(w, sizes3), n3


def score_documents(docs: DataFrame, mu: float = MU, mu3: float = MU3, batch_tokens: int = BATCH_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    batches = materialise(_batches(docs.select("doc_id", "text"), batch_tokens), "batches")
    tokens = batches.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // shard_tokens))
    often = max(1, shard_tokens // 4)

    def ask_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for i in range(r.num_rows):
                hashes, counts = unpack(r.column(1)[i].as_py()), unpack(r.column(2)[i].as_py())
                out = [(s, pack(hashes[g]), pack(counts[g])) for s, g in _groups((_mix(_tags(hashes)) % np.uint64(shards)).astype(np.int64))]
                yield _rows([("shard", [o[0] for o in out]), ("batch", [r.column(0)[i].as_py()] * len(out)), ("a", [o[1] for o in out]), ("b", [o[2] for o in out])])

    def answer_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack(x) for x in pdf["a"]]
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(x) for x in pdf["b"]]).astype(np.float64), len(words)).astype(np.int64)
        order = np.argsort(-total, kind="stable")  # frequent words get small ids
        ids = np.empty(len(words), np.uint64)
        ids[order] = np.arange(len(words), dtype=np.uint64) * np.uint64(shards) + np.uint64(key[0])
        cut = np.cumsum([len(h) for h in hashes])[:-1]
        hot = order[total[order] > often]
        # One more row, of no batch: the shard's tokens and known words, and its frequent words.
        rows = {"batch": [*pdf["batch"], -1], "a": [*(pack(total[x]) for x in np.split(at, cut)), pack(ids[hot])], "b": [*(pack(ids[x]) for x in np.split(at, cut)), pack(total[hot])]}
        return pd.DataFrame({"shard": key[0], **rows, "n": [0] * len(pdf) + [int(total.sum())], "known": [0] * len(pdf) + [int((total > 0).sum())], "hot": [0] * len(pdf) + [len(hot)]})

    shape = "shard long, batch long, a binary, b binary"
    words = batches.select("batch", "hashes", "counts").mapInArrow(ask_words, shape).groupBy("shard").applyInPandas(answer_words, f"{shape}, n long, known long, hot long")
    words = materialise(words, "words")
    facts = words.agg(F.sum("n"), F.sum("known")).first()
    n_train, n_known = facts[0] or 0, facts[1] or 0
    # Words above a quarter of a shard: at most 4 a shard, and only these.
    frequent = [(unpack(r.a), unpack(r.b)) for r in words.filter("hot > 0").select("a", "b").collect()]
    ids, totals = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*frequent) if frequent else ((), ())))
    by = np.argsort(ids)
    shared = spark.sparkContext.broadcast((ids[by], totals[by], -(-totals[by] // np.uint64(often))))
    kind = batches.schema["doc_ids"].dataType.elementType.simpleString()

    def with_tags(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches as they travel: of the hashes only what deals words to shards."""
        for r in rows:
            tags = [pack(_tags(unpack(x.as_py()))) for x in r.column(5)]
            yield pa.RecordBatch.from_arrays([*r.columns[:5], pa.array(tags, pa.binary())], names=[*r.schema.names[:5], "tags"])

    def open_batch(rows: pd.DataFrame) -> tuple:
        """The batch's row, its tokens and lengths, word totals and ids, and its n-grams with their shards."""
        x = rows[rows["shard"] < 0].iloc[0]
        known = rows[rows["shard"] >= 0]
        tokens, lengths, tags = unpack(x["tokens"]), unpack(x["lengths"]).astype(np.int64), unpack(x["tags"])
        answer = {s: (unpack(a), unpack(b)) for s, a, b in zip(known["shard"], known["a"], known["b"])}
        count, ids = np.zeros(len(tags)), np.zeros(len(tags), np.uint64)
        for s, g in _groups((_mix(tags) % np.uint64(shards)).astype(np.int64)):
            count[g], ids[g] = answer[s]
        grams = _Grams(tokens, lengths, ids)
        return x, tokens.astype(np.int64), lengths, count, ids, grams, _shard_of(ids[grams.u], ids[grams.v], shards, shared.value)

    def ask_grams(rows: pd.DataFrame) -> pd.DataFrame:
        x, _, lengths, _, ids, grams, shard = open_batch(rows)
        train = np.repeat(~np.array(x["held"], dtype=bool), lengths)
        n2 = np.bincount(grams.two[train], minlength=len(grams.u))
        n3 = np.bincount(grams.three[train[grams.later]], minlength=len(grams.w))
        sizes = np.bincount(grams.of, minlength=len(grams.u))
        third = dict(_groups(shard[grams.of]))
        out, none = [], np.zeros(0, np.int64)
        for s, g in _groups(shard):
            h = third.get(s, none)
            out.append((s, x["batch"], *_request(ids[grams.u[g]], ids[grams.v[g]], n2[g], sizes[g], ids[grams.w[h]], n3[h])))
        return pd.DataFrame(out, columns=["shard", "batch", *_PARTS])

    def answer_grams(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [_asked(list(row)) for row in zip(*(pdf[k] for k in _PARTS))]
        two, three = np.array([len(x[1]) for x in asked]), np.array([len(x[4]) for x in asked])
        u, v, n2, of, w, n3 = (np.concatenate(x) for x in zip(*asked))
        of = of + np.repeat(np.cumsum(two) - two, three)
        # Distinct n-grams of the shard, and which of them every requested one is.
        heads, head = np.unique(u, return_inverse=True)
        key2, at2 = np.unique((head.astype(np.uint64) << np.uint64(40)) | v, return_inverse=True)
        key3, at3 = np.unique((at2[of].astype(np.uint64) << np.uint64(40)) | w, return_inverse=True)
        low = np.uint64((1 << 40) - 1)
        u, v, of, w = heads[(key2 >> np.uint64(40)).astype(np.int64)], key2 & low, (key3 >> np.uint64(40)).astype(np.int64), key3 & low
        count, count3 = np.bincount(at2, n2, len(u)), np.bincount(at3, n3, len(w))
        total = np.bincount(np.searchsorted(heads, u), count, len(heads))[np.searchsorted(heads, u)]
        hot, totals, _ = shared.value
        if len(hot) and len(u):  # a spread word has only part of its bigrams here
            at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
            total = np.where(hot[at] == u, totals[at].astype(np.float64), total)
        seen, seen3 = np.flatnonzero(count), np.flatnonzero(count3)
        place = np.cumsum(count > 0) - 1
        trie = Trie(u[seen], v[seen], count[seen], total[seen], place[of[seen3]].astype(np.uint64), w[seen3], count3[seen3], mu, mu3)
        c2, back, c3 = trie.lookup(u, v, of, w)
        cut, cut3 = np.cumsum(two)[:-1], np.cumsum(three)[:-1]
        return pd.DataFrame({"shard": key[0], "batch": pdf["batch"], "a": [pack(c2[x]) for x in np.split(at2, cut)], "b": [pack(back[x]) for x in np.split(at2, cut)], "c": [pack(c3[x]) for x in np.split(at3, cut3)]})

    # A batch and what it learnt about its words meet in one shuffle, which serves the requests and the scores.
    fields = f"batch long, doc_ids array<{kind}>, held array<boolean>, lengths binary, tokens binary"
    packed = batches.select("batch", "doc_ids", "held", "lengths", "tokens", "hashes").mapInArrow(with_tags, f"{fields}, tags binary").withColumn("shard", F.lit(-1).cast("long"))
    met = packed.unionByName(words.filter("batch >= 0").select("batch", "shard", "a", "b"), allowMissingColumns=True).repartition("batch")
    asked = met.groupBy("batch").applyInPandas(ask_grams, "shard long, batch long, " + ", ".join(f"{k} binary" for k in _PARTS))
    answers = asked.groupBy("shard").applyInPandas(answer_grams, f"{shape}, c binary").withColumnRenamed("batch", "of")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, tokens, lengths, count, _, grams, shard = open_batch(left)
        answer = {s: tuple(map(unpack, codes)) for s, *codes in zip(right["shard"], right["a"], right["b"], right["c"])}
        c2, back, c3 = np.zeros(len(grams.u), np.int64), np.zeros(len(grams.u), np.int64), np.zeros(len(grams.w), np.int64)
        third = dict(_groups(shard[grams.of]))
        for s, g in _groups(shard):
            c2[g], back[g] = answer[s][:2]
            if s in third:
                c3[third[s]] = answer[s][2]
        uni = (count + 0.1) / (n_train + 0.1 * (n_known + 1))
        p = (_TABLE[c2] + mu / (count[grams.u] + mu) * uni[grams.v])[grams.two]
        at = grams.later
        p[at] = _TABLE[c3][grams.three] + _TABLE[back][grams.two[at - 1]] * p[at]
        starts = np.cumsum(lengths) - lengths
        add = lambda a: np.add.reduceat(a, starts)
        return pd.DataFrame({"doc_id": pd.Series(list(x["doc_ids"]), dtype=object), "held_out": list(x["held"]), "n_tokens": lengths, "n_known": add((count[tokens] > 0).astype(np.int64)), "train_tokens": n_train, "base_score": add(np.log10(uni)[tokens]), "score": add(np.log10(p))})

    return met.groupBy("batch").cogroup(answers.groupBy("of")).applyInPandas(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
