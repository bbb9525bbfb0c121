"""Byte-level BPE: the queue against the library, round trips and edge cases."""

import hashlib
import random
from heapq import heappush

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe
from tidemark.llm.byte_bpe import ByteBpe, ByteDecoder, RankQueue, decode_ids, encode_texts, read_ranks
from tidemark.llm.entries import QUERIES

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe(RANKS)


def as_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()


def hostile(n: int) -> list[str]:
    rng = random.Random(7)
    near = "abcaaeet  \n\t\r'sSrRtTvemll019,.<|>éüß中文  ー☃՘࢏\U0001f600ா­\u0000 "
    texts = ["".join(rng.choice(near) for _ in range(rng.randrange(60))) for _ in range(n)]
    far = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(chr(rng.choice(far)) for _ in range(30)) for _ in range(n // 4)]
    return texts + ["a" * k for k in (1, 2, 3, 7, 64, 255)] + ["<|endoftext|> x", " ", "   a", "'ll'LL", "�"]


def test_ids_are_those_of_the_library(own, library):
    texts = hostile(4000)
    got = own.encode_all(texts)
    assert [as_list(g) for g in got] == [library.encode_ordinary(t) for t in texts]
    decoder = ByteDecoder(RANKS)
    assert [decoder.decode(g) for g in got] == [t.encode() for t in texts]


def test_every_character_falls_into_the_class_of_the_library(own, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in chars if own.differs and own.differs.search(c)] + chars[::97]
    texts = [f"a{c}1{c}. {c}" for c in odd]
    assert [as_list(g) for g in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_very_long_pre_token(own, library):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghinorstu") for _ in range(300_000))
    assert as_list(own.encode(word)) == library.encode_ordinary(word)
    zeros = "0" * 200_000
    assert ByteDecoder(RANKS).decode(own.encode(zeros)) == zeros.encode()


def test_a_long_text_is_cut_only_between_pre_tokens(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "TEXT_PIECE", 50)
    own = ByteBpe(RANKS)
    texts = [" ".join(hostile(40)[i:]) for i in range(20)]
    assert [as_list(g) for g in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "KNOWN_PIECES", 40)
    own = ByteBpe(RANKS)
    texts = hostile(300)
    for i in range(0, len(texts), 10):
        assert [as_list(g) for g in own.encode_all(texts[i : i + 10])] == [library.encode_ordinary(t) for t in texts[i : i + 10]]
    assert own.encode("again again") == own.encode("again again")
    assert len(own.known) < 1000


def test_a_lower_rank_that_comes_up_goes_first():
    """Ranks in which a merge makes a pair of a lower rank than its own: order must be by rank, then from the left."""
    rng = random.Random(5)
    for trial in range(200):
        ranks = {bytes([i]): i for i in range(256)}
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(25)}
        for i, w in enumerate(rng.sample(sorted(words), len(words))):
            ranks[w] = 256 + i
        own = ByteBpe.__new__(ByteBpe)
        own.ranks, own.queue = ranks, RankQueue(max(ranks.values()) + 1)
        own.byte = np.arange(256, dtype=np.int32)
        own.first = np.full((256, 256), -1, dtype=np.int32)
        own.pairs = {}
        for w, r in ranks.items():
            for c in range(1, len(w)):
                if w[:c] in ranks and w[c:] in ranks:
                    own.pairs[ranks[w[:c]] << 16 | ranks[w[c:]]] = r
            if len(w) == 2:
                own.first[w[0], w[1]] = r
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
        for raw, got in zip(texts, own.merge(texts)):
            parts = [bytes([b]) for b in raw]
            while True:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert as_list(got) == [ranks[p] for p in parts], (trial, raw)


def test_queue_takes_the_lowest_rank():
    queue, rng = RankQueue(2000), random.Random(1)
    waiting: dict[int, list[int]] = {}
    for step in range(3000):
        if rng.random() < 0.6:
            rank = rng.randrange(2000)
            if rank in waiting:
                heappush(queue.buckets[rank], step)
            else:
                queue.put(rank, [step])
            waiting.setdefault(rank, []).append(step)
        elif waiting:
            low = min(waiting)
            assert queue.take() == (low, waiting.pop(low))
    while waiting:
        low = min(waiting)
        assert queue.take() == (low, waiting.pop(low))
    assert queue.take() is None


def test_rows_nulls_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "the cat", "z"), (3, "the cat", "z"), (None, "naïve", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = decode_ids(encode_texts(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in got) == sorted((i or 0, len(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert got[0].__fields__ == ["doc_id", "n_tokens", "ids", "decoded"]
    empty = decode_ids(encode_texts(docs.limit(0), RANKS), RANKS)
    assert empty.count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert decode_ids(nulls, RANKS).first().decoded is None


def test_unknown_ids_raise():
    with pytest.raises(ValueError):
        ByteDecoder(RANKS).decode((60_000).to_bytes(4, "little"))


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op11_byte_bpe"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
