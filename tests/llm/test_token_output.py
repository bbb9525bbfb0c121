import heapq
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.token_output import BLOCK_TOKENS, Code, ChunkEncoder, code_lengths, encode_documents, read_tokens

PATH = P.path("word_bpe_49k.json")
ODD = [None, "", "  ", "a", "Hello, World's  end.\n\nTab\tx", "É é ÀÇ Σς", "x<|endoftext|>y <|startoftext|>", "a\x1cb\x85c d", "日本語 🎉 12345 don't", "word " * 3000]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_encoder_matches_library():
    ids, n = ChunkEncoder(PATH).encode(pa.array(ODD), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library(ODD)


def test_tokenizers_that_keep_white_space_are_given_whole_texts(spark):
    path, texts = P.path("byte_bpe_50k.json"), ["hello world  two", " a\n b\t", "", "x<|endoftext|>y z", "caf\u00e9 \u65e5\u672c 12"]
    encoder, t = ChunkEncoder(path), Tokenizer.from_file(path)
    assert ChunkEncoder(PATH).cuts and not encoder.cuts
    ids, n = encoder.encode(pa.array(texts), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read_tokens(spark, encode_documents(docs, path), with_ids=True).collect()}
    assert [got[i] for i in range(len(texts))] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_chunks_that_hold_the_mark_and_many_chunks():
    texts = ["\x01", "a\x01b \x01 \x01\x01.", " ".join(f"w{i}x" for i in range(3000)), "\x01 end"]
    ids, n = ChunkEncoder(PATH).encode(pa.array(texts), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library(texts)


def huffman_cost(w):
    h, total = list(map(int, w)), 0
    heapq.heapify(h)
    while len(h) > 1:
        a = heapq.heappop(h) + heapq.heappop(h)
        total += a
        heapq.heappush(h, a)
    return total


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 10_000, 500)
    lengths = code_lengths(w, 16)
    assert (lengths * w).sum() == huffman_cost(w)
    fib = np.array([1, 1, *np.cumsum(np.ones(1, int))], dtype=np.int64)
    while len(fib) < 40:
        fib = np.append(fib, fib[-1] + fib[-2])
    lengths = code_lengths(fib, 16)
    assert lengths.max() <= 16 and abs(np.sum(2.0 ** -lengths) - 1) < 1e-12
    assert code_lengths(np.array([5])).tolist() == [1] and code_lengths(np.array([], dtype=np.int64)).tolist() == []


def test_round_trip_of_codes():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.01, 5000), 900)
    u, c = np.unique(ids, return_counts=True)
    code = Code(u, code_lengths(c))
    for n in (1, 127, 128, 129, 5000):
        assert code.decode(*code.encode(ids[:n]), n).tolist() == ids[:n].tolist()


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = encode_documents(docs.repartition(3), PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, path).collect())
    enc = [(d is not None, d or 0, d, zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for (d, _, _), x in zip(rows, library([r[1] for r in rows]))]
    want, at = [], 0
    for _, _, d, crc, n in sorted(enc, key=lambda e: (e[0], e[1], e[3], e[4])):
        want.append((at, d, n, crc))
        at += n
    assert got == want


def test_files_against_brute_force(spark):
    check(spark, [(i * 7 % 11, t, 0) for i, t in enumerate(ODD)])
    check(spark, [(5, "same", 0), (5, "same", 1), (5, "other", 1), (None, "x", 2), (None, None, 2)])
    check(spark, [])


def test_a_document_above_a_block(spark):
    check(spark, [(2, "a b " * (BLOCK_TOKENS // 2 + 5), 0), (1, "c", 0), (3, "d e", 0)])


def test_documents(spark):
    rows = [(r.doc_id, r.text, 0) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)
