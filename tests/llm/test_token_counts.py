import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.token_counts import TokenCounter, count_tokens

PATH = P.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "don't we'll", "aaaa aaaaa aaaaaaaaaaaaaaaaa", "日本語 テキスト é é", "x<|endoftext|>y", "<|endoftext|>",
    "a <|endoftext|> b<|endoftext|><|endoftext|>", "tab\tand\x1cseparators\x85 there", "<|endof", "12345 67 8", "!!!! ??? ...\n\n\n  end", "🎉🎉🎉 a🎉",
]


def brute(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_matches_library_on_odd_texts():
    assert TokenCounter(PATH).count(ODD).tolist() == brute(ODD)


def test_matches_library_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs, PATH).collect()}
    rows = docs.collect()
    want = brute([r.text for r in rows])
    assert len(got) == len(rows)
    for r, n in zip(rows, want):
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit, got[r.doc_id].n_bytes) == (n, n > 512, len(r.text.encode()))


def test_empty_table_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (None, "a b", 6)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(docs, PATH).collect())
    assert got == [(0, 2), (0, 2), (1, 0)]
    assert count_tokens(docs.filter(F.lit(False)), PATH).count() == 0
