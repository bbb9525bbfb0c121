import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm.decontamination import contamination_report, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, names = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    names |= wins[x]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (10, "Short item"), (2, "short ITEM!"), (3, ""), (4, None), (None, "no name here"), (5, "é日本 x"), (1, "one two three four five six seven eight nine ten eleven twelve")]
DOCS = [
    (1, "ONE, two;three four five six seven eight nine ten. eleven"), (2, None), (3, ""), (4, "a short item b short item"), (5, "one two three"), (6, "no name here"), (7, "É日本 x"), (7, "é日本 x é日本 x"),
    (None, "x one two three four five six seven eight nine ten eleven twelve y"), (9, "nine ten eleven twelve one two three four five six"), (10, "short item " * 5000),
]


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 7) for d, t in DOCS], "doc_id long, text string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(contamination_report(docs, items)) == brute(DOCS, ITEMS)
    assert rows(contamination_report(docs, items, block_bytes=60)) == brute(DOCS, ITEMS)
    none = items.filter(F.lit(False))
    assert rows(contamination_report(docs, none)) == brute(DOCS, [])
    assert contamination_report(docs.filter(F.lit(False)), items).count() == 0


def test_documents_table(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    docs, items = read("documents"), read("benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(contamination_report(docs, items)) == want and any(w[-1] for w in want)


def test_removal(spark):
    docs = spark.createDataFrame(DOCS[:7], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [2, 3, 5, 7]
    cut = {r.doc_id: r.text for r in decontaminate(docs, items, remove="spans").collect()}
    assert cut[1] == "" and cut[6] == "" and cut[7] == "É日本 x"
    assert cut[4] == "a  b " and cut[5] == "one two three" and cut[2] is None
