"""Prefix trie: against plain Python and SQL, deep and turnless conversations, ties, hot groups."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm.entries import ORACLE_SQL, QUERIES
from tidemark.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_heads

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def name(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, name(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        rebuilt[c] = own.get(c - c % 5, [])[:h] + ts[h:] if rebuild else ts
    nodes = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(members) - 1) * len(key[-1][1].encode()) if key else 0
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie(spark, rows, rebuild=True, parts=3):
    turns = numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    turns = with_shared_heads(turns) if rebuild else turns.unionByName(turns.filter("depth = 1").selectExpr("conv_id", "0L as depth", "turn_name", "0L as n_bytes"))
    return sorted(map(tuple, prefix_trie(turns).collect()), key=lambda r: r[:2])


def some(seed, convs, most, words=("a", "b", "ü", "", None)):
    rng = random.Random(seed)
    return [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None, ""]), rng.choice(words)) for c in convs for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("rebuild", [True, False])
def test_against_plain_python(spark, rebuild):
    rows = some(1, [*range(0, 40), 1000, 1003, 7777], 6)
    rows += rows[:5] + [(None, 1, "user", "x"), (3, 1, "user", "tie"), (3, 1, "bot", "tie"), (62, 0, "user", "only turn, base absent"), (61, 5, "u", "x")]
    assert trie(spark, rows, rebuild) == plain(rows, rebuild)


def test_turnless_conversations(spark):
    lone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:6]
    rows = [(c, 0, "user", "gone") for c in lone]
    assert any(r[1] == 0 and r[3] == len(lone) for r in plain(rows))
    assert trie(spark, rows) == plain(rows)


def test_deep_conversations(spark):
    rng = random.Random(4)
    shared = [("user", rng.choice("abc") * 3) for _ in range(130)]
    rows = [(c, t, *x) for c, n in ((5, 130), (6, 100), (10, 64), (15, 63), (20, 65), (25, 1)) for t, x in enumerate(shared[:n])] + [(6, 200 + t, "bot", "other") for t in range(40)]
    assert trie(spark, rows) == plain(rows)


def test_one_conversation_and_one_group_of_copies_hold_most_rows(spark):
    rows = [(7, t, "user", f"t{t % 50}") for t in range(260)] + [(c, t, "user", "same") for c in range(100, 500, 5) for t in range(4)]
    turns = numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted((r.conv_id, r.depth) for r in turns.select("conv_id", "depth").collect()) == sorted((c, t + 1) for c, t, _, _ in rows)
    assert trie(spark, rows) == plain(rows)


def test_a_conversation_is_numbered_by_several_tasks(spark):
    from tidemark.llm import prefix_trie as module

    rows = [(7, t, "user", str(t)) for t in range(2000)]
    seen = []
    real = module.materialise
    try:
        module.materialise = lambda df, name: seen.append(name) or real(df, name)
        numbered = numbered_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        module.materialise = real
    assert sorted(r.depth for r in numbered) == list(range(1, 2001)) and seen == ["turns", "places"]
    order = {bytes(r.turn_name): r.depth for r in numbered}
    assert all(order[name("user", str(t))] == t + 1 for t in range(2000))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(with_shared_heads(numbered_turns(empty))).count() == 0
    rows = some(2, range(9), 4)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as node", "2 as h", "3 as place", "4 as part")
    assert sorted(map(tuple, prefix_trie(with_shared_heads(numbered_turns(clash))).collect()), key=lambda r: r[:2]) == plain(rows)


def test_query_against_sql_and_plain_python(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    got = QUERIES["op12_prefix_trie"](spark, SMALL)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op12_prefix_trie']})").fetchall()
    key = lambda r: r[:2]
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) == plain(rows)
