import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm.pii import _Words, base_spans, candidates, find_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [
    "a@b.c", "a@b", "@b.c x@y.z.w-. a@b@c.d e@f.g@h.i", "x..y@-.-", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.004 1.2.3 0.0.0.0000", "9" * 5000 + ".1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "49927398716000000 4111111111111111 4",
    "+1 (743) 555-3824 and +49 30.1234567) +1", "+1234567890 +123", "é😀 a.b@c.de 10.0.0.1", "", "a" * 3000 + "@x.y", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def test_base_patterns():
    for t in TEXTS:
        assert base_spans(t) == brute(t), t


def test_documents_and_digest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    kinds = ("email", "ip", "card", "phone")
    for r in docs.collect():
        want = brute(r.text)
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert set(joined.split(",")) <= set(g.spans.split(",")) and g.n_added == len([x for x in g.spans.split(",") if x]) - len(want)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"some words call me at number +1 202 555 01{i:02d} now") for i in range(9)]
    rows += [(20, "please call me at number 2025550199x today"), (21, "unrelated year 20240101 here"), (22, None), (23, "")]
    rows += [(24, "new ref 2025550199x again"), (24, "new ref 2025550199x again")]
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, spans string")
    got = find_pii(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[20].spans == "phone:25:36" and by[20].n_phone == 0 and by[24].n_added == 1
    assert by[21].spans == "" and by[22].spans == "" and by[0].n_phone == 1
    assert find_pii(docs.filter(F.lit(False))).count() == 0


def test_a_value_in_many_strong_patterns_is_found(spark):
    words = [f"{a}{b}line" for a in "abcde" for b in "abcd"]
    rows = [(100 * i + j, f"{w} number +1 202 555 {i:02d}{j:02d} now") for i, w in enumerate(words) for j in range(10)]
    rows += [(9000 + i, f"{w} number 2025550199x now") for i, w in enumerate(words)]
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[9000 + i] for i in range(len(words))] == ["phone:14:25"] * len(words)


def test_a_seed_is_added_outside_base_spans_in_confident_contexts(spark):
    rows = [(i, f"some words call me at number +1 202 555 01{i:02d} now") for i in range(10)]
    rows += [(20, "please call me at number 1-202-555-0101 today"), (21, "unrelated part code 1-202-555-0102 here")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20].spans == "phone:25:39" and got[20].n_phone == 0 and got[20].n_added == 1
    assert got[21].spans == "" and got[1].n_phone == 1 and got[1].n_added == 0


def test_candidates_are_whole_tokens():
    long = "x" * 5000
    found = lambda t: [t[a:b] for a, b in candidates(t, base_spans(t))]
    assert found(f"see {long}123{long} end") == [f"{long}123{long}"]
    assert found("call (743) 555 3824 or 12-34-56-78 or id7 ab@b, no 12") == ["743) 555 3824", "12-34-56-78", "ab@b"]
    assert found("http://x.y/page/1234567 ref 999") == ["http://x.y/page/1234567"]
    assert found("mail a.b@c.de 10.0.0.1") == [] and found("") == []
    assert found("1" * 9000 + "x " + "@" * 3000) == ["1" * 9000 + "x"]
    assert found("1 2 3 4 5 6 7x " * 5000) == [] and found("12 34 56 78 " * 3) == ["12 34 56 78 12 34 56 78 12 34 56 78"]
    words = _Words("one two " + long + " z")
    assert words.around(8 + 20) == (8, 8 + len(long)) and words.before(8 + 5000, 2) == ["two", words.before(8 + 5000, 1)[0]]
    assert _Words(long + " z").after(0) == _Words(long).after(0) != _Words(long[1:]).after(0)


def test_bootstrap_against_a_plain_graph(spark):
    """Three rounds over the graph of the whole test table, by dictionaries."""
    from collections import defaultdict
    from math import exp, log

    from tidemark.llm.pii import KINDS, occurrences

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + i, f"please reach us under line {i}: (743) 555 38{i:02d} today, or +1 202 555 01{i:02d} today") for i in range(20)]
    extra += [(11_000 + i, f"please reach us, or +49 30 12345{i:02d} today; ref 12-34-56-{i:02d} kept") for i in range(20)]
    extra += [(12_000 + i, f"we wrote, or 88-77-66-5{i} today and 88-77-66-5{i} again") for i in range(8)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = [(r.doc_id, o) for r in occurrences(docs).collect() for o in r.occ]
    values, open_, known, score = defaultdict(set), set(), {}, {}
    for _, o in rows:
        for c in o.contexts:
            values[c].add(o.value)
            if o.kind is None:
                open_.add((c, o.value))
        if o.kind is not None:
            known[o.value] = min(known.get(o.value, o.kind), o.kind)
    seeds = set(known)
    for _ in range(3):
        weight = defaultdict(float)
        for c, vs in values.items():
            for kind in KINDS:
                k = sum(known.get(v) == kind for v in vs)
                if k >= 3 and k / len(vs) >= 0.6:
                    for v in vs:
                        if (c, v) in open_ and v not in score:
                            weight[v, kind] -= log(1.0000001 - k / len(vs))
        fresh = {}
        for (v, kind), x in weight.items():
            if 1 - exp(-x) >= 0.6:
                fresh[v] = max(fresh.get(v, (0, "")), (x, kind))
        score |= fresh
        new = {v: kind for v, (_, kind) in fresh.items() if v not in seeds}
        known |= new
        if not new:
            break
    want = defaultdict(set)
    for d, o in rows:
        kind = o.kind or (score[o.value][1] if o.value in score else None)
        if kind:
            want[d].add(f"{kind}:{o.start}:{o.end}")
    got = {r.doc_id: {x for x in r.spans.split(",") if x} for r in find_pii(docs).collect()}
    assert got == {d: want[d] for d in got} and score


def test_very_long_texts_and_repeated_contexts(spark):
    rows = [(i, f"call line +1 202 555 01{i:02d} now") for i in range(9)] * 3 + [(99, "call line 5550199x now " * 4000)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].n_added == 4000 and got[99].n_phone == 0 and got[0].n_added == 0


def _plain_contexts(text, spans):
    """Words beside each span by splitting the whole text again for each of them."""
    from tidemark.llm.pii import _plain

    out = []
    for a, b in spans:
        words = [w for w in map(_plain, text[:a].split()[-4:]) if w]
        right = (text[b:].split(None, 1) or [""])[0] if words else ""
        right = _plain(right)
        out.append([" ".join(words[-n:]) for n in (1, 2) if len(words) >= n] + ([f"{words[-1]} _ {right}"] if right else []))
    return out


def test_contexts_are_those_of_a_split():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["ab", "É", "9", " ", "  ", "\n", "-", ".", "@", " ", "\x1c", "_"]) for _ in range(rng.randrange(60)))
        spans = sorted(tuple(sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))) for _ in range(6))
        assert _Words(text).contexts(spans) == _plain_contexts(text, spans)


def test_long_words_are_told_apart_by_their_digest():
    word = "x1" * 400
    text = f"{word} one {word}y two {word} three {word[:-1]}2 four -{word.upper()}- five"
    spans = [(text.index(n), text.index(n) + len(n)) for n in ("one", "two", "three", "four", "five")]
    last = [c[0] for c in _Words(text).contexts(spans)]
    assert last[0] == last[2] == last[4] and len({last[0], last[1], last[3]}) == 3


@pytest.mark.parametrize("unit", ["1{n:05d}@a.bc,", "10.0.0.{k},x", "id{n:06d};", "+4912345{n:05d},"])
def test_a_text_without_white_space_takes_linear_time(unit):
    def work(n):
        text = "".join(unit.format(n=i, k=i % 256) for i in range(n))
        began = time.process_time()
        base = base_spans(text)
        words = _Words(text)
        spans = sorted([(s, e) for s, _, e in base] + candidates(text, base, words))
        got = words.contexts(spans)
        return len(got), time.process_time() - began

    work(1000)
    (few, a), (many, b) = work(10_000), work(50_000)
    assert many >= few and b < 20 * max(a, 0.05)


def test_a_whole_unspaced_document(spark):
    text = "".join(f"user{i}@mail.org;" for i in range(3000)) + "contact:" + "9" * 5000
    got = find_pii(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_email for r in got} == {1: 3000, 2: 0}
