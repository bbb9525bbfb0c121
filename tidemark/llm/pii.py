"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Base spans come from four patterns (email, ip, card, phone) with checks. They are also the seeds: the
words beside each seed (one or two on the left, one on either side) are lexical patterns, and tokens that
look like identifiers stand beside the same patterns: those with three digits in a row or an @, and
groups of seven digits or more with single signs or spaces between. Spark holds this as a graph of distinct (pattern, value) edges and scores it in
rounds: a pattern's confidence in a kind is the share of known values of that kind among all its
values; a value's score is the noisy-or of its confident patterns; values above a limit become known
and support patterns in the next round. Every occurrence of a value found so is an added span. A seed's
value is found so too if it stands outside base spans beside confident patterns.

Defined results: null or empty texts have no spans; repeated rows stay; an empty table gives none;
other columns are dropped. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import blocks
from tidemark.llm.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE, ROUNDS = 3, 0.6, 0.6, 3
#: Letters and digits of a word that is kept as it stands; a longer one is known by its digest.
SHORT = 64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match cannot start inside a run of digits that has failed as a whole, so each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]{3,}|@")
_GROUPS = re.compile(r"(?<![\w.,/-])\(?[0-9]++(?:[)./-]{0,2}\x20?[(./-]?[0-9]++)++")
_NOT_WORD = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"\S+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every base match, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 3 or len(p) == 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _plain(word: str) -> str:
    return _NOT_WORD.sub("", word).lower()


class _Words:
    """White-space tokens of a text and the words beside a place; each token is read once, however many places it holds.

    A word of more than SHORT letters and digits is named by its digest. Digests of what stands before the places
    of one long token grow from left to right, those of what stands after them from right to left.
    """

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = [], []
        for m in _TOKEN.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.grown: dict[tuple[int, bool], tuple[int, int, object]] = {}

    def around(self, at: int) -> tuple[int, int]:
        """The token that holds the character at `at`."""
        i = bisect_right(self.starts, at) - 1
        return self.starts[i], self.ends[i]

    def _word(self, token: int, a: int, b: int, back: bool) -> str:
        if b - a <= 4 * SHORT:
            plain = _plain(self.text[a:b])
            if len(plain) <= SHORT:
                return plain
        at, n, state = self.grown.get((token, back), (self.ends[token] if back else self.starts[token], 0, hashlib.sha256()))
        piece = _NOT_WORD.sub("", self.text[a:at] if back else self.text[at:b]).casefold()
        state.update((piece[::-1] if back else piece).encode("utf-8", "surrogatepass"))
        n += len(piece)
        self.grown[token, back] = (a if back else b, n, state)
        return _plain(self.text[a:b]) if n <= SHORT else f"{n}:{state.hexdigest()}"

    def before(self, at: int, n: int) -> list[str]:
        """The last n tokens that begin before `at`, cut there; ask in ascending order."""
        last = bisect_left(self.starts, at)
        return [self._word(i, self.starts[i], min(self.ends[i], at), False) for i in range(max(0, last - n), last)]

    def after(self, at: int) -> str:
        """The first token that ends after `at`, from there on; ask in descending order."""
        i = bisect_right(self.ends, at)
        return self._word(i, max(at, self.starts[i]), self.ends[i], True) if i < len(self.starts) else ""

    def contexts(self, spans: list[tuple[int, int]]) -> list[list[str]]:
        """Of each span: the last word, the last two words before it, and the words on either side."""
        left: dict[int, list[str]] = {a: [w for w in self.before(a, 4) if w] for a in sorted({a for a, _ in spans})}
        right = {b: self.after(b) for b in sorted({b for a, b in spans if left[a]}, reverse=True)}
        out = []
        for a, b in spans:
            words = left[a]
            found = [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]
            out.append(found + ([f"{words[-1]} _ {right[b]}"] if words and right[b] else []))
        return out


def _value(text: str) -> str:
    plain = _NOT_WORD.sub("", text).lower()
    return plain if len(plain) <= SHORT else hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()


def candidates(text: str, base: list[tuple[int, int, int]], words: _Words | None = None) -> list[tuple[int, int]]:
    """Groups of digits, and white-space tokens with three digits in a row or an @, outside base spans."""
    found, last = [m.span() for m in _GROUPS.finditer(text) if sum(c.isdigit() for c in m.group()) >= 7 and not text[m.end() : m.end() + 1].isalnum()], 0
    words = words or _Words(text)
    groups = iter([*found, (len(text) + 1, len(text) + 1)])
    group = next(groups)
    for m in _TRIGGER.finditer(text):
        while group[1] <= m.start():
            group = next(groups)
        if m.start() < last or group[0] < m.end():
            continue
        a, b = words.around(m.start())
        last = b
        found.append((a, b))
    out, k, taken = [], 0, sorted((s, e) for s, _, e in base)
    for a, b in sorted(found):
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= 4 and not any(s < b and a < e for s, e in taken[k : k + 4]) and not (out and a < out[-1][1]):
            out.append((a, b))
    return out


_OCCURRENCE = "struct<start:long,end:long,kind:string,value:string,contexts:array<string>>"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, digest and spans of the base, and all occurrences with contexts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            found = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                words = _Words(text)
                seen = [(s, e, KINDS[k]) for s, k, e in base] + [(a, b, None) for a, b in candidates(text, base, words)]
                contexts = words.contexts([(a, b) for a, b, _ in seen])
                occ = [{"start": a, "end": b, "kind": k, "value": _value(text[a:b]), "contexts": c} for (a, b, k), c in zip(seen, contexts)]
                row = {f"n_{k}": sum(x[1] == i for x in base) for i, k in enumerate(KINDS)}
                found.append(row | {"base_sha256": hashlib.sha256(joined.encode()).hexdigest(), "occ": occ})
            occ_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))]))
            types = [pa.int64()] * 4 + [pa.string(), occ_type]
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "occ"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in found], t) for n, t in zip(names, types))], names=["doc_id", *names])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, occ array<{_OCCURRENCE}>")


def bootstrap(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """(value, kind, score) of values found outside base spans. edges: distinct (pattern, value) and whether it is open, seen outside a base span; seeds: (value, kind)."""
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = seeds.select("value", "kind")
    found = None
    for n in range(rounds):
        votes = edges.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("k"))
        good = votes.filter(F.col("k") >= min_support).join(sizes, "pattern").withColumn("confidence", F.col("k") / F.col("n")).filter(F.col("confidence") >= min_confidence)
        reached = edges.filter("open").join(good.select("pattern", "kind", "confidence"), "pattern")
        if found is not None:
            reached = reached.join(found.select("value"), "value", "left_anti")
        # The score rounds to 1 for many patterns; the sum of logarithms still tells kinds apart.
        scored = reached.groupBy("value", "kind").agg((-F.sum(F.log(1.0000001 - F.col("confidence")))).alias("weight")).withColumn("score", 1 - F.exp(-F.col("weight"))).filter(F.col("score") >= min_score)
        best = scored.groupBy("value").agg(F.max_by("kind", F.struct("weight", "kind")).alias("kind"), F.max("score").alias("score"))
        fresh = materialise(best.join(seeds.select("value", F.lit(True).alias("seed")), "value", "left"), f"round{n}")
        found = fresh if found is None else found.unionByName(fresh)
        new = fresh.filter("seed is null").select("value", "kind")  # a seed keeps its own kind as support
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return found.select("value", "kind", "score") if found is not None else seeds.select("value", "kind", F.lit(1.0).alias("score")).limit(0)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document."""
    rows = materialise(occurrences(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "occurrences")
    seen = rows.select("row", F.explode("occ").alias("o")).select("row", "o.*")
    beside = seen.select(F.explode("contexts").alias("pattern"), "value", F.col("kind").isNull().alias("open"))
    edges = materialise(beside.groupBy("pattern", "value").agg(F.max("open").alias("open")), "edges")
    seeds = seen.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("kind"))
    added = bootstrap(edges, seeds, **options).select("value", F.col("kind").alias("found"))
    more = seen.filter("kind is null").join(added, "value").groupBy("row").agg(F.collect_list(F.struct("start", "end", F.col("found").alias("kind"))).alias("more"))
    spans = F.concat(
        F.transform(F.filter("occ", lambda o: o["kind"].isNotNull()), lambda o: F.struct(o["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), o["kind"]).alias("k"), o["end"].alias("end"))),
        F.transform(F.coalesce("more", F.expr("cast(array() as array<struct<start:long,end:long,kind:string>>)")), lambda o: F.struct(o["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), o["kind"]).alias("k"), o["end"].alias("end"))),
    )
    names = F.array(*map(F.lit, KINDS))
    joined = F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"].cast("int")), s["start"], s["end"])), ",")
    out = rows.join(more, "row", "left")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", joined.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"))
