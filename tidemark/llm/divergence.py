"""Source divergence audit: how far each source's words lie from those of its language and of other sources.

Texts become terms inside Arrow: ascii_lower, split_pattern_regex, dictionary_encode and hash group_by make
partial counts, which Spark sums by (lang, term). A language keeps the terms of at least `min_docs` of its
documents. One row a (lang, term) then holds its sources and counts side by side; rows are dealt to shards
by a hash of both, so a dominant language or source spreads over all shards. A shard turns its rows into a
dense count matrix, some terms at a time, and adds up what they give to every pair of sources. Languages of
more than TILE sources are cut into squares of TILE by TILE pairs, which bounds what a task holds.

Shares are integers: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), with N the group's occurrences of the V
kept terms; a term gives a pair floor((p - q)^2 / (p + q)). Both are exact below 9e15 occurrences.

Defined results: null text, lang and source count as ''. A group without terms still takes part; a lang with
no kept term gives its pairs 0 and no term rows. Rows are counted one for one, repeated rows too; equal values
rank by UTF-8 order of the item. Other columns of the input are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import blocks
from tidemark.llm.scratch import materialise

#: What separates terms, as an RE2 pattern over lower-cased text.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct (lang, source, term) rows that a task gathers before it gives them to the shuffle.
PARTIAL_ROWS = 400_000
#: Cells of a shard's dense count matrix, and sources on a side of a square of pairs.
CELLS, TILE = 1 << 18, 1024
#: Rows of the term table in a shard, about.
SHARD_ROWS = 100_000


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one block of (lang, source, text) rows."""
    lang, source, text = batch.columns
    split = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATORS)
    words, row = pc.list_flatten(split), pc.list_parent_indices(split)
    there = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(pc.filter(words, there))
    in_docs = pa.table({"row": pc.filter(row, there), "term": coded.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    at, langs, sources = in_docs["row"], pc.dictionary_encode(lang), pc.dictionary_encode(source)
    sums = pa.table({"lang": pc.take(langs.indices, at), "source": pc.take(sources.indices, at), "term": in_docs["term"], "n": in_docs["count_all"]})
    sums = sums.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    names = [pc.take(d, sums[k]) for k, d in (("lang", langs.dictionary), ("source", sources.dictionary), ("term", coded.dictionary))]
    return pa.table([*names, sums["n_sum"], sums["n_count"]], names=["lang", "source", "term", "n", "docs"])


def _merged(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in blocks(batches, 2):
        held.append(_counted(batch))
        if sum(map(len, held)) >= PARTIAL_ROWS:
            held = [_merged(held)]
            if len(held[0]) >= PARTIAL_ROWS // 2:
                yield from held.pop().combine_chunks().to_batches(max_chunksize=50_000)
    if held:
        yield from _merged(held).combine_chunks().to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, n, counts): the kept terms of each lang, their occurrences, and those of each source that has any."""
    sums = docs.mapInArrow(_partial, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    by_source = sums.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # No term has more entries than its lang has sources, so the list is bounded; both sums need one exchange.
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_term.filter(F.col("docs") >= min_docs).select("lang", "term", "n", "counts")


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * n / total) for 0 <= n <= total, by long division in three digits of a thousand."""
    out, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


class _Square:
    """The sums of one lang's sources of tile a against those of tile b."""

    def __init__(self, lang: str, names: list[str], totals: np.ndarray, kept: int, a: int, b: int, tile: int):
        self.lang, self.names, self.kept, self.alone, self.seen = lang, pa.array(names, pa.string()), kept, False, False
        self.lang_total, self.totals = int(totals.sum()), totals
        self.rows, self.cols = slice(a * tile, min(len(names), (a + 1) * tile)), slice(b * tile, min(len(names), (b + 1) * tile))
        self.own = a == b
        self.sums = np.zeros((self.rows.stop - self.rows.start, self.cols.stop - self.cols.start), dtype=np.int64)
        self.best: dict[int, tuple[np.ndarray, pa.Array]] = {}

    def _shares(self, part: slice, row: np.ndarray, source: np.ndarray, n: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros((part.stop - part.start, terms), dtype=np.int64)
        mine = (source >= part.start) & (source < part.stop)
        counts[source[mine] - part.start, row[mine]] = n[mine]
        return counts, share(counts + 2, (self.totals[part] + 2 * self.kept)[:, None])

    def add(self, terms: pa.Array, n: np.ndarray, row: np.ndarray, names: pa.Array, counts: np.ndarray, top: int) -> None:
        """Terms in ascending order, their counts in the lang, and (row, source, count) of every source that has them."""
        self.seen = True
        source = pc.index_in(names, self.names).to_numpy(zero_copy_only=False).astype(np.int64)
        had, p = self._shares(self.rows, row, source, counts, len(terms))
        q = p if self.own else self._shares(self.cols, row, source, counts, len(terms))[1]
        for i, line in enumerate(p):
            first = i + 1 if self.own else 0  # a square on the diagonal is symmetric
            far = q[first:] - line
            self.sums[i, first:] += (far * far // (q[first:] + line)).sum(axis=1)
        if self.own:
            whole = share(n + 2, self.lang_total + 2 * self.kept)
            far = p - whole
            value = np.where((had > 0) & (far > 0), far * far // (p + whole), -1)
            for i, at in enumerate(np.argsort(-value, axis=1, kind="stable")[:, :top]):
                at = at[value[i, at] >= 0]
                if len(at):
                    old, names_ = self.best.get(i, (np.zeros(0, dtype=np.int64), pa.array([], pa.string())))
                    values, items = np.r_[old, value[i, at]], pa.concat_arrays([names_, pc.take(terms, pa.array(at))])
                    keep = np.argsort(-values, kind="stable")[:top]  # earlier terms come first among equals
                    self.best[i] = values[keep], pc.take(items, pa.array(keep))

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.seen or self.alone:
            sums = self.sums + self.sums.T if self.own else self.sums
            a, b = np.indices(sums.shape).reshape(2, -1)
            a, b, value = a + self.rows.start, b + self.cols.start, sums.ravel()
            other = a != b
            yield self._batch("pair", a[other], pc.take(self.names, pa.array(b[other])), value[other])
            if not self.own:
                yield self._batch("pair", b, pc.take(self.names, pa.array(a)), value)
        for i, (value, items) in self.best.items():
            yield self._batch("term", np.full(len(value), i + self.rows.start), items, value)

    def _batch(self, part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        size = len(value)
        columns = [pa.array([self.lang] * size, pa.string()), pc.take(self.names, pa.array(source)), pa.array([part] * size, pa.string()), item, pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])


def _diverge(top: int, tile: int, cells: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by lang, square and term: a square's head (term null) comes before its terms.
        square = None
        for batch in batches:
            term, counts = batch.column(3), batch.column(5)
            lists = np.asarray(counts.offsets)
            flat = counts.values
            names, n = flat.field("source"), flat.field("n").to_numpy(zero_copy_only=False)
            total = batch.column(4).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(term.is_null().to_numpy(zero_copy_only=False))
            for start, end in zip(np.r_[0, heads], np.r_[heads, batch.num_rows]):
                if start in heads:
                    lang, a, b = (batch.column(i)[int(start)].as_py() for i in range(3))
                    if square is None or (lang, a, b) != key:  # two shards can share a partition
                        if square is not None:
                            yield from square.result()
                        key = (lang, a, b)
                        inside = slice(lists[start], lists[start + 1])
                        square = _Square(lang, names[inside.start : inside.stop].to_pylist(), n[inside], int(total[start]), a, b, tile)
                    square.alone |= batch.column(6)[int(start)].as_py()
                    start += 1
                step = max(1, cells // max(1, square.sums.shape[1]))
                for at in range(start, end, step):
                    to = min(end, at + step)
                    row = np.repeat(np.arange(to - at), np.diff(lists[at : to + 1]))
                    square.add(term[at:to], total[at:to], row, names[lists[at] : lists[to]], n[lists[at] : lists[to]], top)
        if square is not None:
            yield from square.result()

    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, tile: int = TILE, cells: int = CELLS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part pair against every other source of the lang, part term the `top` terms that mark a source.

    tile: sources on a side of a square of pairs; cells: of a dense count matrix. Neither changes the result.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    terms = materialise(term_counts(rows, min_docs), "terms")
    counted = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").fillna(0, "n")
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    heads = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts")).join(kept, "lang", "left")
    heads = materialise(heads.select("lang", F.coalesce("kept", F.lit(0)).cast("long").alias("n"), "counts", F.ceil(F.size("counts") / tile).cast("int").alias("tiles")), "heads")

    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-terms.count() // SHARD_ROWS))
    squares = heads.withColumn("a", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("b", F.explode(F.expr("sequence(a, tiles - 1)")))
    first = squares.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("lang", "a", "b", F.lit(None).cast("string").alias("term"), "n", "counts", (F.col("shard") == 0).alias("alone"), "shard")
    rest = terms.join(squares.select("lang", "a", "b"), "lang").select("lang", "a", "b", "term", "n", "counts", F.lit(False).alias("alone"), F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"))
    dealt = first.unionByName(rest).repartition(shards, "shard").sortWithinPartitions("lang", "a", "b", F.col("term").asc_nulls_first())
    sums = dealt.drop("shard").mapInArrow(_diverge(top, tile, cells), "lang string, source string, part string, item string, value long")

    total = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = total.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle(min_docs: int = 10, top: int = 10) -> str:
    """The same audit as DuckDB SQL over documents."""
    share = "1 + (1000000000::hugeint * ({n} + 2)) // ({total} + 2 * v)"
    value = "((p - q) * (p - q)) // (p + q)"
    return f"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words
  from documents),
words as (select row, lang, source, unnest(words) as term from docs),
kept as (select lang, term, count(*) as lang_n from words group by lang, term having count(distinct row) >= {min_docs}),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by lang, source, term),
cells as (select g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) as n from groups g join kept k using (lang) left join counts c using (lang, source, term)),
sizes as (select lang, source, term, n, lang_n, sum(n) over (partition by lang, source) as total, sum(lang_n) over (partition by lang, source) as lang_total, count(*) over (partition by lang, source) as v from cells),
shares as (select lang, source, term, n, {share.format(n="n", total="total")} as p, {share.format(n="lang_n", total="lang_total")} as whole from sizes),
pairs as (
  select g.lang, g.source, 'pair' as part, o.source as item, coalesce(any_value(s.value), 0) as value
  from groups g join groups o on o.lang = g.lang and o.source <> g.source
  left join (select a.lang, a.source, b.source as item, sum({value.replace("p", "a.p").replace("q", "b.p")}) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source) s
  on s.lang = g.lang and s.source = g.source and s.item = o.source
  group by g.lang, g.source, o.source),
terms as (select lang, source, 'term' as part, term as item, {value.replace("q", "whole")} as value from shares where n > 0 and p > whole),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {top}
"""
