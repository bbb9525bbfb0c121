"""Prefix trie of conversations by van Emde Boas recursion: every depth range is cut at its half.

A prefix of depth d is named by the prefix at the start of its block, depth d - s with s the lowest bit of d,
and by the block of s turns after it. Blocks get their names from pairs of half blocks (names go up), prefixes
get theirs by cutting every open block in half (names go down), and subtree totals are grafted from the roots
of lower forests onto all upper nodes above them (totals go up again). Each step treats all blocks of one
size at once, so there are about log2(longest conversation) steps, and rows are (conversation, depth): no
conversation, node or group is ever held in one row or one worker.

Names are 128 bits of SHA-256: 10^12 different prefixes share one with odds of about 10^-15. A node is given by
its depth and its smallest member.

Defined results: rows with a null conv_id take no part. Turns go by turn (null first); equal turns by the
digest of role and text, repeated rows stay repeated turns. Null role or text counts as ''. Other columns are
dropped. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise

#: Member ids that one row of the shuffle before hashing carries at most.
RUN_IDS = 1 << 16


def _digest(raw: Column) -> Column:
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def _runs(column: pa.Array) -> np.ndarray:
    """Where each run of equal values starts, in a column without nulls."""
    if len(column) == 0:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)])


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the place of each row among the task's rows of its conversation, which are sorted."""
    part, last, used = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, starts = batch.column(0), _runs(batch.column(0))
        place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows])) + 1
        if ids[0].as_py() == last:
            place[: starts[1] if len(starts) > 1 else None] += used
        last, used = ids[-1].as_py(), int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array([part] * batch.num_rows, pa.int32())], names=[*batch.schema.names, "place", "part"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, turn_name, n_bytes): the turns of each conversation in order.

    Rows are dealt by ranges of (conv_id, turn), so a conversation with most of the rows lies in many tasks; a
    task counts on from where the tasks before it left its first conversation.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turn = _digest(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", turn.alias("turn_name"), F.octet_length(text("text")).cast("long").alias("n_bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "turn_name"]
    named = materialise(rows, "turns")  # ranges are sampled: texts are read and digested once
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_name", "n_bytes")
    local = materialise(dealt.mapInArrow(_number, "conv_id long, turn_name binary, n_bytes long, place long, part int"), "places")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = local.groupBy("conv_id", "part").agg(F.max("place").alias("rows")).withColumn("skip", F.sum("rows").over(before)).filter("skip > 0")
    # One conversation a task at most goes on from the task before: no more rows than tasks.
    whole = local.join(F.broadcast(spans.select("conv_id", "part", "skip")), ["conv_id", "part"], "left")
    return whole.select("conv_id", (F.col("place") + F.coalesce("skip", F.lit(0))).alias("depth"), "turn_name", "n_bytes")


def with_shared_heads(turns: DataFrame, family: int = 5, lengths: int = 9) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % family; h = crc32(c) % lengths.

    turns as numbered_turns() gives them; the result has a row of depth 0 for each conversation besides, as a
    rebuilt one may have no turns.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % family, F.crc32(F.col("conv_id").cast("string")) % lengths
    turns = materialise(turns.withColumn("h", h).withColumn("base", base), "numbered")
    own = F.col("conv_id") == F.col("base")
    ids = turns.filter("depth = 1").select("conv_id", "base", "h")
    heads = turns.filter(own & (F.col("depth") < lengths)).select("base", "depth", "turn_name", "n_bytes")
    taken = ids.filter(~own).join(heads, "base").filter("depth <= h").select("conv_id", "depth", "turn_name", "n_bytes")
    size = heads.groupBy("base").agg(F.max("depth").alias("size"))
    shift = ids.filter(~own).join(size, "base", "left").select("conv_id", (F.least("h", F.coalesce("size", F.lit(0))) - F.col("h")).alias("shift"))
    rest = turns.filter(~own & (F.col("depth") > F.col("h"))).join(shift, "conv_id").select("conv_id", (F.col("depth") + F.col("shift")).alias("depth"), "turn_name", "n_bytes")
    kept = turns.filter(own).select("conv_id", "depth", "turn_name", "n_bytes")
    return kept.unionByName(taken).unionByName(rest).unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("turn_name"), F.lit(0).cast("long").alias("n_bytes")))


def _prefix_names(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, depth, name, n_bytes) of every prefix, n_bytes being its last turn's, and the number of halvings."""
    longest = turns.agg(F.max("depth")).first()[0] or 0
    levels = int(longest).bit_length()
    blocks = [turns.filter("depth > 0").select("conv_id", (F.col("depth") - 1).alias("at"), F.col("turn_name").alias("name"), "n_bytes")]
    for k in range(1, levels):  # names of blocks of 2^k turns, from their halves
        half = F.struct("at", "name", "n_bytes")
        pair = blocks[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(F.count("*").alias("n"), F.min(half).alias("a"), F.max(half).alias("b")).filter("n = 2")
        blocks.append(materialise(pair.select("conv_id", "at", _digest(F.concat("a.name", "b.name")).alias("name"), "b.n_bytes"), f"blocks{k}"))
    open_ = turns.filter("depth = 0").select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("name"), F.lit(0).cast("long").alias("n_bytes"))
    for k in reversed(range(levels)):  # cut every open block at its half; where the upper half is full, a lower one opens
        upper = blocks[k].filter("at % 2 = 0").select("conv_id", F.shiftright("at", 1).alias("at"), F.col("name").alias("block"), F.col("n_bytes").alias("last"))
        here = F.struct((F.col("at") * 2).alias("at"), "name", "n_bytes")
        lower = F.struct((F.col("at") * 2 + 1).alias("at"), _digest(F.concat("name", "block")).alias("name"), F.col("last").alias("n_bytes"))
        cut = open_.join(upper, ["conv_id", "at"], "left")
        open_ = cut.select("conv_id", F.inline(F.when(F.col("block").isNull(), F.array(here)).otherwise(F.array(here, lower))))
    return open_.withColumnRenamed("at", "depth"), levels


def _graft(totals: DataFrame, path: DataFrame, levels: int) -> DataFrame:
    """Subtree sums of leaves and saved from each node's own values.

    At step k a node holds the sums of its subtree inside its block of 2^k depths. The roots of lower blocks
    give theirs to every node above them in the upper block, at most 2^k, and the two blocks become one.
    """
    for k in range(levels):
        s = 1 << k
        roots = totals.filter(F.col("depth") % (2 * s) == s).select(F.col("node").alias("conv_id"), (F.shiftright("depth", k) - 1).alias("block"), "leaves", "saved")
        above = path.filter(F.shiftright("depth", k) % 2 == 0).select("conv_id", F.shiftright("depth", k).alias("block"), "depth", "node")
        given = roots.join(above, ["conv_id", "block"]).select("depth", "node", "leaves", "saved")
        totals = totals.unionByName(given).groupBy("depth", "node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        totals = materialise(totals, f"totals{k}")
    return totals


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, conv_id) to (depth, node, first, ids): comma-joined ids of runs of one node."""
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_IDS):
            part = batch.slice(at, RUN_IDS)
            starts = np.union1d(_runs(part.column(0)), _runs(part.column(1)))
            ids = pa.ListArray.from_arrays(pa.array(np.r_[starts, part.num_rows], pa.int32()), pc.cast(part.column(2), pa.string()))
            first = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(pc.take(part.column(i), first) for i in range(3)), pc.binary_join(ids, ",")], names=["depth", "node", "first", "ids"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, first, ids) to (depth, node, ends_sha256); only the hash of the open node is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for depth, node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (depth, node) == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((*key, state.hexdigest()))
            key, state = (depth, node), hashlib.sha256(ids.encode())
        yield _hash_rows(out)
    if state is not None:
        yield _hash_rows([(*key, state.hexdigest())])


def _hash_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, node, sha = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(sha, pa.string())], names=["depth", "node", "ends_sha256"])


def _ends(path: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of the nodes where conversations end; ids go by ranges, so a common end is joined in many tasks."""
    last = path.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("end")).select("end.depth", "end.node", "conv_id")
    dealt = materialise(last, "ends").repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    runs = dealt.mapInArrow(_joined, "depth long, node long, first long, ids string")
    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_hashed, "depth long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, depth, turn_name, n_bytes) with a row of depth 0 for each conversation, names of 16 bytes.
    saved_tokens counts bytes of last texts that all members but one need not store again.
    """
    turns = materialise(turns, "rebuilt")
    named, levels = _prefix_names(turns)
    named = materialise(named, "prefixes")
    nodes = materialise(named.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes")), "nodes")
    inner = named.filter("depth > 0").join(nodes.filter("depth > 0").select("depth", "name", "node"), ["depth", "name"]).select("conv_id", "depth", "node")
    top = named.filter("depth = 0").crossJoin(F.broadcast(nodes.filter("depth = 0").select("node"))).select("conv_id", "depth", "node")  # the one root
    path = materialise(inner.unionByName(top), "path")

    parents = path.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    own = nodes.select("depth", "node", "n_convs", "n_bytes").join(parents, ["depth", "node"], "left")
    own = materialise(own, "own")
    children = own.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = materialise(own.join(children, ["depth", "node"], "left").fillna(0, "n_children"), "tree")
    start = tree.select("depth", "node", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    whole = tree.join(_graft(start, path, levels), ["depth", "node"]).join(_ends(path), ["depth", "node"], "left")
    return whole.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def oracle() -> str:
    """The trie of rebuilt conversations as DuckDB SQL: whole prefixes as strings, crc32 bit by bit."""
    return """
with original as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as name, strlen(coalesce(text, '')) as n_bytes
  from conversations where conv_id is not null),
ids as (
  select distinct conv_id, conv_id - conv_id % 5 as base,
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda x, unused: xor(x >> 1, 3988292384::ubigint * (x & 1::ubigint)))), 4294967295::ubigint)::bigint % 9 as h
  from original),
rebuilt as (
  select i.conv_id, o.pos as raw, 0 as own, o.name, o.n_bytes from ids i join original o on o.conv_id = i.base and o.pos <= i.h
  union all select i.conv_id, o.pos, 1, o.name, o.n_bytes from ids i join original o on o.conv_id = i.conv_id and o.pos > i.h),
turns as (select conv_id, row_number() over (partition by conv_id order by own, raw) as depth, name, n_bytes from rebuilt),
prefixes as (
  select conv_id, depth, string_agg(name, '' order by depth) over (partition by conv_id order by depth) as path, n_bytes from turns
  union all select conv_id, 0, '', 0 from ids),
nodes as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(n_bytes) as n_bytes from prefixes group by depth, path),
linked as (select n.*, p.conv_id as parent_conv_id, count(c.path) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = left(n.path, 64 * (n.depth - 1)) left join nodes c on c.depth = n.depth + 1 and left(c.path, 64 * n.depth) = n.path
  group by all),
totals as (select a.depth, a.path, count(*) filter (d.n_children = 0) as n_leaves, sum((d.n_convs - 1) * d.n_bytes) as saved_tokens from linked a join linked d on starts_with(d.path, a.path) group by a.depth, a.path),
ends as (select depth, path, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, max(depth) as depth, max_by(path, depth) as path from prefixes group by conv_id) group by depth, path)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from linked join totals using (depth, path) left join ends using (depth, path)
"""
