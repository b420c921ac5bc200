"""Sharding: minimax contiguous partition.

Atomic groups, in the order of their keys, go to contiguous shards whose largest holds as few tokens as possible. The
smallest feasible capacity is found by searching between the bounds max(largest group, total / shards) and total / shards +
largest group; a capacity is feasible if a greedy fill needs no more than the wanted number of shards. One pass checks
`probes` capacities at once, so a few passes do; then the groups are cut where the greedy fill at that capacity cuts.

The greedy fill depends on all groups before, yet it is computed in parallel: the sorted groups are packed into blobs, and
for each blob and capacity an executor works out, for every room that the blob may find in the shard begun before it, how
many shards begin inside and what the last of them holds. Fills that begin at different places soon cut at the same ones, so
these tables are short; the driver only follows them from blob to blob. It never sees a group's size.

Defined cases: groups are the values of `id_col`, or of `group_col` where that is given; rows of one group never part, and rows
without one are one group, the first. Null and empty texts have no tokens; a group of very long texts is a shard of its own if it is the
largest. Of several feasible partitions each shard but the last is filled as far as the capacity allows, so ties don't arise. With fewer
groups than shards, or where the greedy fill needs fewer, later shards don't exist. An empty table has no shards. Repeated rows
are one group. Extra columns, whatever their names, stay; only `shard` is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.llm._shared import in_arrow, purge, require, shared_dir
from facetry.llm.mixing import n_tokens

BLOB_ROWS = 1 << 19
NULL_KEY = -(1 << 63)


def outcomes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(room, begun, left), by ascending room: with at least `room` tokens left in the shard before, and less than in the next row, `begun` shards begin in here and the last one holds `left`; with 0 begun, all groups fit."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    most = int(np.searchsorted(total, capacity, side="right")) - 1
    first = np.arange(min(most, n - 1) + 1)  # where the first shard may begin
    begun, left = np.ones(len(first), np.int64), np.zeros(len(first), np.int64)
    at, group = first, np.arange(len(first))  # distinct places, and the one that each start has come to
    open_ = np.arange(len(first))
    while len(at) > 1:
        then = np.searchsorted(total, total[at] + capacity, side="right") - 1
        ended = then >= n
        over = ended[group]
        left[open_[over]] = total[n] - total[at[group[over]]]
        open_ = open_[~over]
        begun[open_] += 1
        at, group = np.unique(then[group[~over]], return_inverse=True)
    if len(at):
        ends, place, more = total.tolist(), int(at[0]), 0
        while (then := bisect_right(ends, ends[place] + capacity) - 1) < n:
            place, more = then, more + 1
        begun[open_] += more
        left[open_] = ends[n] - ends[place]
    room = total[first]
    if most >= n:
        room, begun, left = np.append(room, total[n]), np.append(begun, 0), np.append(left, 0)
    # Of starts with equal room the last counts; runs of equal outcomes are one row.
    keep = np.append(room[1:] != room[:-1], True)
    room, begun, left = room[keep], begun[keep], left[keep]
    new = np.append(True, (begun[1:] != begun[:-1]) | (left[1:] != left[:-1]))
    return room[new], begun[new], left[new]


class Fill:
    """A greedy fill that goes from blob to blob."""

    def __init__(self, capacity: int):
        self.capacity, self.fill, self.shards = capacity, 0, 1

    def add(self, room: np.ndarray, begun: np.ndarray, left: np.ndarray, total: int) -> None:
        row = int(np.searchsorted(room, self.capacity - self.fill, side="right")) - 1
        if begun[row]:
            self.shards += int(begun[row])
            self.fill = int(left[row])
        else:
            self.fill += total


def smallest_capacity(needed: Callable[[np.ndarray], np.ndarray], total: int, largest: int, shards: int, probes: int = 32) -> int:
    """needed: gives the number of shards that a greedy fill takes at each of some capacities."""
    low = max(largest, -(-total // shards))
    high = max(low, total // shards + largest)  # always feasible: each shard but the last holds over total / shards
    while low < high:
        tried = np.unique(np.linspace(low, high - 1, min(probes, high - low)).astype(np.int64))
        good = np.flatnonzero(needed(tried) <= shards)
        if len(good):
            high = int(tried[good[0]])
            low = int(tried[good[0] - 1]) + 1 if good[0] else low
        else:
            low = int(tried[-1]) + 1
    return low


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seq, keys, sizes, part = 0, [], [], None

    def blob() -> pa.RecordBatch:
        k, s = np.concatenate(keys), np.concatenate(sizes)
        values = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary()), pa.array([s.sum()], pa.int64()), pa.array([s.max()], pa.int64()), pa.array([len(s)], pa.int64())]
        return pa.RecordBatch.from_arrays(values, names=["part", "seq", "keys", "sizes", "total", "largest", "n"])

    for batch in batches:
        for a in range(0, batch.num_rows, BLOB_ROWS):
            some = batch.slice(a, BLOB_ROWS)
            part = some.column("part")[0].as_py()
            keys.append(some.column("key").to_numpy())
            sizes.append(some.column("size").to_numpy())
            if sum(map(len, keys)) >= BLOB_ROWS:
                yield blob()
                seq, keys, sizes = seq + 1, [], []
    if keys:
        yield blob()


def _probed(capacities: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [outcomes(np.frombuffer(row["sizes"], dtype=np.int64), c) for c in capacities]
                tables = [pa.array([[x[k].tobytes() for x in found]], pa.list_(pa.binary())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["seq"]], pa.int32()), pa.array([row["total"]], pa.int64()), *tables], names=["part", "seq", "total", "room", "begun", "left_"])

    return run


def _fills(packed: DataFrame, capacities: list[int]) -> Iterator[tuple[tuple[int, int], list[Fill]]]:
    """Each blob with the fills as they come to it; after the last blob the fills are complete."""
    fills = [Fill(c) for c in capacities]
    tables = in_arrow(packed.select("part", "seq", "total", "sizes"), _probed(capacities), "part int, seq int, total long, room array<binary>, begun array<binary>, left_ array<binary>")
    for row in tables.orderBy("part", "seq").toLocalIterator():
        yield (row.part, row.seq), fills
        for k, fill in enumerate(fills):
            fill.add(*(np.frombuffer(row[c][k], dtype=np.int64) for c in ("room", "begun", "left_")), row.total)
    yield (-1, -1), fills


def _cut(before, capacity: int):
    """The first key of every shard that begins in a blob, which finds the shard before it filled as `before` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, sizes = (np.frombuffer(row[c], dtype=np.int64) for c in ("keys", "sizes"))
                ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                fill = before.value[row["part"], row["seq"]]
                starts = [0] if fill < 0 else []
                at = bisect_right(ends, capacity - max(fill, 0)) - 1
                while at < len(sizes):
                    starts.append(at)
                    at = bisect_right(ends, ends[at] + capacity) - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[starts], pa.int64())], names=["key"])

    return run


def cuts(docs: DataFrame, *, id_col: str = "doc_id", group_col: str | None = None, text_col: str = "text", shards: int | None = None, target_tokens: int = 2_000_000) -> tuple[np.ndarray, int]:
    """First key of every shard, 8 bytes each, and the capacity. Without `shards`, as many as hold `target_tokens` each on average."""
    column = group_col or id_col
    require(docs, column, text_col)
    if (shards is not None and shards < 1) or target_tokens < 1:
        raise ValueError("shards and target_tokens must be positive")
    spark = docs.sparkSession
    key = F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))
    groups = docs.select(key.alias("key"), n_tokens(F.col(text_col)).alias("size")).groupBy("key").agg(F.sum("size").alias("size"))
    ordered = groups.repartitionByRange("key").sortWithinPartitions("key").select(F.spark_partition_id().alias("part"), "key", "size")
    path = shared_dir(spark)
    in_arrow(ordered, _pack, "part int, seq int, keys binary, sizes binary, total long, largest long, n long").write.parquet(path)
    packed = spark.read.parquet(path)
    try:
        whole = packed.agg(F.sum("total").alias("total"), F.max("largest").alias("largest"), F.sum("n").alias("n")).first()
        if not whole.n:
            return np.zeros(0, np.int64), 0
        wanted = shards or max(1, -(-whole.total // target_tokens))

        def needed(capacities: np.ndarray) -> np.ndarray:
            *_, (_, fills) = _fills(packed, capacities.tolist())
            return np.array([f.shards for f in fills])

        capacity = smallest_capacity(needed, whole.total, whole.largest, wanted)
        before: dict[tuple[int, int], int] = {}
        for blob, fills in _fills(packed, [capacity]):
            before[blob] = fills[0].fill if before else -1
        starts = in_arrow(packed.select("part", "seq", "keys", "sizes"), _cut(spark.sparkContext.broadcast(before), capacity), "key long")
        return np.sort(starts.toArrow().column("key").to_numpy()), capacity
    finally:
        purge(spark, path)


def with_shard(docs: DataFrame, starts: np.ndarray, *, id_col: str = "doc_id") -> DataFrame:
    """`docs` and a column `shard`, which takes the place of one of that name. Needs no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf(T.IntegerType())
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(dtype=np.int64), side="right") - 1, dtype="int32")

    return docs.withColumn("shard", place(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))))


def assign(docs: DataFrame, *, id_col: str = "doc_id", group_col: str | None = None, **params) -> DataFrame:
    """`docs` and its shard."""
    starts, _ = cuts(docs, id_col=id_col, group_col=group_col, **params)
    return with_shard(docs, starts, id_col=group_col or id_col)


#: The sizes of the groups as a list, a greedy fill as a fold over it, and a binary search of the capacity. Row ids have no gaps at the null.
ORACLE_SQL = r"""
with recursive g as (
  select doc_id, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))) as size from documents group by doc_id),
a as (
  select list(struct_pack(s := cast(1 as bigint), f := cast(size as bigint), c := [cast(doc_id as bigint)]) order by doc_id nulls first) as xs, cast(sum(size) as bigint) as total, cast(max(size) as bigint) as largest,
         cast(greatest(1, ceil(sum(size) / 2000000.0)) as bigint) as shards from g),
search as (
  select greatest(largest, cast(ceil(total / shards) as bigint)) as low, greatest(largest, cast(ceil(total / shards) as bigint), cast(floor(total / shards) as bigint) + largest) as high from a
  union all
  select case when fits then low else mid + 1 end, case when fits then mid else high end from (
    select low, high, mid, list_reduce(xs, lambda p, x: case when p.f + x.f > mid then struct_pack(s := p.s + 1, f := x.f, c := p.c) else struct_pack(s := p.s, f := p.f + x.f, c := p.c) end).s <= shards as fits
    from (select low, high, cast(floor((low + high) / 2) as bigint) as mid, xs, shards from search, a where low < high))),
best as (
  select min(high) as capacity from search),
cut as (
  select list_reduce(xs, lambda p, x: case when p.f + x.f > capacity then struct_pack(s := p.s + 1, f := x.f, c := list_concat(p.c, x.c)) else struct_pack(s := p.s, f := p.f + x.f, c := p.c) end).c as starts from a, best)
select d.doc_id, cast(len(regexp_extract_all(coalesce(d.text, ''), '[^ \t\n\r\f]+')) as bigint) as n_tokens,
       cast(greatest(len(list_filter(starts, lambda k: k <= d.doc_id)), 1) - 1 as integer) as shard
from documents d, cut
"""
