"""Mixing sources to target weights: low-discrepancy source schedule.

Slot i of the schedule has the golden-ratio point frac(i * 0.6180339887498949). The cumulative target weights map it to a source, so
that every prefix of the schedule holds each source to within a few slots of its share. A source's documents, shuffled by the
hash of their ids, are cut into blocks of `block_tokens` tokens: a document belongs to the block in which its first token
falls. The r-th slot of a source takes its block r. Slots of a source that has run out of blocks stay empty, so the others go on in
their proportions; the schedule ends where the sources that ran out have more than `tolerance` of the weight, as
the target can't be held beyond. No document comes twice; documents of later blocks are surplus and are left out.
Weights default to tokens ** `temperature` of each source, which lowers the largest sources.

Running token sums need no window over a whole source: each source is cut into 4096 ranges of hashes, whose totals
give every range its offset. Nor do the slots: ranges of them are counted by source, and the counts give the offsets.

Defined cases: a token is a run of characters other than blanks, tabs, line ends and form feeds; null and empty texts have none and still have a
block. A text longer than a block is whole in the block of its first token, and the blocks that it covers besides are empty. A null
source is the source ''. Rows without an id are scheduled like others. Repeated rows are scheduled each; documents of equal hash go by
the hash of their text, then by tokens. A source of weight 0, or absent from given weights, is left out; a given source without
documents has run out from its first slot on. An empty table has an empty schedule. Extra columns, whatever their names, pass
through `keep_scheduled` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm._shared import in_arrow, own_name, require, sized, written

GOLDEN = 0.6180339887498949
#: Slots are ranked in ranges of so many.
SLOT_BITS = 16


def n_tokens(text) -> F.Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def schedule(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.7, tolerance: float = 0.1, block_tokens: int = 20_000, seed: str = "mix") -> DataFrame:
    """(doc_id, source, n_tokens, block, slot) of every row; slot is null where it is surplus."""
    require(docs, id_col, text_col, source_col)
    if block_tokens < 1 or not 0 <= tolerance < 1:
        raise ValueError("block_tokens must be positive, tolerance in [0, 1)")
    spark = docs.sparkSession
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        n_tokens(F.col(text_col)).alias("n_tokens"),
        order.alias("ord"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tie"),
    )
    rows = written(rows.select("*", F.substring("ord", 1, 3).alias("bucket")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("ord", "tie", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    placed = rows.join(offsets, ["source", "bucket"]).select("doc_id", "source", "n_tokens", F.floor((F.col("offset") + start) / block_tokens).cast("long").alias("block"))
    sources = [(r.source, int(r.tokens)) for r in totals.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").collect()]
    # The block of a source's last document is its last: the number of blocks follows from the placed rows.
    placed = written(placed)
    blocks = {r.source: r.n for r in placed.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    share = {s: float(t) ** temperature for s, t in sources} if weights is None else {s: float(w) for s, w in weights.items() if w > 0}
    total = sum(share.values())
    if not total or not blocks:
        return placed.select("doc_id", "source", "n_tokens", "block", F.lit(None).cast("long").alias("slot"))
    names = sorted(s for s in share if share[s] > 0)
    lows, low = [], 0.0
    for s in names:
        lows.append(low)
        low += share[s] / total
    # A source runs out before its share of slots passes its blocks by a margin; the schedule ends at the latest where that holds for enough weight.
    held, enough = 0.0, 0.0
    for until, part in sorted(((blocks.get(s, 0) + 10.0) / (share[s] / total), share[s] / total) for s in names):
        held, enough = held + part, until
        if held > tolerance + 1e-9:
            break
    slots = in_arrow(spark.range(int(enough) + 1000), _sources(np.array(lows), names), "slot long, source string")
    part = F.shiftright("slot", SLOT_BITS)
    counts = slots.groupBy("source", part.alias("part")).count()
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
    sizes = spark.createDataFrame([(s, blocks.get(s, 0)) for s in names], "source string, n long")
    ranked = slots.withColumn("part", part).withColumn("rank", rank).join(sized(offsets, (int(enough) >> SLOT_BITS) * len(names) + len(names), 60), ["source", "part"]).join(sized(sizes, len(names), 60), "source")
    ranked = written(ranked.select("slot", "source", "n", (F.col("offset") + F.col("rank")).alias("block")))
    out_at = sorted((r.slot, share[r.source]) for r in ranked.where("block >= n").groupBy("source").agg(F.min("slot").alias("slot")).collect())
    held, end = 0.0, int(enough) + 1000
    for slot, weight in out_at:
        held += weight
        if held > tolerance * total:
            end = slot
            break
    used = ranked.where((F.col("block") < F.col("n")) & (F.col("slot") < end)).select("source", "block", "slot")
    return placed.join(used, ["source", "block"], "left").select("doc_id", "source", "n_tokens", "block", "slot")


def _sources(lows: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(names, pa.string())
        for batch in batches:
            point = batch.column("id").to_numpy() * GOLDEN
            at = np.searchsorted(lows, point - np.floor(point), side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), table.take(pa.array(at))], names=["slot", "source"])

    return run


def mixed(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, source, n_tokens, block, slot) of the scheduled documents."""
    return schedule(docs, **params).where("slot is not null")


def keep_scheduled(docs: DataFrame, **params) -> DataFrame:
    """`docs` without the surplus: a row stays if its id is scheduled or null, or in a source that has no tokens and so no default weight. All columns stay as they are."""
    id_col = params.get("id_col", "doc_id")
    plan = schedule(docs, **params)
    stays = F.col("slot").isNotNull()
    if params.get("weights") is None:
        wordless = [r.source for r in plan.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens = 0").collect()]
        stays = stays | F.col("source").isin(wordless)
    gone = own_name(docs, "surplus")
    surplus = written(plan.where("doc_id is not null").groupBy("doc_id").agg(F.max(stays).alias("stays")).where("not stays").select(F.col("doc_id").alias(gone)))
    return docs.join(sized(surplus, surplus.count(), 40), docs[id_col].cast("long") == surplus[gone], "left_anti")


ORACLE_SQL = f"""
with rows as (
  select doc_id, coalesce(source, '') as source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) as bigint) as n_tokens,
         md5('mix' || coalesce(cast(doc_id as varchar), '')) as ord, md5(coalesce(text, '')) as tie from documents),
placed as (
  select doc_id, source, n_tokens, cast(floor(coalesce(sum(n_tokens) over (partition by source order by ord, tie, n_tokens
         rows between unbounded preceding and 1 preceding), 0) / 20000) as bigint) as block from rows),
totals as (
  select source, power(cast(sum(n_tokens) as double), 0.7) as share, max(block) + 1 as n from placed group by source),
ranges as (
  select source, n, coalesce(sum(share) over (order by source rows between unbounded preceding and 1 preceding), 0) / sum(share) over () as low,
         case when row_number() over (order by source desc) = 1 then 2.0 else sum(share) over (order by source) / sum(share) over () end as high from totals),
points as (
  select i, i * {GOLDEN}::double - floor(i * {GOLDEN}::double) as u from (select range as i from range((select cast(sum(n) * 30 + 5000 as bigint) from totals)))),
slots as (
  select i, source, n, row_number() over (partition by source order by i) - 1 as block from points join ranges on u >= low and u < high),
empty as (
  select min(i) as i, share from slots join totals using (source) where block >= slots.n group by source, share),
held as (
  select i, sum(share) over (order by i) as held from empty),
used as (
  select source, block, i as slot from slots
  where block < n and i < (select coalesce(min(i), 9223372036854775807) from held where held > 0.1 * (select sum(share) from totals)))
select doc_id, source, n_tokens, block, slot from placed join used using (source, block)
"""
