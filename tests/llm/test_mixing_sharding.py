import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetry.llm import mixing, sharding


def brute_schedule(rows, weights, block_tokens, tolerance=0.1):
    """rows: (doc_id, source, text) -> {doc_id: (block, slot or None)} by direct simulation."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    block, n = {}, {}
    for s in {r[1] for r in rows}:
        total = 0
        for i, _, text in sorted((r for r in rows if r[1] == s), key=lambda r: md5(f"mix{r[0]}")):
            block[i] = total // block_tokens
            total += len(text.split())
            n[s] = block[i] + 1
    names = sorted(weights)
    ends = np.cumsum([weights[s] for s in names]) / sum(weights.values())
    slots, used, i, out = {}, {s: 0 for s in names}, 0, set()
    while True:
        u = i * mixing.GOLDEN - math.floor(i * mixing.GOLDEN)
        s = names[min(int(np.searchsorted(ends, u, side="right")), len(names) - 1)]
        if used[s] >= n.get(s, 0):
            out.add(s)
            if sum(weights[x] for x in out) > tolerance * sum(weights.values()):
                break
        else:
            slots[s, used[s]] = i
            used[s] += 1
        i += 1
    return {r[0]: (block[r[0]], slots.get((r[1], block[r[0]]))) for r in rows}, i


def test_mixing_equals_simulation(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["a", "a", "a", "b", "c"]), " ".join(["w"] * rnd.randrange(1, 60))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    want, slots = brute_schedule(rows, weights, 500)
    got = {r.doc_id: (r.block, r.slot) for r in mixing.schedule(docs, weights=weights, block_tokens=500).collect()}
    assert got == want
    taken = {s: len({v for k, v in want.items() if v[1] is not None and rows[k][1] == s}) for s in weights}
    assert all(abs(taken[s] - w * slots) <= 3 for s, w in weights.items())


@pytest.mark.parametrize("bits", [3, 16])
def test_a_tiny_source_does_not_end_the_schedule(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "SLOT_BITS", bits)
    rows = [(k, "abc"[k % 3] if k < 600 else "tiny", "w " * 40) for k in range(602)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"a": 0.4, "b": 0.3, "c": 0.25, "tiny": 0.05}
    for tolerance in (0.0, 0.1, 0.5):
        want, _ = brute_schedule(rows, weights, 100, tolerance)
        got = {r.doc_id: (r.block, r.slot) for r in mixing.schedule(docs, weights=weights, block_tokens=100, tolerance=tolerance).collect()}
        assert got == want
    assert sum(s is not None for _, s in want.values()) > 400


def test_equal_documents_and_ties(spark):
    rows = [(7, "a", "x y z"), (7, "a", "x y z"), (7, "a", "u v"), (8, "b", "x"), (8, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    runs = [sorted((r.doc_id, r.source, r.n_tokens, r.block, r.slot is None) for r in mixing.schedule(docs.repartition(k), block_tokens=2).collect()) for k in (1, 3)]
    assert len(runs[0]) == 5 and runs[0] == runs[1]


def test_mixing_edge_cases(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (2, None, None), (None, "a", "z"), (3, "a", ""), (4, "b", "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("surplus", F.lit(2)).withColumn("__surplus", F.lit(3)).withColumn("SURPLUS_", F.lit(4))
    out = mixing.schedule(docs).collect()
    assert len(out) == len(rows) and {r.source for r in out} == {"a", "b", ""}
    kept = mixing.keep_scheduled(docs, block_tokens=1)
    assert kept.columns == docs.columns and None in [r.doc_id for r in kept.collect()]
    empty = docs.where("false")
    assert mixing.mixed(empty).count() == 0 and mixing.keep_scheduled(empty).count() == 0
    assert mixing.mixed(docs, weights={"nowhere": 1.0}).count() == 0
    assert {r.source for r in mixing.mixed(docs, weights={"a": 1.0, "b": 0.0}).collect()} == {"a"}
    with pytest.raises(ValueError):
        mixing.schedule(docs, block_tokens=0)


def test_sources_without_tokens_stay(spark):
    rows = [(1, "a", "x y"), (2, "b", ""), (3, "b", None), (4, None, " "), (5, "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {2, 3, 4} <= {r.doc_id for r in mixing.keep_scheduled(docs).collect()}
    assert {r.doc_id for r in mixing.keep_scheduled(docs, weights={"a": 1.0}).collect()} == {1}


def best_capacity(sizes, shards):
    """Minimax contiguous partition by dynamic programming."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    best = total[1:].copy()
    for _ in range(shards - 1):
        best = np.array([min([best[j], *[max(best[i], total[j + 1] - total[i + 1]) for i in range(j)]]) for j in range(len(sizes))])
    return int(best[-1])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 6), st.integers(1, 7))
def test_capacity_equals_dynamic_programming(sizes, shards, blob):
    parts = [np.array(sizes[k : k + blob], dtype=np.int64) for k in range(0, len(sizes), blob)]

    def needed(capacities):
        fills = [sharding.Fill(int(c)) for c in capacities]
        for part in parts:
            for f in fills:
                f.add(*sharding.outcomes(part, f.capacity), int(part.sum()))
        return np.array([f.shards for f in fills])

    got = sharding.smallest_capacity(needed, sum(sizes), max(sizes), shards, probes=3)
    assert got == best_capacity(np.array(sizes), shards)
    direct = np.array([greedy(sizes, c) for c in range(max(sizes), sum(sizes) + 1)])
    assert (needed(np.arange(max(sizes), sum(sizes) + 1)) == direct).all()


def greedy(sizes, capacity):
    shards, fill = 1, 0
    for s in sizes:
        shards, fill = (shards + 1, s) if fill + s > capacity else (shards, fill + s)
    return shards


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOB_ROWS", 50)
    rnd = random.Random(1)
    rows = [(k, " ".join(["t"] * rnd.choice([1, 5, 30, 200]))) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.assign(docs, shards=9).withColumn("n", mixing.n_tokens(F.col("text"))).orderBy("doc_id").collect()
    shards = [r.shard for r in out]
    assert shards == sorted(shards) and set(shards) == set(range(max(shards) + 1)) and max(shards) < 9
    load = {}
    for r in out:
        load[r.shard] = load.get(r.shard, 0) + r.n
    assert max(load.values()) == best_capacity(np.array([r.n for r in out]), 9)


def test_sharding_edge_cases(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (None, "x"), (None, "y"), (3, ""), (9, "w " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("size", F.lit(0)).withColumn("shard", F.lit("old"))
    out = sharding.assign(docs, shards=3)
    assert out.columns == docs.columns
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values()) and by[None] == {0} and by[9] == {1}
    assert sharding.assign(docs.where("false")).count() == 0
    grouped = docs.withColumn("family", F.when(F.col("doc_id") > 2, 1).otherwise(0))
    assert sharding.assign(grouped, group_col="family", shards=2).select("family", "shard").distinct().count() == 2
    assert {r.shard for r in sharding.assign(docs, shards=50).collect()} <= set(range(50))
    with pytest.raises(ValueError):
        sharding.assign(docs, shards=0)


def test_sharding_equals_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(3)
    rows = [(k, " ".join(["t"] * rnd.choice([10, 5_000, 30_000, 120_000]))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.shard) for r in sharding.assign(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted((r[0], r[2]) for r in con.sql(sharding.ORACLE_SQL).fetchall())
    assert got == want and max(s for _, s in got) > 3
