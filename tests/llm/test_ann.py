import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [float(x) if x is not None else None for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def brute(rows, k):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for a, i in enumerate(ids.tolist()):
        d = ((x - x[a]) ** 2).sum(axis=1)
        out[i] = [(j, float(np.sqrt(e))) for e, j in sorted(zip(np.round(d, 12).tolist(), ids.tolist(), strict=True)) if j != i][:k]
    return out


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_recall_against_brute_force(spark, spread):
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(12, 16))
    rows = [(int(i), (centre[i % 12] + spread * rnd.normal(size=16)).tolist()) for i in range(900)]
    out = ann.neighbours(frame(spark, rows), k=5, cell_rows=8, tile_rows=200, query_rows=300, calibration=100).toPandas()
    want = brute(rows, 5)
    hit = sum((r.vec_id, r.neighbour_id) in {(i, j) for i in [r.vec_id] for j, _ in want[i]} for r in out.itertuples())
    assert hit >= 0.9 * 5 * 900 and len(out) == 4500
    assert out.groupby("vec_id")["rank"].apply(list).map(lambda x: sorted(x) == [1, 2, 3, 4, 5]).all()


def test_whole_budget_equals_brute_force_with_ties(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.integers(0, 3, 5).tolist()) for i in range(150)]
    out = ann.neighbours(frame(spark, rows), k=4, recall=1.0, cell_rows=4, tile_rows=16, query_rows=40, calibration=1000).toPandas()
    got = {i: list(zip(g.sort_values("rank").neighbour_id, g.sort_values("rank").distance, strict=True)) for i, g in out.groupby("vec_id")}
    for i, want in brute(rows, 4).items():
        assert [j for j, _ in got[i]] == [j for j, _ in want] and np.allclose([d for _, d in got[i]], [d for _, d in want], atol=1e-6)


def test_some_rows_ask_all(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(500)] + [(1000 + i, [0.5] * 8) for i in range(300)]
    out = ann.neighbours(frame(spark, rows), k=5, query_every=50, recall=1.0, cell_rows=8, tile_rows=40, query_rows=4, calibration=1000).toPandas()
    want = brute(rows, 5)
    assert set(out.vec_id) == {i for i, _ in rows if i % 50 == 0}
    for i, g in out.groupby("vec_id"):
        assert np.allclose(g.sort_values("rank").distance, [d for _, d in want[i]], atol=1e-6) and g.sort_values("rank").neighbour_id.tolist() == [j for j, _ in want[i]]


def test_a_cell_of_many_entries_is_spread():
    counts = np.array([3, 0, 25, 4, 9, 11])
    tiles = ann.Tiles(counts, 10)
    assert tiles.parts.tolist() == [1, 1, 3, 1, 1, 2] and len({(f + j, p) for f, n, p in zip(tiles.first, tiles.parts, tiles.place, strict=True) for j in range(n)}) == 9
    cell = np.repeat(np.arange(6), counts)
    spread = np.bincount(tiles.of(cell, np.arange(len(cell))))
    assert spread.sum() == counts.sum() and spread.max() <= 20
    of_five = set(tiles.of(np.full(100, 5), np.arange(100)).tolist())
    assert of_five == {tiles.first[5], tiles.first[5] + 1}


def test_traversal_is_in_order_of_summed_distance():
    rnd = np.random.default_rng(3)
    a, b, counts = rnd.random(7), rnd.random(5), rnd.integers(0, 4, (7, 5))
    cells = ann.traverse(a, b, counts.tolist(), 10**9)
    summed = (a[:, None] + b[None]).ravel()
    assert cells == [c for c in np.argsort(summed).tolist() if counts.ravel()[c]]
    some = ann.traverse(a, b, counts.tolist(), 9)
    assert some == cells[: len(some)] and counts.ravel()[some].sum() >= 9 > counts.ravel()[some[:-1]].sum()


def test_edge_cases(spark):
    rows = [(0, [1, 0, 0]), (1, [1, 0, 0]), (2, [0, 1, 0]), (2, [0, 2, 0]), (3, None), (None, [1, 1, 1]), (4, [1, 2]), (5, []), (6, [None, 0, 0]), (7, [float("nan"), 0, 0]), (8, [-0.0, 1, 0]), (8, [-0.0, 1, 0])]
    df = frame(spark, rows).withColumn("rep", F.lit("clash")).withColumn("v", F.lit(1))
    out = ann.neighbours(df, k=2, recall=1.0)
    got = {}
    for r in out.orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour_id, round(r.distance, 6)))
    far = round(2**0.5, 6)
    assert got == {0: [(1, 0.0), (2, far)], 1: [(0, 0.0), (2, far)], 2: [(8, 0.0), (0, far)], 8: [(2, 0.0), (0, far)]}
    assert ann.neighbours(df.where("false")).count() == 0 and ann.neighbours(df.where("vec_id = 0")).count() == 0
    many = frame(spark, [(i, [1.0]) for i in range(50)])
    assert ann.neighbours(many, k=3).count() == 150
