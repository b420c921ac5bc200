"""Approximate nearest neighbours: inverted multi-index.

Each vector is cut in two halves, and each half is quantised by a codebook of its own (k-means on a hash sample of
`train_rows` rows a centroid). A pair of centroids is a cell, whose list holds its vectors. A query reads the cells in order of summed
distance of its halves to the two centroids, by a heap over the two sorted lists of distances, until it has read a budget
of entries, and reranks them by exact distance. The budget is calibrated: `calibration` rows of least hash are compared with all vectors, and
the budget is the least that reads a share of `recall` of their true neighbours. Every row is indexed; queries are the rows
whose id is divisible by `query_every`.

Cells are packed into tiles of about `tile_rows` entries, and a cell of more is spread over several. A query goes once to each tile that
it reads, with a bitmap of its cells there, in chunks of `query_rows` queries; a task holds one tile and one chunk, and entries go to
those chunks only that read their tile. Equal vectors are one entry, so a hot vector costs no more than any other; its rows are
listed again in the result.

Centroids a half follow the number of vectors, about sqrt(vectors / `cell_rows`), up to `max_centroids`. That bounds what the executors get
of the index (two codebooks, two numbers a cell); beyond it cells hold more rows, and the budget is calibrated as ever.

Defined cases: rows whose id or vector is null, whose vector has another length than most, or a null or not finite component are left out.
Of several vectors of one id the least in array order counts. A row is no neighbour of itself. Equal distances go by id. With fewer
than k others a row has fewer neighbours. Very long vectors are compared whole. An empty table has no neighbours. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm._shared import in_arrow, require, sized, written
from facetry.llm._text import mix


def kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centroids; the first ones are rows spread over the sample. Sorted along their main axis, so near ones get near numbers."""
    k = max(1, min(k, len(rows)))
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    if centres.shape[1] and k > 1:
        axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
        centres = centres[np.argsort(centres @ axis, kind="stable")]
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    d = (rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T
    return np.maximum(d, 0)


def nearest(rows: np.ndarray, centres: np.ndarray, batch: int = 4096) -> np.ndarray:
    parts = [distances(rows[a : a + batch], centres).argmin(axis=1) for a in range(0, len(rows), batch)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def traverse(first: np.ndarray, second: np.ndarray, counts: list[list[int]], budget: int) -> list[int]:
    """Non-empty cells (first centroid * number of second ones + second) in order of summed distance, until they hold `budget` entries."""
    order1, order2 = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    d1, d2 = np.sort(first).tolist(), np.sort(second).tolist()
    width, height = len(d2), len(d1)
    heap = [(d1[0] + d2[0], 0, 0)]
    cells: list[int] = []
    seen = 0
    while heap and seen < budget:
        _, i, j = heap[0]
        n = counts[order1[i]][order2[j]]
        if n:
            cells.append(order1[i] * width + order2[j])
            seen += n
        # Row i + 1 begins once row i has begun; within a row the next follows the one before.
        if j + 1 < width:
            heapq.heapreplace(heap, (d1[i] + d2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < height:
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return cells


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of float32 vectors."""
    if not len(column):
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), dim).astype(np.float64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
        dim = len(flat) // max(1, len(v))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in flat.reshape(len(v), dim)], pa.binary())], names=["id", "v"])


def _in_cells(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            cell = nearest(x[:, : dim // 2], one) * len(two) + nearest(x[:, dim // 2 :], two)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("v"), pa.array(cell, pa.int32())], names=["rep", "v", "cell"])

    return run


class _Best:
    """The k least (distance, id) of each of n queries."""

    def __init__(self, n: int, k: int):
        self.d, self.id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, which: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """d: distances of the queries `which` to the entries `ids`."""
        k = self.d.shape[1]
        if d.shape[1] > k:  # ties at the k-th place: all that are no farther stay in
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            some = np.flatnonzero(((d <= np.minimum(kth, self.d[which, -1])[:, None])).any(axis=0))
            d, ids = d[:, some], ids[some]
        all_d = np.concatenate([self.d[which], d], axis=1)
        all_id = np.concatenate([self.id[which], np.broadcast_to(ids, d.shape)], axis=1)
        order = np.lexsort((all_id, all_d), axis=1)[:, :k]
        self.d[which], self.id[which] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_id, order, 1)

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        """(rep, near, dist) of all that was found."""
        q, p = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(self.id[q, p], pa.int64()), pa.array(self.d[q, p], pa.float64())], names=["rep", "near", "dist"])


FOUND = "rep long, near long, dist double"


def _exact(shared, dim: int, k: int):
    """Neighbours of the broadcast queries among each partition's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best = _Best(len(names), k)
        for batch in batches:
            x, ids = _matrix(batch.column("v"), dim), batch.column("rep").to_numpy()
            for a in range(0, len(ids), 2048):
                best.add(np.arange(len(names)), np.where(ids[a : a + 2048][None] == names[:, None], np.inf, distances(q, x[a : a + 2048])), ids[a : a + 2048])
        yield best.batch(names)

    return run


class Tiles:
    """Where each cell lies: its first tile, its number of tiles, more than one for a cell of over `rows` entries, and its place in a tile."""

    def __init__(self, counts: np.ndarray, rows: int):
        self.parts = np.maximum(1, -(-counts // rows))
        small = self.parts == 1
        of_small = np.where(small, counts, 0)
        tile = (np.cumsum(of_small) - of_small) // rows
        here = np.flatnonzero(small)
        self.first, self.place = tile.copy(), np.zeros(len(counts), np.int64)
        if len(here):
            self.place[here] = np.arange(len(here)) - np.searchsorted(tile[here], tile[here])
        extra = np.where(small, 0, self.parts)
        self.first[~small] = (int(tile[here].max()) + 1 if len(here) else 0) + (np.cumsum(extra) - extra)[~small]

    def of(self, cell: np.ndarray, rep: np.ndarray) -> np.ndarray:
        return self.first[cell] + (mix(rep.view(np.uint64)) % self.parts[cell].astype(np.uint64)).astype(np.int64)


def _routed(shared, dim: int):
    """A row for each query and each tile that it reads, with the bitmap of its cells there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, counts, tiling, budget, chunks = shared.value
        table = counts.tolist()
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                x, ids, raw = _matrix(batch.column("v"), dim), batch.column("rep").to_numpy(), batch.column("v")
                d1, d2 = distances(x[:, : dim // 2], one), distances(x[:, dim // 2 :], two)
                rows, tiles, maps = [], [], []
                for r in range(len(ids)):
                    cells = np.array(traverse(d1[r], d2[r], table, budget), dtype=np.int64)
                    parts = tiling.parts[cells]
                    tile = np.repeat(tiling.first[cells] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
                    place = np.repeat(tiling.place[cells], parts)
                    order = np.argsort(tile, kind="stable")
                    tile, place = tile[order], place[order]
                    begin = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
                    for b, e in zip(begin, np.append(begin[1:], len(tile)), strict=True):
                        bits = np.zeros(int(place[b:e].max()) + 1, dtype=bool)
                        bits[place[b:e]] = True
                        rows.append(r)
                        tiles.append(int(tile[b]))
                        maps.append(np.packbits(bits).tobytes())
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int32()), pa.array((mix(ids[rows].view(np.uint64)) % np.uint64(chunks)).astype(np.int32), pa.int32()), pa.array(ids[rows], pa.int64()), raw.take(at), pa.array(maps, pa.binary())], names=["tile", "chunk", "rep", "v", "bits"])

    return run


def _reranked(dim: int, k: int):
    """Queries of one chunk against the entries of one tile, cell by cell."""

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        names = queries.column("rep").to_numpy()
        q, e = (_matrix(t.column("v").combine_chunks(), dim) for t in (queries, entries))
        place, ids = entries.column("place").to_numpy(), entries.column("rep").to_numpy()
        best = _Best(len(names), k)
        if len(names) and len(ids):
            order = np.argsort(place, kind="stable")
            place, ids, e = place[order], ids[order], e[order]
            width = int(place[-1]) + 1
            reads = np.zeros((len(names), width), dtype=bool)
            for r, bits in enumerate(queries.column("bits").to_pylist()):
                own = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[:width]
                reads[r, : len(own)] = own
            begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            for b, t in zip(begin, np.append(begin[1:], len(place)), strict=True):
                for a in range(b, t, 2048):
                    some = np.flatnonzero(reads[:, place[b]])
                    for s in range(0, len(some), 4096):
                        which, near = some[s : s + 4096], slice(a, min(t, a + 2048))
                        d = distances(q[which], e[near])
                        d[names[which][:, None] == ids[near][None]] = np.inf
                        best.add(which, d, ids[near])
        return pa.Table.from_batches([best.batch(names)])

    return run


def neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 1, k: int = 10, recall: float = 0.94, calibration: int = 400, train_rows: int = 128, cell_rows: int = 64, max_centroids: int = 1024, tile_rows: int = 8192, query_rows: int = 32768) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest rows of every query by Euclidean distance; ranks count from 1."""
    require(vectors, id_col, vector_col)
    if min(query_every, k, calibration, train_rows, cell_rows, max_centroids, tile_rows, query_rows) < 1 or not 0 < recall <= 1:
        raise ValueError("query_every, k, calibration and the sizes must be positive, recall in (0, 1]")
    spark = vectors.sparkSession
    context = spark.sparkContext
    schema = "vec_id long, rank int, neighbour_id long, distance double"
    v = F.col(vector_col).cast("array<float>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), finite.alias("finite")).where("id is not null and size(v) > 0 and finite")
    lengths = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths.dim
    # -0.0 and 0.0 are one value: adding 0.0 makes both the same bytes.
    single = valid.where(F.size("v") == dim).groupBy("id").agg(F.min(F.transform("v", lambda x: x + F.lit(0.0).cast("float"))).alias("v"))
    single = written(in_arrow(single, _packed, "id long, v binary"))
    classes = written(single.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("rows")))
    asked = single.where(F.pmod("id", F.lit(query_every)) == 0).join(classes, "v").select(F.col("id").alias("vec_id"), "rep")
    n, n_queries = classes.count(), -(-single.count() // query_every)
    half = dim // 2
    size = int(min(max_centroids, max(1, round((n / cell_rows) ** 0.5))))
    hashed = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    share = min(1.0, size * train_rows / n)
    sample = classes.where(hashed < int(share * (1 << 30))).select("rep", "v").toPandas().sort_values("rep")
    if not len(sample):
        sample = classes.select("rep", "v").orderBy(hashed, "rep").limit(1).toPandas()
    train = np.frombuffer(b"".join(map(bytes, sample.v)), dtype=np.float32).reshape(len(sample), dim).astype(np.float64)
    one, two = kmeans(train[:, :half], size), kmeans(train[:, half:], size)
    entries = written(in_arrow(classes.select("rep", "v"), _in_cells(context.broadcast((one, two)), dim), "rep long, v binary, cell int"))
    counts = np.zeros(len(one) * len(two), dtype=np.int64)
    for r in entries.groupBy("cell").count().toLocalIterator():
        counts[r.cell] = r["count"]
    budget = _budget(entries, one, two, counts, dim, k, recall, calibration)
    chunks = max(1, -(-n_queries // query_rows))
    shared = context.broadcast((one, two, counts.reshape(len(one), len(two)), Tiles(counts, tile_rows), budget, chunks))
    queries = entries.select("rep", "v").join(asked.select("rep").distinct(), "rep", "left_semi").repartition(F.col("rep"))
    routed = written(in_arrow(queries, _routed(shared, dim), "tile int, chunk int, rep long, v binary, bits binary"))
    read = routed.select(F.col("tile").alias("reads"), F.col("chunk").alias("by")).distinct()
    placed = in_arrow(entries, _tiles(shared), "tile int, place int, rep long, v binary").join(sized(read, (n // tile_rows + 1) * chunks * 2, 40), F.col("tile") == F.col("reads")).select("tile", F.col("by").alias("chunk"), "place", "rep", "v")
    both = routed.groupBy("tile", "chunk").cogroup(placed.groupBy("tile", "chunk"))
    found = both.applyInArrow(lambda q, e: _reranked(dim, k)(q, e), FOUND)
    ranked = found.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "near"))), 1, k).alias("near"))
    # Rows: equal vectors are at distance 0 of each other, others stand for all their ids. The k + 1 least ids of a class are enough for anyone.
    lists = ranked.select("rep", F.explode("near").alias("x")).select("rep", F.col("x.near").alias("near"), F.col("x.dist").alias("dist"))
    lists = lists.unionByName(asked.select("rep").distinct().select("rep", F.col("rep").alias("near"), F.lit(0.0).alias("dist")))
    full = lists.join(_members(single, classes, k + 1), "near").groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "neighbour_id"))), 1, k + 1).alias("near"))
    own = F.slice(F.filter("near", lambda x: x.neighbour_id != F.col("vec_id")), 1, k)
    out = asked.join(full, "rep").select("vec_id", F.posexplode(own).alias("p", "x"))
    return out.select("vec_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.neighbour_id").alias("neighbour_id"), F.sqrt("x.dist").alias("distance"))


def _members(single: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(near, neighbour_id): the `most` least ids of each class. A class of many rows is cut by hash first, so no task ranks all of them."""
    several = single.join(classes.where("rows > 1").select("v", "rep"), "v").select("rep", "id", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt"))
    for by in (["rep", "salt"], ["rep"]):
        several = several.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("place") <= most)
    alone = classes.where("rows = 1").select(F.col("rep").alias("near"), F.col("rep").alias("neighbour_id"))
    return alone.unionByName(several.select(F.col("rep").alias("near"), F.col("id").alias("neighbour_id")))


def _tiles(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiling = shared.value[3]
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            tile = tiling.of(cell, batch.column("rep").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(tiling.place[cell], pa.int32()), batch.column("rep"), batch.column("v")], names=["tile", "place", "rep", "v"])

    return run


def _budget(entries: DataFrame, one: np.ndarray, two: np.ndarray, counts: np.ndarray, dim: int, k: int, recall: float, calibration: int) -> int:
    """Entries to read: of the true neighbours of the sample, a share of `recall` lie within."""
    sample = entries.orderBy(F.xxhash64("rep"), "rep").limit(calibration).toPandas()
    names = sample.rep.to_numpy()
    q = np.frombuffer(b"".join(map(bytes, sample.v)), dtype=np.float32).reshape(len(names), dim).astype(np.float64)
    shared = entries.sparkSession.sparkContext.broadcast((names, q))
    exact = in_arrow(entries, _exact(shared, dim, k), FOUND)
    top = exact.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "near"))), 1, k).alias("x")).select("rep", F.explode("x.near").alias("near"))
    cells = top.join(entries.select(F.col("rep").alias("near"), "cell"), "near").select("rep", "cell").toPandas()
    row = {r: i for i, r in enumerate(names.tolist())}
    needs = []
    half = dim // 2
    d1, d2 = distances(q[:, :half], one), distances(q[:, half:], two)
    for rep, group in cells.groupby("rep"):
        summed = (d1[row[rep]][:, None] + d2[row[rep]][None, :]).ravel()
        order = np.argsort(summed, kind="stable")
        until = np.cumsum(counts[order])
        needs.extend(until[np.searchsorted(summed[order], summed[group.cell.to_numpy()], side="right") - 1].tolist())
    return int(np.quantile(needs, recall, method="higher")) if needs else 1
