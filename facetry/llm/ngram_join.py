"""Near duplicates: n-gram Jaccard join with signature trees.

Every document becomes the set of its word n-grams. Documents with equal sets are one class, which is searched for once.
1. All n-grams of all texts meet in buckets. A class of which less than `threshold` is in other classes too has no similar one
   and goes. Nothing is sampled; a bucket compares 32 more bits of a hash, so a rare clash keeps a class but drops none.
2. Two joins with the same code link most of the classes that are left cheaply. The `sketch` smallest n-gram hashes of a class are
   a sample of its set; classes with similar samples are clusters, see `loosened`, and clusters are joined on the full sets. Of a
   class that needs k common hashes the k - 1 most frequent ones get no block.
3. What samples missed is found by all n-grams. A link between two of the groups so far has at least `threshold` of either set
   in n-grams that several groups have; classes with fewer go, in rounds. Of such n-grams by ascending frequency, the first ones
   of a class, all but the last ceil(threshold * size) - 1, hold one of any pair that is left. Classes which share one of these are
   clusters again, and these are joined on the full sets. So every pair that meets the threshold is in one group.
A join of a block drops n-grams that only one member has and members of which too few n-grams are left; both are exact.
The rest becomes a signature tree, whose nodes hold the OR of their members' bitmaps and their range of set sizes. A dual
traversal drops node pairs whose largest possible overlap is too small or which are connected already, so a block of
copies costs about as many checks as it has members. A block of more than `chunk_rows` is cut by set size. Each part is joined with
itself and with the first one; then every two parts whose sizes allow a match are compared in a task of their own, unless all
members of both are connected by then, as in large groups of copies.

Defined cases: null, empty and word-less texts match nothing. A text of fewer than n words is one n-gram. Very long texts are
read whole. Rows without an id are left out of groups. Repeated rows of one id count once; an id of several texts is in the group of
least id. Ties: a group is named by its least id, which is the one that stays. An empty table has no groups. Other columns,
whatever their names, are ignored by the join and pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.llm._shared import in_arrow, own_name, require, sized, written
from facetry.llm._text import chunked_words, grams, mix

_ONE = np.uint64(1)
#: A bucket of n-grams has about so many; a worker holds one at a time.
BUCKET_GRAMS = 1 << 21


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values."""
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return both / max(1, len(a) + len(b) - both)


class _Tree:
    """Signature tree over members sorted by set size; `shared` are their n-grams that others have too, as dense numbers."""

    def __init__(self, size: np.ndarray, owner: np.ndarray, shared: np.ndarray, bits: int, leaf: int = 32, fan: int = 8):
        n = len(size)
        kinds = int(shared.max()) + 1 if len(shared) else 1
        words = max(1, min(bits, -(-kinds // 64) * 64) // 64)
        self.exact = kinds <= words * 64  # each n-gram has a bit of its own
        bit = (shared % (words * 64)).astype(np.uint64)
        self.maps = np.zeros((n, words), dtype=np.uint64)
        np.bitwise_or.at(self.maps, (owner, (bit >> np.uint64(6)).astype(np.int64)), _ONE << (bit & np.uint64(63)))
        self.size = size
        self.excess = np.bincount(owner, minlength=n) - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        begin = np.arange(0, n, leaf)
        self.levels = [self._nodes(begin, n)]
        while len(begin) > 1:
            begin = begin[::fan]
            self.levels.append(self._nodes(begin, n))
        self.fan = fan

    def _nodes(self, begin: np.ndarray, n: int) -> tuple:
        """First member, past last, bitmap, least size, most size and most excess of each node."""
        end = np.append(begin[1:], n)
        return begin, end, np.bitwise_or.reduceat(self.maps, begin), np.minimum.reduceat(self.size, begin), np.maximum.reduceat(self.size, begin), np.maximum.reduceat(self.excess, begin)


def join_block(sets: list[np.ndarray], threshold: float, bits: int = 4096, sides: np.ndarray | None = None) -> np.ndarray:
    """Component (least member's index) of every set under 'similarity at least threshold'; with sides, only between side 0 and side 1."""
    n = len(sets)
    out = np.arange(n)
    if n == 2:
        out[1] = 0 if similarity(*sets) >= threshold else 1
        return out
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[code] > 1
    members = np.flatnonzero((np.bincount(owner[common], minlength=n) >= threshold * size - 1e-9) & (size > 0))
    if len(members) < 2:
        return out
    order = members[np.argsort(size[members], kind="stable")]
    rank = np.full(n, -1)
    rank[order] = np.arange(len(order))
    kept = common & (rank[owner] >= 0)
    dense = np.cumsum(times > 1) - 1
    tree = _Tree(size[order], rank[owner[kept]], dense[code[kept]], bits)
    side = sides[order] if sides is not None else None
    comp = np.arange(len(order))  # least connected index
    share = threshold / (1 + threshold)
    todo = [(len(tree.levels) - 1, 0, 0)]
    while todo:
        level, x, y = todo.pop()
        begin, end, maps, least, most, excess = tree.levels[level]
        c = comp[begin[x]]
        if (comp[begin[x] : end[x]] == c).all() and (comp[begin[y] : end[y]] == c).all():
            continue
        if most[x] < threshold * least[y] - 1e-9 or most[y] < threshold * least[x] - 1e-9:
            continue
        overlap = min(int(np.bitwise_count(maps[x] & maps[y]).sum()) + min(excess[x], excess[y]), most[x], most[y])
        if overlap < share * (least[x] + least[y]) - 1e-9:
            continue
        if level:
            last = len(tree.levels[level - 1][0])
            kids_x = range(x * tree.fan, min(last, (x + 1) * tree.fan))
            kids_y = range(y * tree.fan, min(last, (y + 1) * tree.fan))
            pairs = [(level - 1, a, b) for a in kids_x for b in kids_y if x != y or a <= b]
            todo.extend(sorted(pairs, key=lambda p: p[1] == p[2]))  # the last are taken first: a node with itself
            continue
        a, b = np.arange(begin[x], end[x]), np.arange(begin[y], end[y])
        both = np.bitwise_count(tree.maps[a][:, None, :] & tree.maps[b][None, :, :]).sum(axis=2).astype(np.int64)
        most_both = np.minimum(both + np.minimum(tree.excess[a][:, None], tree.excess[b][None, :]), np.minimum(tree.size[a][:, None], tree.size[b][None, :]))
        maybe = most_both / np.maximum(1, tree.size[a][:, None] + tree.size[b][None, :] - most_both) >= threshold
        if side is not None:
            maybe &= side[a][:, None] != side[b][None, :]
        while True:
            i, j = np.nonzero(maybe & (comp[a][:, None] != comp[b][None, :]))
            if not len(i):
                break
            p, q = int(a[i[0]]), int(b[j[0]])
            if tree.exact or similarity(sets[order[p]], sets[order[q]]) >= threshold:
                p, q = comp[p], comp[q]
                comp[comp == max(p, q)] = min(p, q)
            else:
                maybe[i[0], j[0]] = False
    root = order[comp]
    least_of = np.full(n, n)
    np.minimum.at(least_of, root, order)
    out[order] = least_of[root]
    return out


def set_hash(s: np.ndarray) -> int:
    """Hash of a sorted set."""
    weight = s * (np.uint64(2) * np.arange(1, len(s) + 1, dtype=np.uint64) + _ONE)
    return int(np.bitwise_xor.reduce(weight ^ (weight >> np.uint64(29))).view(np.int64))


def _sketches(n: int, sketch: int):
    schema = pa.schema([("doc_id", pa.int64()), ("set_hash", pa.int64()), ("size", pa.int32()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, past, words in chunked_words(batch, "text"):
                g, bounds = grams(words, n)
                rows, hashes, sizes, bottoms = [], [], [], []
                for i in range(past - first):
                    if bounds[i] == bounds[i + 1]:
                        continue
                    s = np.unique(g[bounds[i] : bounds[i + 1]])
                    rows.append(first + i)
                    hashes.append(set_hash(s))
                    sizes.append(len(s))
                    bottoms.append(s[:sketch].view(np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)).cast(pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bottoms, pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(n: int):
    """The sorted n-gram hashes of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_hash", pa.int64()), ("size", pa.int32()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, past, words in chunked_words(batch, "text"):
                g, bounds = grams(words, n)
                sets = [np.unique(g[bounds[i] : bounds[i + 1]]) for i in range(past - first)]
                hashes, sizes = [set_hash(s) for s in sets], [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(first, past - first), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


_SPREAD = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("own", pa.binary()), ("root", pa.binary()), ("run", pa.binary())])


def _spread(sets: list[np.ndarray], own: np.ndarray, root: np.ndarray, buckets: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The n-grams of some sets by bucket, as `kind`, with runs of those that come from one set: its hash, its root and their number."""
    if not sum(map(len, sets)):
        return
    g = np.concatenate(sets)
    bucket = ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, g = bucket[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], g[order].astype(kind)
    begin = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])))
    run = np.diff(np.append(begin, len(g))).astype(np.int32)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    end, first, past = np.append(at[1:], len(g)), np.searchsorted(begin, at), np.append(np.searchsorted(begin, at[1:]), len(begin))
    own, root = own[owner[begin]], root[owner[begin]]
    cut = lambda x, a, b: pa.array([x[p:q].tobytes() for p, q in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
    # Where every set is a root of its own, its hash is sent only once.
    roots = pa.nulls(len(at), pa.binary()) if root is own or (root == own).all() else cut(root, first, past)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), cut(g, at, end), cut(own, first, past), roots, cut(run, first, past)], schema=_SPREAD)


def _spread_texts(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, words in chunked_words(batch, "text"):
                g, bounds = grams(words, n)
                sets = [np.unique(g[bounds[i] : bounds[i + 1]]) for i in range(past - first)]
                own = np.array([set_hash(s) for s in sets], dtype=np.int64)
                yield from _spread(sets, own, own, buckets, np.uint32)

    return run


def _spread_sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("grams").to_pylist()]
            yield from _spread(sets, batch.column("set_hash").to_numpy(), batch.column("root").to_numpy(), buckets, np.uint64)

    return run


def _met(kind: type, each: bool):
    """Rows come sorted by bucket. (own, n): how many n-grams of a set are in sets of other roots too; with `each`, these n-grams and how often they come."""

    def shared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        g = np.concatenate([np.frombuffer(r[0], dtype=kind) for r in rows])
        own = np.concatenate([np.frombuffer(r[1], dtype=np.int64) for r in rows])
        root = np.concatenate([np.frombuffer(r[2] if r[2] is not None else r[1], dtype=np.int64) for r in rows])
        run = np.concatenate([np.frombuffer(r[3], dtype=np.int32) for r in rows])
        order = np.argsort(g)
        g, of = g[order], np.repeat(np.arange(len(run), dtype=np.int32), run)[order]
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        times = np.diff(np.append(begin, len(g)))
        root = root[of]
        several = np.repeat(np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin), times)
        if each:
            cols = [own[of[several]], g[several].view(np.int64), np.repeat(times, times)[several]]
        else:
            cols = np.unique(own[of[several]], return_counts=True)
        names = ["own", "gram", "times"] if each else ["own", "n"]
        for k in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "grams", "own", "root", "run")]
            for b, *row in zip(*cols, strict=True):
                if b != bucket and rows:
                    yield from shared(rows)
                    rows = []
                bucket = b
                rows.append(row)
        if rows:
            yield from shared(rows)

    return run


_SPREAD_SQL = "bucket int, grams binary, own binary, root binary, run binary"


def _n_shared(spread: DataFrame, kind: type) -> DataFrame:
    met = in_arrow(spread.repartition("bucket").sortWithinPartitions("bucket"), _met(kind, False), "own long, n long")
    return met.groupBy(F.col("own").alias("set_hash")).agg(F.sum("n").alias("n"))


def _n_buckets(grams: int | None) -> int:
    return max(1, -(-(grams or 0) // BUCKET_GRAMS))


def _blocks(threshold: float):
    """Rows come sorted by block; yields an edge from each member to the least id of its component."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(ids: list[int], side: list[int], raw: list[bytes]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        sides = np.array(side)
        root = join_block(sets, threshold, sides=None if (sides == sides[0]).all() else sides)
        least: dict[int, int] = {}
        for r, i in zip(root.tolist(), ids, strict=True):
            least[r] = min(i, least.get(r, i))
        for r, i in zip(root.tolist(), ids, strict=True):
            if i != least[r]:
                yield least[r], i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, side, raw = None, [], [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "lo", "hi", "side", "doc_id", "grams")]
            for g, lo, hi, s, i, x in zip(*cols, strict=True):
                if (g, lo, hi) != key:
                    if len(ids) > 1:
                        out.extend(edges(ids, side, raw))
                    key, ids, side, raw = (g, lo, hi), [], [], []
                ids.append(i)
                side.append(s)
                raw.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)
                out = []
        if len(ids) > 1:
            out.extend(edges(ids, side, raw))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)

    return run


@F.pandas_udf(T.BinaryType())
def _packed(sample: pd.Series, size: pd.Series, rep: pd.Series) -> pd.Series:
    """The shared hashes of a sample as bytes, filled up to its size with values of its own."""

    def pack(values, n: int, own: int) -> bytes:
        filler = mix(np.uint64(own & 0xFFFFFFFFFFFFFFFF) * np.uint64(64) + np.arange(n - len(values), dtype=np.uint64))
        both = np.concatenate([np.asarray(values, dtype=np.int64).view(np.uint64), filler])
        return np.unique(both).tobytes()

    return pd.Series([pack(v, n, r) for v, n, r in zip(sample, size, rep, strict=True)], dtype=object)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (a, b) connect it with. Rounds of least-label exchange and pointer jumping until nothing changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        labels_next = written(step.join(jump, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")))
        if not labels_next.where("old <> root").limit(1).count():
            return labels_next.select("node", "root")
        labels = labels_next.select("node", "root")


def loosened(threshold: float, sketch: int, sure: float = 0.985) -> float:
    """Similarity of samples that a pair at `threshold` reaches with at least this probability: each sample hash of the union is common with that chance."""
    common, missed = 0, 0.0
    while common < sketch:
        missed += comb(sketch, common) * threshold**common * (1 - threshold) ** (sketch - common)
        if missed > 1 - sure:
            break
        common += 1
    return max(1, common) / (2 * sketch - max(1, common))


def _chunked(members: DataFrame, chunk_rows: int) -> DataFrame:
    """`members` (key, rep, size, ..., a table) with the chunk of each row: parts of a block by ascending size, of about `chunk_rows` rows. Rows of equal size are cut by hash, so no task ranks a block."""
    large = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows)
    if not large.limit(1).count():
        return members.withColumn("chunk", F.lit(0))
    cell = members.join(large, "key").select("key", "size", "rep", F.pmod(F.xxhash64("rep"), F.ceil(4 * F.col("n") / chunk_rows)).alias("cell"))
    before = F.sum("rows").over(Window.partitionBy("key").orderBy("size", "cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cell.groupBy("key", "size", "cell").agg(F.count("*").alias("rows")).select("key", "size", "cell", F.floor(F.coalesce(before, F.lit(0)) / chunk_rows).cast("int").alias("chunk"))
    placed = cell.join(cells, ["key", "size", "cell"]).select("key", "rep", "chunk")
    return written(members.join(placed, ["key", "rep"], "left").select(*members.columns, F.coalesce("chunk", F.lit(0)).alias("chunk")))


def _linked(placed: DataFrame, members: DataFrame, threshold: float, size_ratio: float) -> DataFrame:
    """Edges within blocks. `placed`: key, chunk, doc_id, grams; `members`: key, chunk, size, rep of the same rows."""
    parts = members.groupBy("key", "chunk").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("n"))
    several = parts.where("chunk > 0").select("key").distinct()
    whole = parts.join(several, "key", "left_anti").where("n > 1").select("key", "chunk", F.col("chunk").alias("lo"), F.col("chunk").alias("hi"))
    cut = written(parts.join(several, "key"))
    right = cut.select("key", F.col("chunk").alias("hi"), F.col("least").alias("least_hi"))
    pairs = cut.withColumnRenamed("chunk", "lo").join(right, "key").where("lo <= hi").where(F.col("most") >= size_ratio * F.col("least_hi") - 1e-9).select("key", "lo", "hi")

    def joined(tasks: DataFrame) -> DataFrame:
        tasks = written(tasks)
        work = placed.join(sized(tasks, tasks.count(), 60), ["key", "chunk"]).select("key", "lo", "hi", (F.col("chunk") == F.col("hi")).cast("int").alias("side"), "doc_id", "grams")
        return in_arrow(work.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "doc_id"), _blocks(threshold), "a long, b long")

    def sides(some: DataFrame) -> DataFrame:
        return some.select("key", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("chunk"))

    first = joined(whole.unionByName(sides(pairs.where("lo = hi or lo = 0"))))
    rest = pairs.where("lo < hi and lo > 0")
    if not rest.limit(1).count():
        return first
    first = written(first)
    root = F.coalesce("root", "rep")
    known = members.join(several, "key", "left_semi").join(components(first), F.col("rep") == F.col("node"), "left").groupBy("key", "chunk").agg(F.min(root).alias("least"), F.max(root).alias("most"))
    of = [known.select("key", F.col("chunk").alias(c), F.col("least").alias(f"least_{c}"), F.col("most").alias(f"most_{c}")) for c in ("lo", "hi")]
    rest = rest.join(of[0], ["key", "lo"]).join(of[1], ["key", "hi"]).where("least_lo <> most_lo or least_hi <> most_hi or least_lo <> least_hi")
    return first.unionByName(joined(sides(rest.select("key", "lo", "hi"))))


def _in_clusters(clusters: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float, chunk_rows: int) -> DataFrame:
    """Edges between the classes of each cluster (node, root), by their full sets."""
    members = clusters.join(classes.select("rep", "size"), F.col("node") == F.col("rep")).select(F.col("root").alias("key"), "rep", "size")
    members = _chunked(written(members), chunk_rows)
    placed = sets.select("doc_id", "grams").join(sized(members.select(F.col("rep").alias("doc_id"), "key", "chunk"), members.count(), 60), "doc_id")
    return _linked(placed.select("key", "chunk", "doc_id", "grams"), members, threshold, threshold)


def _completed(roots: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float, chunk_rows: int) -> DataFrame:
    """`roots` (node, root) with every link between different roots that meets the threshold."""
    root = classes.select("set_hash", "size", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    left = written(root.select("set_hash", "size", "rep", F.coalesce("root", "rep").alias("root")))
    n_left, needed = left.count(), F.lit(threshold) * F.col("size") - 1e-9

    def spread() -> DataFrame:
        buckets = _n_buckets(left.agg(F.sum(F.col("size").cast("long"))).first()[0])
        with_root = sets.select("set_hash", "grams").join(sized(left.select("set_hash", "root"), n_left, 60), "set_hash")
        return in_arrow(with_root.select("set_hash", "root", "grams"), _spread_sets(buckets), _SPREAD_SQL)

    while True:
        before = n_left
        left = written(left.join(_n_shared(spread(), np.uint64), "set_hash").where(F.col("n") >= needed).drop("n"))
        n_left = left.count()
        if not n_left:
            return roots
        if n_left > 0.8 * before:
            break
    met = in_arrow(spread().repartition("bucket").sortWithinPartitions("bucket"), _met(np.uint64, True), "own long, gram long, times long")
    of = met.groupBy(F.col("own").alias("set_hash")).agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("by"))
    n_first = F.greatest(F.size("by") - F.ceil(needed).cast("int") + 1, F.lit(0))
    first = of.join(left, "set_hash").select("size", "rep", F.explode(F.slice("by", F.lit(1), n_first)).alias("e")).select("size", "rep", "e.gram")
    # Of the classes of an n-gram by size, those of similar sizes are next to each other.
    by_size = Window.partitionBy("gram").orderBy("size", "rep")
    chain = first.select(F.lag("rep").over(by_size).alias("a"), F.col("rep").alias("b"), "size", F.lag("size").over(by_size).alias("smaller")).where(F.col("smaller") >= needed)
    more = written(_in_clusters(components(chain.select("a", "b")), sets, left, threshold, chunk_rows))
    if not more.limit(1).count():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, sketch: int = 16, chunk_rows: int = 10_000) -> DataFrame:
    """(doc_id, group_id, n_linked) of every document that has a near duplicate: the least id of its group, and how many other documents it is linked with, directly or through others."""
    require(docs, id_col, text_col)
    if not 0 < threshold <= 1 or min(n, sketch, chunk_rows) < 1:
        raise ValueError("threshold must be in (0, 1]; n, sketch and chunk_rows positive")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    prints = written(in_arrow(slim, _sketches(n, sketch), "doc_id long, set_hash long, size int, sketch array<long>"))
    classes = written(prints.groupBy("set_hash", "size").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")))
    # All n-grams: a class that may have a similar one has enough of them in common with others. Each copy of a text counts its own.
    total = prints.agg(F.sum(F.col("size").cast("long"))).first()[0]
    met = _n_shared(in_arrow(slim.select("text"), _spread_texts(n, _n_buckets(total)), _SPREAD_SQL), np.uint32)
    alive = written(classes.join(met, "set_hash").where(F.col("n") >= F.lit(threshold) * F.col("size") * F.col("copies") - 1e-9).select("set_hash", "size", "rep", "sketch"))
    known = slim.join(sized(alive.select(F.col("rep").alias("doc_id")).distinct(), alive.count(), 40), "doc_id")
    sets = written(in_arrow(known, _sets(n), "doc_id long, set_hash long, size int, grams binary"))
    loose = loosened(threshold, sketch)
    # Join 1: samples, in blocks of shared hashes. Counts first, so a frequent hash is no task of its own.
    entries = alive.select("rep", F.size("sketch").alias("size"), F.explode("sketch").alias("gram"))
    counts = written(entries.groupBy("gram").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("n > 1"))
    shared = entries.join(sized(counts, counts.count(), 60), "gram")
    found = shared.groupBy("rep", "size").agg(F.array_sort(F.collect_list(F.struct("n", "members", "gram"))).alias("blocks"))
    # A similar pair has `least` hashes of either side in common; the rarest of these is not among the last least - 1 of either.
    least = F.greatest(F.ceil(F.lit(loose) * F.col("size") - 1e-9), F.lit(1))
    rarest = F.slice("blocks", 1, F.greatest(F.size("blocks") - least + 1, F.lit(0)).cast("int"))
    # Blocks of the same members compare the same pairs: the first is enough.
    first = F.filter(rarest, lambda b, i: (i == 0) | (b.n != F.get("blocks", F.greatest(i - 1, F.lit(0))).n) | (b.members != F.get("blocks", F.greatest(i - 1, F.lit(0))).members))
    sample = F.transform("blocks", lambda b: b.gram)
    joined = found.select("rep", "size", sample.alias("sample"), F.explode(first).alias("b")).select(F.col("b.gram").alias("key"), "rep", "size", "sample")
    joined = _chunked(written(joined), chunk_rows)
    near = _linked(joined.select("key", "chunk", F.col("rep").alias("doc_id"), _packed("sample", "size", "rep").alias("grams")), joined, loose, loose)
    # Join 2: full sets, in the clusters that join 1 links. Then what the samples missed.
    roots = components(_in_clusters(components(near), sets, alive, threshold, chunk_rows))
    roots = _completed(roots, sets, alive, threshold, chunk_rows)
    own = prints.select("doc_id", "set_hash", "size").distinct()
    rep = own.join(classes.select("set_hash", "size", "rep"), ["set_hash", "size"]).select("doc_id", "rep")
    grouped = rep.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("group_id"))
    # An id that stands for several texts may be in several groups: the least is its group.
    one = written(grouped.groupBy("doc_id").agg(F.min("group_id").alias("group_id")))
    groups = one.groupBy("group_id").agg((F.count("*") - 1).alias("n_linked")).where("n_linked > 0")
    return one.join(groups, "group_id").select("doc_id", "group_id", "n_linked")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """`docs` with one document of each group, that of the least id. All columns and all other rows stay."""
    key, text = params.get("id_col", "doc_id"), params.get("text_col", "text")
    gone_name, again_name = own_name(docs, "gone"), own_name(docs, "again")
    pairs = written(near_duplicates(docs, **params))
    gone = pairs.where("doc_id <> group_id").select(F.col("doc_id").alias(gone_name))
    kept = docs.join(sized(gone, gone.count(), 40), F.col(key).cast("long") == F.col(gone_name), "left_anti")
    again = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(again_name)).count().where("count > 1").select(again_name)
    again = written(again)
    n_again = again.count()
    if not n_again:
        return kept
    repeated = F.col(key).cast("long") == F.col(again_name)
    again = sized(again, n_again, 40)
    return kept.join(again, repeated, "left_anti").unionByName(kept.join(again, repeated, "left_semi").dropDuplicates([key, text]))


__all__ = ["components", "join_block", "keep_one", "loosened", "near_duplicates", "similarity"]
