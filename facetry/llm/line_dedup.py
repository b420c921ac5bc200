"""Line dedup: pairwise alignment of documents that share rare lines.

A document is the list of its lines that hold a word, each known by the hash of its words. Wherever consecutive lines of at
least `block_words` words together all occur in several documents, the shortest such run from each line on is a candidate
passage. Its rarest line, that of the fewest documents, stands for it: documents in which one rare line stands for
the same run overlap there. For every run a document is paired with the first document that has it, so pairs grow with the number of
lines however many copies a passage has, and no line is too common to count. Each pair is aligned by patience diff:
lines that both hold once, in their longest common order, are anchors, between which the same is done again, and anchors grow
over equal neighbours. Aligned common blocks of at least `block_words` words are deleted from the later document. Where
the alignment leaves a run that the earlier document has too, as of a passage that it repeats or has in another order, the
longest common blocks are searched for wherever they lie in both (suffix automaton), and those of enough words go as well.

Order is by id, and by text hash among rows of one id. The first document of a deleted block keeps its lines, so at least one copy
of every line stays.

Defined cases: null, empty and word-less texts and rows without an id stay as they are. Repeated rows of one id and text are one
document, all of which lose the same lines. Very long texts are aligned whole. Ties: of equally rare lines the one of least hash stands for a
run, of documents with equal ids the one of least text hash is the earlier. Lines without words are kept. An empty table stays empty. Other
columns, whatever their names, pass through `clean` and are ignored by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm._shared import in_arrow, measured, own_name, require, sized, written
from facetry.llm._text import chunks, find_words, mix

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, hash, words) of every line that holds a word. `data` is lower-case."""
    breaks = np.flatnonzero(data == 10)
    words = find_words(data, offsets)
    if not len(words.hash):
        return (np.zeros(0, np.int64),) * 4
    global_line = np.searchsorted(breaks, words.starts)  # line breaks before a word, over all texts
    first_line = np.searchsorted(breaks, offsets[:-1])
    begin = np.flatnonzero(np.append(True, (words.doc[1:] != words.doc[:-1]) | (global_line[1:] != global_line[:-1])))
    n = np.diff(np.append(begin, len(words.hash)))
    place = np.arange(len(words.hash)) - np.repeat(begin, n)
    with np.errstate(over="ignore"):
        weight = mix((place + 1).astype(np.uint64) * _MULT)
        total = mix(np.add.reduceat(mix(words.hash ^ weight), begin) + n.astype(np.uint64))
    doc = words.doc[begin]
    return doc, global_line[begin] - first_line[doc], total.view(np.int64), n


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, th = batch.column("doc_id"), batch.column("th")
        for first, _, data, offsets in chunks(batch, "text"):
            doc, _, h, n = line_hashes(data, offsets)
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            ends = np.append(at, len(doc)).astype(np.int32)
            rows = pa.array(first + doc[at])
            yield pa.RecordBatch.from_arrays([ids.take(rows), th.take(rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(h)), pa.ListArray.from_arrays(pa.array(ends), pa.array(n.astype(np.int32)))], names=["doc_id", "th", "h", "n"])


def _runs(block_words: int):
    """Rows: the shared lines of a document in order. Yields the rarest line and the hash of the shortest run of enough words from each line on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "th", "lines")]
            for doc, th, lines in zip(*cols, strict=True):
                pos = [x["pos"] for x in lines]
                h, n, df = ([x[k] for x in lines] for k in ("h", "n", "df"))
                total, b = 0, 0
                for a in range(len(pos)):
                    if b <= a:
                        b, total = a, 0
                    while total < block_words and b < len(pos) and (b == a or pos[b] == pos[b - 1] + 1):
                        total += n[b]
                        b += 1
                    if total >= block_words:
                        rare = min(range(a, b), key=lambda k: (df[k], h[k]))
                        out.append((doc, th, h[rare], hash(tuple(h[a:b]))))
                    total -= n[a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "th", "rare", "run"])

    return run


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the aligned common blocks by patience diff, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a = _once(a, a0, a1)
        once_b = _once(b, b0, b1)
        pairs = [(i, once_b[x]) for x, i in once_a.items() if x in once_b]
        anchors = _increasing(pairs)
        if not anchors:
            continue
        last_a, last_b = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((last_a, i, last_b, j))
            if i < a1:
                found.append((i, j))
            last_a, last_b = i + 1, j + 1
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(found):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    """Place of each value that is in x[lo:hi] once, in order of places."""
    place: dict[int, int] = {}
    for k in range(lo, hi):
        place[x[k]] = -1 if x[k] in place else k
    return {v: k for v, k in place.items() if k >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second values, by patience sorting; first values come in order."""
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p:
            before[k] = piles[p - 1]
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _shortest_runs(h: list[int], n: list[int], block_words: int) -> Iterator[tuple[int, int]]:
    """Bounds of the shortest run of at least `block_words` words from each line on."""
    total, b = 0, 0
    for a in range(len(h)):
        while total < block_words and b < len(h):
            total += n[b]
            b += 1
        if total < block_words:
            return
        yield a, b
        total -= n[a]


def moved_blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(start, length) in a of the longest blocks that lie anywhere in b, by a suffix automaton of b."""
    step: list[dict[int, int]] = [{}]
    link, most, last = [-1], [0], 0
    for x in b:
        new = len(step)
        step.append({})
        link.append(0)
        most.append(most[last] + 1)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if most[q] > most[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                most.append(most[p] + 1)
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    out: list[tuple[int, int]] = []
    at, length = 0, 0
    for i, x in enumerate(a):
        while at and x not in step[at]:
            at = link[at]
            length = most[at]
        if x in step[at]:
            at, length = step[at][x], length + 1
        if length:
            start = i + 1 - length
            if out and out[-1][0] == start:
                out[-1] = (start, length)  # the same block, longer
            else:
                out.append((start, length))
    return out


def _aligned(block_words: int):
    """Rows: a later document's lines and those of an earlier one. Yields the numbers (among its lines with words) of the lines to delete."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, gone = [], [], []
            for doc, th, h, n, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "h", "n", "h_first")), strict=True):
                lines: set[int] = set()
                for i, _, length in common_blocks(h, first):
                    if sum(n[i : i + length]) >= block_words:
                        lines.update(range(i, i + length))
                words = dict(zip(h, n, strict=True))
                there = {tuple(first[a:b]) for a, b in _shortest_runs(first, [words.get(x, 0) for x in first], block_words)}
                if any(tuple(h[a:b]) in there and not lines.issuperset(range(a, b)) for a, b in _shortest_runs(h, n, block_words)):
                    for i, length in moved_blocks(h, first):
                        if sum(n[i : i + length]) >= block_words:
                            lines.update(range(i, i + length))
                if lines:
                    ids.append(doc)
                    ths.append(th)
                    gone.append(sorted(lines))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, ths, gone), schema.types, strict=True)], schema=schema)

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines `gone`, and the line numbers of those, from 0."""
    for batch in batches:
        numbers: list[list[int]] = []
        texts: list[str] = []
        gone = batch.column("gone").to_pylist()
        raw = batch.column("text").to_pylist()
        for first, past, data, offsets in chunks(batch, "text"):
            doc, line, _, _ = line_hashes(data, offsets)
            bounds = np.searchsorted(doc, np.arange(past - first + 1))
            for k in range(first, past):
                own = line[bounds[k - first] : bounds[k - first + 1]]
                out = set(own[gone[k]].tolist())
                numbers.append(sorted(out))
                texts.append("\n".join(x for i, x in enumerate(raw[k].split("\n")) if i not in out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(numbers, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "th", "deleted", "text"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id is not null and text <> ''")


def _changed(docs: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    """(doc_id, th, deleted, text) of every changed document."""
    require(docs, id_col, text_col)
    if block_words < 1:
        raise ValueError("block_words must be positive")
    slim = _keyed(docs, id_col, text_col)
    seqs = written(in_arrow(slim, _lines, "doc_id long, th long, h array<long>, n array<int>").dropDuplicates(["doc_id", "th"]))
    lines = seqs.select("doc_id", "th", F.posexplode(F.arrays_zip("h", "n")).alias("pos", "x")).select("doc_id", "th", "pos", "x.h", "x.n")
    df = lines.select("doc_id", "th", "h").distinct().groupBy("h").agg(F.count("*").alias("df"))
    common = written(df.where("df > 1"))
    shared = lines.join(sized(common, common.count(), 40), "h")
    by_doc = shared.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "n", "df"))).alias("lines"))
    runs = written(in_arrow(by_doc, _runs(block_words), "doc_id long, th long, rare long, run long").distinct())
    me, first = F.struct("doc_id", "th"), F.struct(F.col("first.doc_id"), F.col("first.th"))
    firsts = runs.groupBy("rare", "run").agg(F.min(me).alias("first"), F.count("*").alias("n_docs")).where("n_docs > 1").drop("n_docs")
    pairs = written(runs.join(firsts, ["rare", "run"]).where(me > first).select("doc_id", "th", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th")).distinct())
    earlier = seqs.select(F.col("doc_id").alias("first_id"), F.col("th").alias("first_th"), F.col("h").alias("h_first"))
    work = pairs.join(seqs, ["doc_id", "th"]).join(earlier, ["first_id", "first_th"]).select("doc_id", "th", "h", "n", "h_first")
    gone = in_arrow(work, _aligned(block_words), "doc_id long, th long, gone array<int>").groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    gone = written(gone)
    texts = slim.join(measured(gone, F.lit(60) + 4 * F.size("gone")), ["doc_id", "th"]).select("doc_id", "th", "text", "gone")
    return in_arrow(texts, _without, "doc_id long, th long, deleted array<int>, text string")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = 30) -> DataFrame:
    """(doc_id, deleted, text) of every row that loses lines: their numbers from 0 and what is left of the text."""
    return _changed(docs, id_col, text_col, block_words).select("doc_id", "deleted", "text")


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = 30) -> DataFrame:
    """All of `docs`, later copies of blocks deleted from `text_col`; other columns and rows stay as they are."""
    names = [own_name(docs, n) for n in ("id", "hash", "new")]
    changed = written(_changed(docs, id_col, text_col, block_words).select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "th", "text"), names, strict=True))).dropDuplicates(names[:2]))
    same = (F.col(id_col).cast("long") == F.col(names[0])) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(names[1]))
    return docs.join(changed, same, "left").withColumn(text_col, F.coalesce(F.col(names[2]), F.col(text_col))).select(*docs.columns)
