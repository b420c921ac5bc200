"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared as their lower-case words with single spaces, in UTF-8 bytes. A test item of m bytes may differ from a
passage, any part of a text, by an edit distance of up to k = floor(error_rate * m), in bytes. An item so short that k is 0 has
to be there as whole words: "cat" isn't in "concatenate". The item
is split into k + 1 pieces: at least one of them is in the passage unchanged. One Aho-Corasick automaton finds the pieces of all items
in a single run over each whole text. The pieces are leaves of a binary tree whose nodes divide the budget (k = left +
right + 1), so a hit climbs from piece to item: each node is verified by Myers' bit-parallel distance around the hit, and most
chance hits end after a node of two pieces. Where that would cost more than it saves, as in texts that repeat an item,
one run of Myers' algorithm goes over the merged surroundings of all hits. The search is exact: every passage within the budget is found.

Items come to the driver and reach the executors in groups of at most `pieces_per_pass` pieces, with a pass over the
documents for each group, so what is broadcast is bounded however many items there are.

Defined cases: null, empty and word-less texts and items match nothing. Rows without an id pass through `clean` by their
text alone and are left out of `matches`. Repeated rows count once in `matches`. Items of equal text are all reported, and of
several passages of one item the least distance. Very long texts are searched whole, in time about linear in their length. Empty
tables match nothing. Other columns, whatever their names, pass through `clean` and are ignored by `matches`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm._shared import in_arrow, require
from facetry.llm._text import WORD, chunks


def normalised(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Words of each text with single spaces, a character a byte. `data` is lower-case UTF-8."""
    word = WORD[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep = word | before
    flat = np.where(word, data, np.uint8(32))[keep].tobytes().decode("latin-1")
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
    return [flat[a:b].rstrip(" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def normalise(text: str | None) -> str:
    data = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    return normalised(data, np.array([0, len(data)]))[0]


class Pattern:
    """A node of an item's tree: bytes lo:hi with an error budget; a leaf has none."""

    __slots__ = ("budget", "hi", "lo", "masks", "parent", "size")

    def __init__(self, text: str, lo: int, hi: int, budget: int, parent: Pattern | None):
        self.lo, self.hi, self.budget, self.parent, self.size = lo, hi, budget, parent, hi - lo
        self.masks: dict[str, int] = {}
        if budget or parent is None:
            for k, c in enumerate(text[lo:hi]):
                self.masks[c] = self.masks.get(c, 0) | 1 << k

    def distance(self, text: str, enough: int = 0) -> int:
        """Least edit distance between this pattern and any part of the text, or the first found of at most `enough` (Myers 1999, on one integer of as many bits as the pattern has bytes)."""
        m = self.size
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, masks = full, 0, m, m, self.masks.get
        for c in text:
            eq = masks(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(xh | plus))
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
                    if best <= enough:
                        return best
            up = (up << 1) & full
            plus = ((down << 1) & full) | (full & ~(xv | up))
            minus = up & xv
        return best


def pieces(text: str, budget: int) -> list[Pattern]:
    """The budget + 1 leaves of the item's tree."""
    leaves: list[Pattern] = []

    def split(lo: int, hi: int, k: int, parent: Pattern | None) -> None:
        node = Pattern(text, lo, hi, k, parent)
        if not k:
            leaves.append(node)
            return
        left = (k - 1) // 2
        right = k - 1 - left
        cut = lo + (hi - lo) * (left + 1) // (k + 1)
        split(lo, cut, left, node)
        split(cut, hi, right, node)

    split(0, len(text), budget, None)
    return leaves


class Matcher:
    def __init__(self, items: list[tuple[int, str, int]]):
        """items: id, normalised text, budget."""
        found: dict[str, list[tuple[int, Pattern]]] = {}
        for number, (_, text, budget) in enumerate(items):
            text = text if budget else f" {text} "
            for leaf in pieces(text, budget):
                found.setdefault(text[leaf.lo : leaf.hi], []).append((number, leaf))
        self.items = [i for i, _, _ in items]
        self.owners = list(found.values())
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(found):
            self.automaton.add_word(piece, (k, len(piece)))
        self.automaton.make_automaton()

    def matches(self, text: str, any_will_do: bool = False) -> dict[int, int]:
        """Item -> least distance of any of its passages within the budget; with `any_will_do` at most one item, with some distance within."""
        best: dict[int, int] = {}
        if not text:
            return best
        text = f" {text} "
        begins: dict[int, list[int]] = {}
        for end, (piece, length) in self.automaton.iter(text):
            begins.setdefault(piece, []).append(end + 1 - length)
        hits: dict[int, list[tuple[Pattern, list[int]]]] = {}
        for piece, at in begins.items():
            for number, leaf in self.owners[piece]:
                hits.setdefault(number, []).append((leaf, at))
        for number, found in hits.items():
            distance = self._least(text, found, any_will_do)
            if distance is not None:
                item = self.items[number]
                best[item] = min(distance, best.get(item, distance))
                if any_will_do:
                    break
        return best

    @staticmethod
    def _least(text: str, found: list[tuple[Pattern, list[int]]], any_will_do: bool) -> int | None:
        """Least distance of one item, None beyond its budget."""
        root = found[0][0]
        while root.parent is not None:
            root = root.parent
        if not root.budget:
            return 0
        best, room = None, len(text)  # bytes that may be verified hit by hit before one run over all is cheaper
        if 12 * sum(len(at) for _, at in found) <= room:
            checked: set[tuple[int, int]] = set()
            for leaf, begins in found:
                for begin in begins:
                    at = begin - leaf.lo  # where the item begins, but for insertions and deletions
                    node, distance = leaf, 0
                    while distance is not None and node.parent is not None:
                        node = node.parent
                        if (id(node), at) in checked:
                            distance = None
                            break
                        checked.add((id(node), at))
                        k = node.budget
                        room -= node.size + 2 * k
                        distance = node.distance(text[max(0, at + node.lo - k) : at + node.hi + k], k if any_will_do else 0)
                        if distance > k:
                            distance = None
                    if distance is not None:
                        best = distance if best is None else min(best, distance)
                        if any_will_do or not best:
                            return best
                    if room < 0:
                        break
                if room < 0:
                    break
            else:
                return best
        n, k = len(text), root.budget
        change = np.zeros(n + 1, dtype=np.int64)
        for leaf, begins in found:
            at = np.array(begins) - leaf.lo
            change += np.bincount(np.clip(at - k, 0, n), minlength=n + 1)
            change -= np.bincount(np.clip(at + root.size + k, 0, n), minlength=n + 1)
        inside = np.concatenate([[False], np.cumsum(change[:n]) > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            distance = root.distance(text[a:b], k if any_will_do else 0)
            if distance <= k:
                best = distance if best is None else min(best, distance)
                if any_will_do or not best:
                    break
        return best


_built: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    """Built once a worker process for each group of items."""
    name, items = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(items)
    return _built[name]


def _groups(benchmark: DataFrame, item_col: str, text_col: str, error_rate: float, pieces_per_pass: int) -> list[list[tuple[int, str, int]]]:
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).dropna().distinct().toLocalIterator()
    groups: list[list[tuple[int, str, int]]] = []
    room = 0
    for item, text in sorted((tuple(r) for r in rows)):
        plain = normalise(text)
        if not plain:
            continue
        budget = int(error_rate * len(plain))
        if room <= budget:
            groups.append([])
            room = pieces_per_pass
        groups[-1].append((item, plain, budget))
        room -= budget + 1
    return groups


def _check(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, error_rate: float) -> None:
    require(docs, id_col, text_col)
    require(benchmark, item_col, item_text)
    if not 0 <= error_rate < 0.5:
        raise ValueError("error_rate must be in [0, 0.5)")


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error_rate: float = 0.1, pieces_per_pass: int = 200_000) -> DataFrame:
    """(doc_id, item_id, distance): every item that occurs in a document within its budget, with the least distance."""
    _check(docs, benchmark, id_col, text_col, item_col, item_text, error_rate)
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32())])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                ids, found = batch.column("doc_id").to_pylist(), []
                for first, _, data, offsets in chunks(batch, "text"):
                    for k, text in enumerate(normalised(data, offsets), first):
                        found.extend((ids[k], item, d) for item, d in matcher.matches(text).items())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

        return run

    parts = [in_arrow(slim, finder(spark.sparkContext.broadcast((uuid.uuid4().hex, g))), "doc_id long, item_id long, distance int") for g in _groups(benchmark, item_col, item_text, error_rate, pieces_per_pass)]
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, distance int")
    return reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error_rate: float = 0.1, pieces_per_pass: int = 200_000) -> DataFrame:
    """`docs` without the rows that hold an item; columns and other rows stay as they are."""
    _check(docs, benchmark, id_col, text_col, item_col, item_text, error_rate)
    place = docs.columns.index(text_col)

    def filtered(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                only = pa.RecordBatch.from_arrays([batch.column(place)], names=["text"])
                for first, _, data, offsets in chunks(only, "text"):
                    for k, text in enumerate(normalised(data, offsets), first):
                        keep[k] = not matcher.matches(text, any_will_do=True)
                yield batch.filter(pa.array(keep))

        return run

    for group in _groups(benchmark, item_col, item_text, error_rate, pieces_per_pass):
        docs = in_arrow(docs, filtered(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, group))), docs.schema)
    return docs
