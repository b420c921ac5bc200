"""Byte-level Kneser-Ney models of words, conditional on a class, over a backoff model that all classes share.

A word is read with byte 1 ahead and byte 2 behind. The top order predicts each byte from up to `order - 1` bytes of
the word so far, with counts of each class. Its discounted mass goes to a Kneser-Ney model of `shared` bytes whose counts
are those of the whole corpus, so an expression that no class has seen gets the same probability in all of them.
A gram of up to 7 bytes is its own 64-bit code: no two grams collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from facetry.llm._text import Words, distinct, padded

COUNTS = "cls int, code long, n long"
COUNT_SCHEMA = pa.schema([("cls", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])


def mask(k: int) -> np.int64:
    return np.int64((1 << (8 * k)) - 1)


def rolled(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Code of the last `order` bytes at each place of each word but its first, in order."""
    at = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    wide = data.astype(np.int64)
    code = wide.copy()
    for k in range(1, order):
        part = np.zeros(len(data), dtype=np.int64)
        part[k:] = wide[:-k] << np.int64(8 * k)
        code += np.where(at >= k, part, 0)
    return code[at >= 1]


def word_codes(words: Words, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the chosen words, one after the other, and the number of each word's codes."""
    data, bounds = padded(words, which, 1, 1)
    return rolled(data, bounds, order), np.diff(bounds) - 1


class Counter:
    """Adds up counts of (class, code) and gives them as Arrow batches."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.held = most, 0
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, cls: int, words: Words, chosen: np.ndarray, order: int) -> None:
        """Counts all words at the places `chosen`."""
        if not len(chosen):
            return
        first, back = distinct(words.hash[chosen])
        codes, length = word_codes(words, chosen[first], order)
        self._put(cls, codes, np.repeat(np.bincount(back), length))

    def _put(self, cls: int, codes: np.ndarray, n: np.ndarray) -> None:
        part = self._sum([(codes, n)])
        self.parts.setdefault(cls, []).append(part)
        self.held += len(part[0])
        if self.held > self.most:
            self.parts = {c: [self._sum(p)] for c, p in self.parts.items()}
            self.held = sum(len(p[0][0]) for p in self.parts.values())
            self.most = max(self.most, 2 * self.held)

    @staticmethod
    def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in parts])
        n = np.concatenate([n for _, n in parts])
        first, back = distinct(codes)
        kinds, total = codes[first], np.bincount(back, weights=n, minlength=len(first)).astype(np.int64)
        order = np.argsort(kinds)
        return kinds[order], total[order]

    def batches(self, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        for cls, parts in self.parts.items():
            codes, n = self._sum(parts)
            for a in range(0, len(codes), rows):
                c = codes[a : a + rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), cls), pa.int32()), pa.array(c, pa.int64()), pa.array(n[a : a + rows], pa.int64())], schema=COUNT_SCHEMA)


def _discount(n: np.ndarray) -> float:
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.75


def _at(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in the sorted table and whether it is there."""
    if not len(table):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    place = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return place, table[place] == codes


class _Level:
    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.n = codes[order], n[order].astype(np.float64)
        self.d = _discount(n)
        context = self.codes >> np.int64(8)
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        self.context = context[begin]
        self.total = np.add.reduceat(self.n, begin) if len(begin) else np.zeros(0)
        self.kinds = np.diff(np.append(begin, len(context))).astype(np.float64)

    def prob(self, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        place, there = _at(self.codes, codes)
        c_place, known = _at(self.context, codes >> np.int64(8))
        if not len(self.codes):
            return lower
        n = np.where(there, np.maximum(self.n[place] - self.d, 0), 0)
        total = np.where(known, self.total[c_place], 1)
        return np.where(known, (n + self.d * self.kinds[c_place] * lower) / total, lower)


class Shared:
    """Kneser-Ney model of `order` bytes from corpus counts: raw counts at the top, numbers of distinct left neighbours below."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        self.levels = [_Level(codes, n)]
        for k in range(order - 1, 0, -1):
            longer = codes > mask(k)
            kept, times = np.unique(codes[longer] & mask(k), return_counts=True)
            merged = Counter._sum([(kept, times), (codes[~longer], n[~longer])])
            codes, n = merged
            self.levels.append(_Level(codes, n))

    def prob(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / 256)
        for k, level in zip(range(1, self.order + 1), reversed(self.levels), strict=True):
            p = level.prob(codes & mask(k), p)
        return p


class ClassModel:
    """log P(word | class) for every class."""

    def __init__(self, shared: Shared, classes: list[tuple[np.ndarray, np.ndarray]], order: int):
        self.shared, self.order = shared, order
        self.tops = [_Level(codes, n) for codes, n in classes]

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """A row of one log-probability a class for each code."""
        lower = self.shared.prob(codes & mask(self.shared.order))
        return np.log(np.stack([top.prob(codes, lower) for top in self.tops], axis=1))


class WordScores:
    """Scores of words by hash. Words are scored once while `most` words are held; later ones are scored each time they come."""

    def __init__(self, model: ClassModel, of, width: int, most: int = 400_000):
        self.model, self.of, self.width, self.most = model, of, width, most
        self.known: dict[int, int] = {}
        self.values = np.zeros((1024, width))

    def score(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Of the distinct words at the places `which`."""
        if not len(which):
            return np.zeros((0, self.width))
        hashes = words.hash[which].tolist()
        get = self.known.get
        place = np.array([get(h, -1) for h in hashes])
        out = np.empty((len(which), self.width))
        old = place >= 0
        out[old] = self.values[place[old]]
        new = np.flatnonzero(~old)
        if len(new):
            codes, length = word_codes(words, which[new], self.model.order)
            distinct, back = np.unique(codes, return_inverse=True)
            each = self.of(self.model.log_probs(distinct))[back]
            out[new] = np.add.reduceat(each, np.cumsum(length) - length, axis=0)
            room = new[: max(0, self.most - len(self.known))]
            if len(room):
                need = len(self.known) + len(room)
                while len(self.values) < need:
                    self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                self.values[len(self.known) : need] = out[room]
                for k, i in enumerate(room.tolist(), len(self.known)):
                    self.known[hashes[i]] = k
        return out


def collect_counts(counts) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Class -> codes and counts of a summed (cls, code, n) DataFrame."""
    table = counts.toArrow()
    cls, code, n = (table.column(c).to_numpy() for c in ("cls", "code", "n"))
    return {int(c): (code[cls == c], n[cls == c]) for c in np.unique(cls)}


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))
