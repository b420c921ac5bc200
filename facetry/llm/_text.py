"""Vectorised text primitives shared by the operators: all work on whole Arrow columns, with no Python loop over words.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters, lower-cased. Word hashes are
64-bit polynomial hashes over the UTF-8 bytes, so they are equal on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Texts are handled in groups of about so many bytes, which bounds a worker's memory; a longer text is a group of its own.
CHUNK_BYTES = 2 << 20

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES)
        _pow = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _R, np.uint64)]))
        _inv = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _RINV, np.uint64)]))
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: byte ranges in `data`, the text's index and the hash of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """n_docs + 1 positions: words of text i are bounds[i]:bounds[i+1]."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def raw_bytes(col: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n_docs = len(offsets) - 1
    is_word = WORD[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here, so no word goes across
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, ends, doc, hashes, n_docs)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, back): the first place of each distinct value, and for each value which of these it is. By a hash table, without sorting."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    back, kinds = pd.factorize(values)
    first = np.empty(len(kinds), dtype=np.int64)
    first[back[::-1]] = np.arange(len(values) - 1, -1, -1)
    return first, back


def chunks(batch: pa.RecordBatch, column: str, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of groups of rows of about CHUNK_BYTES."""
    data, offsets = raw_bytes(batch.column(batch.schema.get_field_index(column)), lower)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def chunked_words(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, offsets in chunks(batch, column):
        yield a, b, find_words(data, offsets)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text in order and n_docs + 1 bounds. A text of 1 to n - 1 words has one gram, all its words."""
    bounds = words.bounds()
    count = np.diff(bounds)
    mult = [np.uint64(pow(_R, 2 * k + 3, 1 << 64)) for k in range(n)]
    h = words.hash
    if len(h) >= n:
        rolled = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            rolled += h[k : len(h) - n + 1 + k] * mult[k]
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    full = np.maximum(count - n + 1, 0)
    short = np.flatnonzero((count > 0) & (count < n))
    sizes = full.copy()
    sizes[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(out_bounds[-1], dtype=np.uint64)
    keep = np.zeros(len(rolled) + 1, dtype=np.int64)  # marks the first words of grams inside one text
    has = np.flatnonzero(full > 0)
    np.add.at(keep, bounds[has], 1)
    np.add.at(keep, bounds[has] + full[has], -1)
    inside = rolled[np.cumsum(keep[:-1]) > 0]
    place = np.ones(len(out), dtype=bool)
    place[out_bounds[short]] = False
    out[place] = inside
    for i in short:
        part = h[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = sum((int(x) * int(m) for x, m in zip(part, mult, strict=False)), int(mult[0])) & 0xFFFFFFFFFFFFFFFF
    return mix(out), out_bounds


def padded(words: Words, which: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chosen words, each with `before` bytes 1 ahead and `after` bytes 2 behind, and their bounds."""
    length = words.ends[which] - words.starts[which]
    bounds = np.concatenate([[0], np.cumsum(length + before + after)]).astype(np.int64)
    out = np.empty(bounds[-1], dtype=np.uint8)
    owner = np.repeat(np.arange(len(which)), length)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    for k in range(before):
        out[bounds[:-1] + k] = 1
    for k in range(after):
        out[bounds[1:] - 1 - k] = 2
    out[bounds[owner] + before + place] = words.data[words.starts[which][owner] + place]
    return out, bounds
