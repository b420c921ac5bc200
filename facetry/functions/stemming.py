"""Dutch stemming (the published Snowball algorithm) and edit distance with transpositions, as Arrow-batched functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands between two values of a field where their tokens are one array.
VALUE_BREAK = "zzvaluebreakzz"
_VOWELS = set("aeiouyè")
_FLAT = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def _region(word: str, start: int) -> int:
    """Place after the first non-vowel that follows a vowel, from `start` on."""
    for i in range(start, len(word) - 1):
        if word[i] in _VOWELS and word[i + 1] not in _VOWELS:
            return i + 2
    return len(word)


def _undouble(word: str) -> str:
    return word[:-1] if word[-2:] in ("kk", "dd", "tt") else word


@lru_cache(1 << 16)
def dutch(word: str) -> str:
    """Stem of one lower-case word."""
    w = word.translate(_FLAT)
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _VOWELS) or c == "i" and 0 < i < len(chars) - 1 and chars[i - 1] in _VOWELS and chars[i + 1] in _VOWELS:
            chars[i] = c.upper()
    w = "".join(chars)
    r1 = _region(w, 0)
    r2 = _region(w, r1)
    r1 = max(r1, 3) if r1 < len(w) else r1

    def valid_s(x: str) -> bool:
        return bool(x) and x[-1] not in _VOWELS and x[-1] != "j"

    def valid_en(x: str) -> bool:
        return bool(x) and x[-1] not in _VOWELS and not x.endswith("gem")

    def drop_en(x: str, ending: str) -> str:
        stem = x[: -len(ending)]
        return _undouble(stem) if len(stem) >= r1 and valid_en(stem) else x

    if w.endswith("heden"):
        if len(w) - 5 >= r1:
            w = w[:-5] + "heid"
    elif w.endswith("ene"):
        w = drop_en(w, "ene")
    elif w.endswith("en"):
        w = drop_en(w, "en")
    elif w.endswith("se"):
        if len(w) - 2 >= r1 and valid_s(w[:-2]):
            w = w[:-2]
    elif w.endswith("s") and len(w) - 1 >= r1 and valid_s(w[:-1]):
        w = w[:-1]
    lost_e = False
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _VOWELS:
        w = _undouble(w[:-1])
        lost_e = True
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en"):
            w = drop_en(w, "en")
    if w.endswith(("end", "ing")) and len(w) - 3 >= r2:
        w = w[:-3]
        w = w[:-2] if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e" else _undouble(w)
    elif w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
        w = w[:-2]
    elif w.endswith("lijk") and len(w) - 4 >= r2:
        w = w[:-4]
        if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _VOWELS:
            w = _undouble(w[:-1])
    elif w.endswith("baar") and len(w) - 4 >= r2:
        w = w[:-4]
    elif w.endswith("bar") and len(w) - 3 >= r2 and lost_e:
        w = w[:-3]
    if len(w) >= 4 and w[-3] == w[-2] and w[-2] in "aeou" and w[-1] not in _VOWELS and w[-1] != "I" and w[-4] not in _VOWELS:
        w = w[:-2] + w[-1]
    return w.lower()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType())])))
def _stemmed(tokens: pa.Array, gap: pa.Array) -> pa.Array:
    # Only the distinct words of a batch become Python objects; tokens are numbers of words throughout.
    coded = tokens.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    stems = [dutch(w) for w in words]
    table = pa.array([*words, *stems], pa.string())
    breaks = np.array([w == VALUE_BREAK for w in words], bool)
    widths = np.array([0 if w == VALUE_BREAK else 1 + (s != w) for w, s in zip(words, stems, strict=True)], np.int8)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    steps = np.where(breaks[at], np.repeat(gap.to_numpy(zero_copy_only=False), sizes), 1)
    before = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    places = (before[:-1] - np.repeat(before[ends[:-1]], sizes)).astype(np.int32)
    width = widths[at]
    starts = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    terms = np.repeat(at, width)
    terms[starts[:-1][width == 2] + 1] += len(words)
    placed = pa.StructArray.from_arrays([table.take(pa.array(terms)), pa.array(np.repeat(places, width))], ["term", "pos"])
    return pa.ListArray.from_arrays(pa.array(starts[ends].astype(np.int32)), placed)


def dutch_tokens(tokens: Column, gap: int = 0) -> Column:
    """(term, pos) of each token and, at the same place, of its stem where that differs. A token VALUE_BREAK is left out; `gap` places lie there."""
    return _stemmed(tokens, F.lit(gap))


def damerau(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours counts once (optimal string alignment)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


@F.pandas_udf(T.IntegerType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int32")
