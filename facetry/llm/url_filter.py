"""URL filters: character language-model ratio.

Two smoothed variable-order Markov models of URL bytes, of accepted and of rejected URLs. URLs are lower-cased, their digits
read as 0, with byte 1 ahead and byte 2 behind. A model predicts each byte from up to `order - 1` bytes before it: from
the longest context seen at least `min_context` times, each order blending its counts with the next lower one's
probability, which weighs as much as `strength` counts. The lowest order is the byte distribution of all URLs, labelled or not, so
both models share it. The score of a URL is (log P(url | rejected) - log P(url | accepted)) / its number of bytes.

Hosts, not URLs, are split into folds; where either side of that split lacks a class, as with few hosts, URLs are split instead. The
models of four fifths score the held-out fifth; the threshold is set on it so that at most `max_false_rate` of its accepted
URLs are rejected. The final models have all folds. Where even single URLs can't be split, the threshold is a ratio of 1.

Without labels of URLs `weak_labels` makes them: a host with a part that is one of the seed words is rejected, any other accepted.
Counts come from all labelled rows and are kept in full, so the driver and the executors hold 16 bytes for each distinct byte gram of a
class. A caller may bound that with `max_rows`: then about so many rows of each class, those of least hash, are counted, and the byte
distribution is still that of all rows.

Defined cases: a null or empty URL scores 0 and is kept. Null labels train nothing; without both classes, as in an empty table,
nothing is rejected. Very long URLs are read whole. Rows without an id are scored like others and repeated rows each; equal URLs have
equal scores, and a score equal to the threshold is rejected. Extra columns are ignored by `scored` and kept by `keep`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm._kn import COUNTS, NONE, Counter, collect_counts, mask, rolled
from facetry.llm._shared import in_arrow, require
from facetry.llm._text import chunks

#: Parts of host names that mark a URL as rejected where no labels are given.
SEEDS = ("adult", "porn", "xxx", "sex", "casino", "poker", "bet", "bets", "gambling", "pills", "viagra", "pharma", "spam", "ads", "adserver", "tracker", "malware", "warez", "torrent")
FOLDS = 5


def weak_labels(url: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    """1 where a part of the host is a seed word, 0 elsewhere, null for a null or empty URL."""
    parts = F.split(F.lower(host(url)), r"[^a-z0-9]+")
    return F.when(url.isNull() | (url == ""), None).otherwise(F.arrays_overlap(parts, F.array(*map(F.lit, seeds))).cast("int"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each non-empty URL with 1 ahead and 2 behind, and their bounds; digits are 0. `data` is lower-case."""
    length = np.diff(offsets)
    some = length > 0
    begin, length = offsets[:-1][some], length[some]
    bounds = np.concatenate([[0], np.cumsum(length + 2)]).astype(np.int64)
    out = np.full(bounds[-1], 1, dtype=np.uint8)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    plain = data[np.repeat(begin, length) + place]
    out[np.repeat(bounds[:-1] + 1, length) + place] = np.where((plain >= 48) & (plain <= 57), np.uint8(48), plain)
    out[bounds[1:] - 1] = 2
    return out, bounds


class Level:
    """Counts of one order: probabilities of bytes after contexts of order - 1 bytes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, min_context: int, strength: float):
        keep = np.argsort(codes, kind="stable")
        codes, n = codes[keep], n[keep].astype(np.float64)
        context = codes >> np.int64(8)
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(codes) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, begin) if len(begin) else np.zeros(0)
        often = total >= min_context
        of = np.repeat(often, np.diff(np.append(begin, len(codes))))
        self.codes, self.n, self.strength = codes[of], n[of], strength
        self.context, self.total = context[begin][often], total[often]

    def prob(self, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return lower
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        n = np.where(self.codes[place] == codes, self.n[place], 0.0)
        at = codes >> np.int64(8)
        where = np.minimum(np.searchsorted(self.context, at), len(self.context) - 1)
        known = self.context[where] == at
        return np.where(known, (n + self.strength * lower) / (self.total[where] + self.strength), lower)


class Markov:
    def __init__(self, codes: np.ndarray, n: np.ndarray, base: np.ndarray, order: int, min_context: int, strength: float):
        self.base, self.levels = base, []
        for k in range(order, 0, -1):
            codes, n = Counter._sum([(codes & mask(k), n)])
            self.levels.append(Level(codes, n, min_context if k > 1 else 1, strength))

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        p = self.base[codes & np.int64(255)]
        for k, level in enumerate(reversed(self.levels), 1):
            p = level.prob(codes & mask(k), p)
        return np.log(p)


@dataclass
class Model:
    accepted: Markov | None
    rejected: Markov | None
    order: int
    threshold: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each URL; 0 for an empty one."""
        out = np.zeros(len(offsets) - 1)
        some = np.flatnonzero(np.diff(offsets) > 0)
        if self.accepted is None or not len(some):
            return out
        padded, bounds = encoded(data, offsets)
        codes = rolled(padded, bounds, self.order)
        length = np.diff(bounds) - 1
        distinct, back = np.unique(codes, return_inverse=True)
        each = (self.rejected.log_prob(distinct) - self.accepted.log_prob(distinct))[back]
        out[some] = np.add.reduceat(each, np.cumsum(length) - length) / length
        return out


def _counts(order: int):
    """Counts of byte grams: cls is 3 * held-out + (0 accepted, 1 rejected), and 9 for the bytes of all rows; rows of cls 2 and 5 have no label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            cls, chosen = batch.column("cls").to_numpy(), batch.column("fits").to_numpy(zero_copy_only=False)
            for first, past, data, offsets in chunks(batch, "url"):
                length = np.diff(offsets)
                padded, bounds = encoded(data, offsets)
                codes = rolled(padded, bounds, order)
                of = np.repeat(np.where(chosen[first:past], cls[first:past], 2)[length > 0], length[length > 0] + 1)
                byte, n = np.unique(codes & np.int64(255), return_counts=True)
                counter._put(9, byte, n)
                for c in np.unique(of).tolist():
                    if c % 3 < 2:
                        counter._put(c, codes[of == c], np.ones(int((of == c).sum()), np.int64))
        yield from counter.batches()

    return run


def fit(pages: DataFrame, labels: Column | None = None, *, url_col: str = "url", order: int = 6, min_context: int = 3, strength: float = 4.0, max_rows: int | None = None, max_false_rate: float = 0.005) -> Model:
    """Models of all labelled rows, or with `max_rows` of about so many of each class; `labels` is 1 where a URL is rejected, 0 where accepted, and defaults to `weak_labels`."""
    require(pages, url_col)
    if not 1 <= order <= 7:
        raise ValueError("order must be between 1 and 7")
    url = F.col(url_col).cast("string")
    label = weak_labels(url) if labels is None else labels.cast("int")
    label = F.coalesce(F.when(label.isin(0, 1), label), F.lit(2))
    folds = [(F.pmod(F.xxhash64(x), F.lit(FOLDS)) == 0).cast("int") for x in (F.lower(host(url)), F.concat(F.lit("fold"), url))]
    slim = pages.select(url.alias("url"), label.alias("label"), *(f.alias(f"held{k}") for k, f in enumerate(folds))).where("url <> ''")
    sizes = slim.groupBy("label", "held0", "held1").count().collect()
    n_of = [sum(r["count"] for r in sizes if r.label == c) for c in (0, 1)]
    if not all(n_of):
        return Model(None, None, order, np.inf)
    by_fold = [k for k in (0, 1) if len({(r.label, r[f"held{k}"]) for r in sizes if r.label < 2}) == 4]
    held = F.col(f"held{by_fold[0]}") if by_fold else F.lit(0)
    fits = F.col("label") < 2
    for c, n in enumerate(n_of if max_rows is not None else ()):
        fits = F.when(F.col("label") == c, F.pmod(F.xxhash64(F.lit("fit"), "url"), F.lit(1 << 20)) < round(min(1.0, max_rows / n) * (1 << 20))).otherwise(fits)
    slim = slim.select("url", (3 * held + F.col("label")).cast("int").alias("cls"), fits.alias("fits"))
    by = collect_counts(in_arrow(slim, _counts(order), COUNTS).groupBy("cls", "code").agg(F.sum("n").alias("n")))
    if not all(k in by for k in (0, 1)):
        return Model(None, None, order, np.inf)
    base = np.ones(256)
    base[by[9][0]] += by[9][1]
    base /= base.sum()
    make = lambda codes, n: Markov(codes, n, base, order, min_context, strength)
    model = Model(make(*by[0]), make(*by[1]), order, 1e-9)
    if by_fold:
        held_rows = in_arrow(slim.where("cls in (3, 4) and fits"), _score(pages, model, ["cls"]), "cls int, score double")
        # The cut needs the distribution of scores alone: counts of scores rounded to 1e-4 are enough and stay small.
        bins = held_rows.groupBy("cls", F.round("score", 4).alias("score")).count().toPandas()
        if set(bins.cls) == {3, 4}:
            model.threshold = cut(bins.score.to_numpy(), bins.cls.to_numpy() == 4, bins["count"].to_numpy(), max_false_rate)
        both = [Counter._sum([by[c], by.get(c + 3, NONE)]) for c in (0, 1)]
        model.accepted, model.rejected = make(*both[0]), make(*both[1])
    return model


def cut(score: np.ndarray, bad: np.ndarray, n: np.ndarray, max_false_rate: float) -> float:
    """The cut of the fewest errors, each class weighing as much, that keeps to the false rate; of equals the middle one. Always above 0. `n`: how often each score comes."""
    values = np.unique(score[score > 0])
    if not len(values):
        return np.inf
    cuts = np.append((np.append(0.0, values[:-1]) + values) / 2, values[-1] * 1.01)
    order = np.argsort(score, kind="stable")

    def above(of: np.ndarray) -> np.ndarray:
        left = np.append(np.cumsum((n * of)[order][::-1])[::-1], 0)
        return left[np.searchsorted(score[order], cuts)] / max(1, n[of].sum())

    false, missed = above(~bad), 1 - above(bad)
    cost = false + missed + np.where(false > max_false_rate, 2.0, 0.0)
    best = cuts[cost <= cost.min() + 1e-12]
    return float(best[len(best) // 2])


def _score(pages: DataFrame, model: Model, names: list[str]):
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            scores = [np.zeros(0), *(here.score(data, offsets) for _, _, data, offsets in chunks(batch, "url"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(scores))], names=[*names, "score"])

    return run


def scored(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, score, rejected) of every row."""
    require(pages, id_col, url_col)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    raw = in_arrow(slim, _score(pages, model, ["page_id"]), "page_id long, score double")
    return raw.withColumn("rejected", F.col("score") >= F.lit(model.threshold))


def filtered(pages: DataFrame, **params) -> DataFrame:
    """Score and verdict of every page, by models of weakly labelled pages."""
    return scored(pages, fit(pages, **params))


def keep(pages: DataFrame, model: Model, *, url_col: str = "url") -> DataFrame:
    """`pages` without the rejected rows; columns and other rows stay as they are."""
    require(pages, url_col)
    place, score, least = pages.columns.index(url_col), _score(pages, model, []), model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string())], names=["url"])
            yield batch.filter(pa.array(next(iter(score(iter([only])))).column("score").to_numpy() < least))

    return in_arrow(pages, run, pages.schema)
