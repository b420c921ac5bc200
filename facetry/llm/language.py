"""Language ID of spans: script ranges, byte models of words, Viterbi with a switching penalty.

For each language the counts of the last `ORDER` bytes of a word, from the labelled rows of least hash, about
`max_rows_per_language` of them, are a Kneser-Ney model over a backoff model of all documents, labelled or not, of `SHARED_ORDER`
bytes. So what the executors get is bounded: by those rows, and by the 2 ** 24 grams of three bytes. A word's script, by the
range of its first letter, narrows its candidates to the languages of which any document has a word of that script; a word of a
script that no language has is in `unknown`, and a word without letters is in none and takes its neighbours' language. Each
remaining word has a log-likelihood for each candidate. Viterbi finds the labelling of the text's words with the largest sum
of these, less `switch_penalty` for each change of language. Runs of one label are the result's spans.

Defined cases: null, empty and word-less texts have one span, of `unknown` and no words. Very long texts are labelled whole. Rows
without an id keep a null id. Repeated rows have their spans each. Equal scores go to the language first in alphabetical order, and
to no change. Null labels train the backoff only; without any label all words are `unknown`. An empty table has no spans. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm._kn import COUNTS, NONE, ClassModel, Counter, Shared, WordScores, collect_counts
from facetry.llm._shared import in_arrow, require
from facetry.llm._text import Words, chunked_words, distinct

ORDER, SHARED_ORDER = 5, 3
#: First code points of ranges and their scripts, in order.
RANGES = [(0, "none"), (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"), (0xAA, "latin"), (0xAB, "none"), (0xB5, "latin"), (0xB6, "none"), (0xBA, "latin"), (0xBB, "none"), (0xC0, "latin"), (0xD7, "none"), (0xD8, "latin"), (0xF7, "none"), (0xF8, "latin"), (0x2B0, "none"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xB80, "tamil"), (0xC00, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C60, "latin"), (0x2C80, "other"), (0x2E00, "none"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "none"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "other"), (0xFB50, "arabic"), (0xFE00, "none"), (0xFF21, "latin"), (0xFF3B, "none"), (0xFF41, "latin"), (0xFF5B, "none"), (0xFF66, "kana"), (0xFFA0, "none"), (0x20000, "han"), (0x30000, "other")]
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = np.array([a for a, _ in RANGES])
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in RANGES])
NO_SCRIPT = SCRIPTS.index("none")
UNKNOWN = "und"


def scripts(words: Words, which: np.ndarray) -> np.ndarray:
    """Script number of each chosen word, by its first letter."""
    if not len(which):
        return np.zeros(0, np.int64)
    start, length = words.starts[which], words.ends[which] - words.starts[which]
    found = np.full(len(which), NO_SCRIPT)
    todo, at = np.arange(len(which)), np.zeros(len(which), dtype=np.int64)
    data = np.concatenate([words.data, np.zeros(4, np.uint8)]).astype(np.int64)
    while len(todo):
        p = start[todo] + at[todo]
        a, b, c, d = (data[p + k] for k in range(4))
        code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | (b & 63), np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | (c & 63), (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | (d & 63))))
        found[todo] = _SCRIPT_OF[np.searchsorted(_STARTS, code, side="right") - 1]
        at[todo] += np.where(a < 0x80, 1, np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4)))
        todo = todo[(found[todo] == NO_SCRIPT) & (at[todo] < length[todo])]
    return found


def _count(names: list[str]):
    """Counts of byte grams by language (cls = its number) of the rows that fit, of short ones of all rows (cls = the number of languages), and of scripts (cls = -1 - the language, code = script)."""
    number = {n: k for k, n in enumerate(names)}
    schema = pa.schema([("cls", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        seen = np.zeros((len(names) + 1, len(SCRIPTS)), dtype=np.int64)
        for batch in batches:
            lang = np.array([number.get(x, len(names)) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            fits = batch.column("fits").to_numpy(zero_copy_only=False)
            for first, past, words in chunked_words(batch, "text"):
                of = lang[first:past][words.doc]
                one, back = distinct(words.hash)
                script = scripts(words, one)[back]
                np.add.at(seen, (of, script), 1)
                lettered = script != NO_SCRIPT
                counter.add(len(names), words, np.flatnonzero(lettered), SHARED_ORDER)
                mine = lettered & fits[first:past][words.doc]
                for c in np.unique(of[mine]).tolist():
                    counter.add(c, words, np.flatnonzero((of == c) & mine), ORDER)
        yield from counter.batches()
        c, s = np.nonzero(seen[:-1])
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(-1 - c, pa.int32()), pa.array(s, pa.int64()), pa.array(seen[c, s], pa.int64())], schema=schema)

    return run


class Model:
    def __init__(self, names: list[str], kn: ClassModel | None, allowed: np.ndarray):
        self.names, self.kn, self.allowed = names, kn, allowed


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_rows_per_language: int = 20_000) -> Model:
    require(docs, text_col, lang_col)
    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n_of = {r.lang: r["count"] for r in slim.where("lang is not null").groupBy("lang").count().collect()}
    names = sorted(n_of)
    if not names:
        return Model([], None, np.zeros((len(SCRIPTS), 0), bool))
    share = F.lit(0)
    for name, n in n_of.items():
        share = F.when(F.col("lang") == name, F.lit(round(min(1.0, max_rows_per_language / n) * (1 << 20)))).otherwise(share)
    slim = slim.select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share).alias("fits"))
    by = collect_counts(in_arrow(slim, _count(names), COUNTS).groupBy("cls", "code").agg(F.sum("n").alias("n")))
    allowed = np.zeros((len(names), len(SCRIPTS)), bool)
    for k in range(len(names)):
        allowed[k, by.get(-1 - k, NONE)[0]] = True
    allowed[:, NO_SCRIPT] = False
    classes = [by.get(k, NONE) for k in range(len(names))]
    return Model(names, ClassModel(Shared(*by.get(len(names), NONE), SHARED_ORDER), classes, ORDER), allowed.T)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float, alone: int = 8) -> np.ndarray:
    """Best label of every word. Rows of `scores` are words, text i has the rows bounds[i]:bounds[i+1]. Texts advance together, but for the `alone` longest: few are as long."""
    n, labels = scores.shape
    length = np.diff(bounds)
    by_length = np.argsort(-length, kind="stable")
    out = np.empty(n, dtype=np.int64)
    for i in by_length[:alone].tolist():
        if length[i]:
            out[bounds[i] : bounds[i + 1]] = _path(scores[bounds[i] : bounds[i + 1]].tolist(), penalty)
    by_length = by_length[alone:]
    longest = length[by_length]
    steps = int(longest[0]) if len(longest) else 0
    if not steps:
        return out
    active_at = np.searchsorted(-longest, -np.arange(steps), side="left").tolist()  # texts with more than t words
    first = bounds[:-1][by_length]
    value = scores[first[: active_at[0]]].astype(np.float64)
    back = np.empty((n, labels), dtype=np.int16)
    stay = np.arange(labels)
    for t in range(1, steps):
        active = active_at[t]
        value_t = value[:active]
        best = value_t.argmax(axis=1)
        jump = value_t[np.arange(active), best] - penalty
        move = jump[:, None] > value_t
        rows = first[:active] + t
        back[rows] = np.where(move, best[:, None], stay)
        value[:active] = np.where(move, jump[:, None], value_t) + scores[rows]
    label = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        active = active_at[t]
        rows = first[:active] + t
        out[rows] = label[:active]
        if t:
            label[:active] = back[rows, label[:active]]
    return out


def _path(rows: list[list[float]], penalty: float) -> list[int]:
    """Best labels of one text."""
    value, moves = rows[0], []
    for row in rows[1:]:
        best = max(value)
        jump = best - penalty
        if min(value) < jump:
            moves.append((value.index(best), [v < jump for v in value]))
            value = [(jump if v < jump else v) + s for v, s in zip(value, row, strict=True)]
        else:
            moves.append(None)
            value = [v + s for v, s in zip(value, row, strict=True)]
    label = value.index(max(value))
    out = [label]
    for move in reversed(moves):
        if move and move[1][label]:
            label = move[0]
        out.append(label)
    return out[::-1]


SPANS = "doc_id long, span int, lang string, first_word int, n_words int"


def spans(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", switch_penalty: float = 12.0) -> DataFrame:
    """(doc_id, span, lang, first_word, n_words): the spans of every row, numbered from 0."""
    require(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.kn, model.allowed))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("span", pa.int32()), ("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kn, allowed = shared.value
        labels = np.array([*names, UNKNOWN], dtype=object)
        ways = np.concatenate([allowed, ~allowed.any(axis=1, keepdims=True)], axis=1)  # by script: languages, unknown
        ways[NO_SCRIPT] = True
        known = WordScores(kn, lambda lp: lp, len(names)) if kn else None
        for batch in batches:
            ids = batch.column("doc_id")
            for first, past, words in chunked_words(batch, "text"):
                bounds = words.bounds()
                one, back = distinct(words.hash)
                script = scripts(words, one)
                score = np.zeros((len(one), len(labels)))
                if known:
                    lettered = np.flatnonzero(script != NO_SCRIPT)
                    score[lettered, :-1] = known.score(words, one[lettered])
                score[~ways[script]] = -1e6
                label = viterbi(score[back], bounds, switch_penalty)
                n = len(label)
                change = np.ones(n, dtype=bool)
                change[1:] = label[1:] != label[:-1]
                change[bounds[:-1][bounds[:-1] < n]] = True
                begin = np.flatnonzero(change)
                length = np.diff(np.append(begin, n))
                doc = words.doc[begin]
                bare = np.flatnonzero(np.diff(bounds) == 0)
                doc, at = np.concatenate([doc, bare]), np.concatenate([begin - bounds[doc], np.zeros(len(bare), np.int64)])
                length = np.concatenate([length, np.zeros(len(bare), np.int64)])
                lang = np.concatenate([labels[label[begin]], np.full(len(bare), UNKNOWN, dtype=object)])
                order = np.argsort(doc, kind="stable")
                doc, at, length, lang = doc[order], at[order], length[order], lang[order]
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + doc)).cast(pa.int64()), pa.array(number, pa.int32()), pa.array(lang.tolist(), pa.string()), pa.array(at, pa.int32()), pa.array(length, pa.int32())], schema=schema)

    return in_arrow(slim, run, SPANS)


def identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", switch_penalty: float = 12.0) -> DataFrame:
    """Spans of all documents by the models that their own labels train."""
    model = fit(docs, text_col=text_col, lang_col=lang_col)
    return spans(docs, model, id_col=id_col, text_col=text_col, switch_penalty=switch_penalty)
