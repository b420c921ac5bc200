"""Toxicity: class-conditional Kneser-Ney models.

Two word models, toxic and ordinary, give every word of a text a probability after the word before it. Both interpolate three
orders: pairs of words and single words of the class, and the word counts of all documents, which both classes share.
- Counts are Kneser-Ney's: a pair counts in how many contexts (words ahead of it) the class shows it, a word after how
  many words; neither counts more often than documents hold it, so copies and repeats add nothing.
- The discount of a count is the absolute one (n1 / (n1 + 2 n2)), or what chance explains if that is more: the part of
  both classes' counts that falls to the class by its size, and `chance` standard deviations. For a pair that part follows from the
  single words. The discounted mass goes to the next lower order. So rare expressions have their shared probability in
  both classes, and an expression that marks a class has one of its own.
The score of a text is (log P(text | toxic) - log P(text | ordinary)) / its number of words, less the constant that a word
without counts of its own has, so a text that tells nothing scores 0. It is rejected if the score reaches a threshold,
set on the held-out fifth of the labelled sample so that at most `max_false_rate` of its ordinary documents are rejected.

Of the labelled rows, those of least hash fit the class counts: about `max_toxic_rows` toxic ones and, in each stratum
(`strata_col`, the language), `ordinary_per_toxic` ordinary ones for each toxic one, so that no class is told by its languages.
The shared counts are those of all documents. Where neither class has an excess over chance, the two log-probabilities differ by
a constant of the preceding word; so the words, pairs and preceding words with an excess are all that scoring needs,
and they are few: each has at least chance ** 2 / 4 counts of the bounded sample.

Defined cases: null, empty and word-less texts score 0 and stay. Rows without an id are scored like any other. An id
labelled both ways is toxic; labels that are null or of unknown documents are ignored. Repeated rows are scored each, and
equal scores are judged alike. Very long texts are scored whole. Without both classes, as with empty tables, nothing is rejected.
Other columns, whatever their names, pass through `reject` untouched and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm._shared import in_arrow, require, sized, written
from facetry.llm._text import Words, chunked_words, distinct, mix

FOLDS = 5
_HASH_RANGE = 1 << 20
_V, _W, _U, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _no_words() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Model:
    """Log-ratios, less `neutral`, of words, and those of their pairs; terms of preceding words; the least score that is rejected."""

    words: np.ndarray = field(default_factory=_no_words)
    word_ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    contexts: np.ndarray = field(default_factory=_no_words)
    context_term: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=_no_words)
    pair_ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    neutral: float = 0.0
    threshold: float = np.inf

    def each(self, words: Words) -> np.ndarray:
        """Log-ratio of every word, less the neutral one."""
        h = words.hash.view(np.int64)
        out = _found(self.words, self.word_ratio, h)
        if len(self.contexts):
            before = preceding(words)
            follows = np.flatnonzero(np.isin(before, self.contexts))
            out[follows] += _found(self.contexts, self.context_term, before[follows])
            key = pair_key(before[follows], h[follows])
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[place] == key
            out[follows[hit]] = self.pair_ratio[place[hit]]
        return out

    def score(self, words: Words) -> np.ndarray:
        counts = np.diff(words.bounds())
        return np.bincount(words.doc, weights=self.each(words), minlength=words.n_docs) / np.maximum(counts, 1)


def _found(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted entry of the sorted table, 0 where there is none."""
    if not len(table):
        return np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[place] == wanted, values[place], 0.0)


def preceding(words: Words, by: int = 1) -> np.ndarray:
    """Hash of the word `by` places before each word, 0 ahead of a text."""
    out = np.zeros(len(words.hash), np.int64)
    out[by:] = words.hash.view(np.int64)[:-by] if len(out) > by else out[by:]
    out[by:][words.doc[by:] != words.doc[:-by]] = 0
    return out


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before.view(np.uint64) * _V ^ mix(word.view(np.uint64) * _W)).view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, v, w, u, docs): a row for each word u ahead of a pair v w, one of which has the documents of the pair; with u null and v = w the documents of a word."""
    schema = pa.schema([("cls", pa.int32()), ("v", pa.int64()), ("w", pa.int64()), ("u", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        cls = batch.column("cls").to_numpy()
        for first, past, words in chunked_words(batch, "text"):
            if not len(words.hash):
                continue
            of = cls[first:past][words.doc].astype(np.int64)
            w, v, u = words.hash.view(np.int64), preceding(words), preceding(words, 2)
            doc = words.doc.astype(np.uint64)
            pair = pair_key(v, w).view(np.uint64) ^ (of.astype(np.uint64) * _D)
            one, _ = distinct(mix(pair ^ mix(u.view(np.uint64) * _U)))
            one = one[np.argsort(pair[one], kind="stable")]
            docs = np.zeros(len(one), np.int64)
            docs[np.flatnonzero(np.append(True, pair[one][1:] != pair[one][:-1]))] = _doc_counts(pair, doc)[1]
            alone = w.view(np.uint64) ^ (of.astype(np.uint64) * _D)
            at, n = _doc_counts(alone, doc)
            both = np.concatenate([one, at])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(of[both].astype(np.int32), pa.int32()),
                    pa.array(np.concatenate([v[one], w[at]]), pa.int64()),
                    pa.array(w[both], pa.int64()),
                    pa.array(u[both], pa.int64(), mask=np.arange(len(both)) >= len(one)),
                    pa.array(np.concatenate([docs, n]), pa.int64()),
                ],
                schema=schema,
            )


def _doc_counts(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key and its number of documents, by ascending key."""
    once, _ = distinct(mix(key ^ mix(doc * _U + _V)))
    _, at, n = np.unique(key[once], return_index=True, return_counts=True)
    return once[at], n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in chunked_words(batch, "text"):
            first, back = distinct(words.hash)
            yield pa.RecordBatch.from_arrays([pa.array(words.hash.view(np.int64)[first], pa.int64()), pa.array(np.bincount(back), pa.int64())], names=["word", "n"])


def _absolute(once: int, twice: int) -> float:
    return min(0.95, max(0.5, once / (once + 2 * twice))) if once else 0.75


def _sample(slim: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_toxic_rows: int, ordinary_per_toxic: int) -> DataFrame | None:
    """(cls, text, fold) of the labelled rows that fit the models; None without both classes."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("cls")).dropna().where("cls in (0, 1)").groupBy("id").agg(F.max("cls").alias("cls"))
    n_of: dict[tuple[int, str], int] = {(r.cls, r.stratum): r["count"] for r in slim.select("id", "stratum").join(known, "id").groupBy("cls", "stratum").count().collect()}
    n_toxic = sum(n for (c, _), n in n_of.items() if c)
    if not n_toxic or n_toxic == sum(n_of.values()):
        return None
    share = min(1.0, max_toxic_rows / n_toxic)
    kept = F.lit(0)
    for (c, s), n in n_of.items():
        want = share if c else min(1.0, ordinary_per_toxic * share * n_of.get((1, s), 0) / n)
        kept = F.when((F.col("cls") == c) & (F.col("stratum") == s), F.lit(round(want * _HASH_RANGE))).otherwise(kept)
    rows = slim.join(sized(known, known.count(), 40), "id").where(F.pmod(F.xxhash64("id"), F.lit(_HASH_RANGE)) < kept)
    return written(rows.select("cls", "text", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).alias("fold")))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", strata_col: str | None = "lang", max_toxic_rows: int = 5000, ordinary_per_toxic: int = 3, chance: float = 4.0, max_false_rate: float = 0.002) -> Model:
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    spark = docs.sparkSession
    stratum = F.coalesce(F.col(strata_col).cast("string"), F.lit("")) if strata_col in docs.columns else F.lit("")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), stratum.alias("stratum"))
    rows = _sample(slim, labels, id_col, label_col, max_toxic_rows, ordinary_per_toxic)
    if rows is None:
        return Model()
    # All rows of a pair come to one place with those of its first word: one shuffle serves every count.
    found = in_arrow(rows.where("fold <> 0").select("cls", "text"), _contexts, "cls int, v long, w long, u long, docs long").repartition("v")
    triples = found.groupBy("v", "w", "u", "cls").agg(F.sum("docs").alias("docs"))
    paired = F.col("u").isNotNull()
    columns = []
    for c in (0, 1):
        mine = F.col("cls") == c
        columns += [F.count(F.when(mine & paired, 1)).alias(f"k{c}"), F.sum(F.when(mine & paired, F.col("docs")).otherwise(0)).alias(f"d{c}"), F.sum(F.when(mine & ~paired, F.col("docs")).otherwise(0)).alias(f"x{c}")]
    table = written(triples.groupBy("v", "w").agg(*columns).select("v", "w", "k0", "k1", "x0", "x1", *(F.least(f"k{c}", f"d{c}").alias(f"n{c}") for c in (0, 1))))
    # Single words, with the counts of all documents.
    corpus = written(in_arrow(slim.select("text"), _word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    everything = corpus.agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).first()
    single = table.groupBy("w").agg(*(F.least(F.count(F.when(F.col(f"k{c}") > 0, 1)), F.sum(f"x{c}")).alias(f"n{c}") for c in (0, 1)))
    words = single.join(corpus.withColumnRenamed("word", "w"), "w", "left").select("w", "n0", "n1", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
    word, n0, n1, seen = (words.column(k).to_numpy().astype(np.int64) for k in ("w", "n0", "n1", "n"))
    n = np.stack([n0, n1]).astype(float)
    size = n.sum(axis=1)
    if not size.all():
        return Model()
    part, excess = size / size.sum(), np.zeros_like(n)
    for c in (0, 1):
        d = _absolute(int((n[c] == 1).sum()), int((n[c] == 2).sum()))
        excess[c] = n[c] - np.minimum(n[c], np.maximum(d, _chance(n.sum(axis=0), part[c], chance)))
    gamma = 1 - excess.sum(axis=1) / size
    chosen = np.flatnonzero((excess > 0).any(axis=0))
    chosen = chosen[np.argsort(word[chosen])]
    shared = (seen[chosen] + 1) / (everything.tokens + everything.kinds)
    prob = excess[:, chosen] / size[:, None] + gamma[:, None] * shared
    neutral = float(np.log(gamma[1] / gamma[0]))
    model = Model(word[chosen], np.log(prob[1] / prob[0]) - neutral, neutral=neutral)
    # Pairs: what chance explains follows from the classes' probabilities of the second word, in units of its shared one.
    special = spark.createDataFrame([(int(w), float(a), float(b)) for w, a, b in zip(word[chosen], *(prob / shared), strict=True)], "w long, p0 double, p1 double")
    pairs = table.where("n0 + n1 > 0").select("v", "w", "n0", "n1")
    ones = pairs.agg(*(F.count(F.when(F.col(f"n{c}") == k, 1)).alias(f"o{c}{k}") for c in (0, 1) for k in (1, 2))).first()
    before = pairs.groupBy("v").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    both = pairs.join(sized(special, len(chosen), 40), "w", "left").join(sized(before, before.count(), 100), "v")
    act = [F.col(f"c{c}") * F.coalesce(F.col(f"p{c}"), F.lit(float(gamma[c]))) for c in (0, 1)]
    total, over = F.col("n0") + F.col("n1"), []
    for c in (0, 1):
        q = act[c] / (act[0] + act[1])
        least = _absolute(ones[f"o{c}1"], ones[f"o{c}2"])
        over.append(F.greatest(F.col(f"n{c}") - F.greatest(F.lit(least), total * q + chance * F.sqrt(total * q * (1 - q))), F.lit(0.0)).alias(f"e{c}"))
    rare = both.select("v", "w", "c0", "c1", *over).where("e0 > 0 or e1 > 0").toArrow()
    if rare.num_rows:
        v, w = (rare.column(k).to_numpy() for k in ("v", "w"))
        contexts, at = np.unique(v, return_inverse=True)
        place = np.minimum(np.searchsorted(model.words, w), max(0, len(chosen) - 1))
        known = model.words[place] == w if len(chosen) else np.zeros(len(w), bool)
        base = _counts_of(word, seen, w)
        log = np.zeros((2, len(v)))
        lam = np.zeros((2, len(contexts)))
        for c in (0, 1):
            e, ctx = rare.column(f"e{c}").to_numpy().astype(float), np.maximum(rare.column(f"c{c}").to_numpy().astype(float), 1)
            lam[c] = 1 - np.bincount(at, weights=e / ctx)
            lower = np.where(known, prob[c][place] if len(chosen) else 0.0, gamma[c] * (base + 1) / (everything.tokens + everything.kinds))
            log[c] = np.log(e / ctx + lam[c][at] * lower)
        key = pair_key(v, w)
        order = np.argsort(key)
        model.contexts, model.context_term = contexts, np.log(lam[1] / lam[0])
        model.pairs, model.pair_ratio = key[order], (log[1] - log[0] - neutral)[order]
    held = in_arrow(rows.where("fold = 0").select("cls", "text"), _score(docs, model, ["cls"]), "cls int, score double, n_words long").toPandas()
    model.threshold = threshold(held.score.to_numpy(), held.cls.to_numpy() == 1, max_false_rate)
    return model


def _chance(total: np.ndarray, part: float, deviations: float) -> np.ndarray:
    return total * part + deviations * np.sqrt(total * part * (1 - part))


def _counts_of(word: np.ndarray, seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(word)
    return seen[order][np.searchsorted(word[order], wanted)]


def threshold(score: np.ndarray, toxic: np.ndarray, max_false_rate: float) -> float:
    """The cut of the fewest errors, each class weighing as much, among those that keep to the false rate; of equals the middle one. Always above 0."""
    good, bad = np.sort(score[~toxic]), np.sort(score[toxic])
    values = np.unique(np.append(score[score > 0], 0.0))
    if not len(good) or not len(bad) or len(values) < 2:
        return float(values[-1] / 2) if len(values) > 1 else np.inf
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] * 1.01)
    false = 1 - np.searchsorted(good, cuts) / len(good)
    missed = np.searchsorted(bad, cuts) / len(bad)
    cost = false + missed + np.where(false > max_false_rate, 2.0, 0.0)
    best = cuts[cost <= cost.min() + 1e-12]
    return float(best[len(best) // 2])


def _score(docs: DataFrame, model: Model, names: list[str]):
    """Appends score and n_words to the columns `names`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            scores, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, words in chunked_words(batch, "text"):
                scores.append(here.score(words))
                counts.append(np.diff(words.bounds()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(scores), pa.float64()), pa.array(np.concatenate(counts), pa.int64())], names=[*names, "score", "n_words"])

    return run


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_words, rejected) of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw = in_arrow(slim, _score(docs, model, ["doc_id"]), "doc_id long, score double, n_words long")
    return raw.withColumn("rejected", F.col("score") >= F.lit(model.threshold))


def toxic_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rejected documents with their scores."""
    fitted = {k: v for k, v in params.items() if k in ("id_col", "text_col")}
    return scored(docs, fit(docs, labels, **params), **fitted).where("rejected").drop("rejected")


def reject(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """`docs` without the rejected rows, in one pass that keeps all columns as they are."""
    model = fit(docs, labels, **params)
    place, least = docs.columns.index(params.get("text_col", "text")), model.threshold
    score = _score(docs, model, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(place).cast(pa.string())
            found = next(iter(score(iter([pa.RecordBatch.from_arrays([text], names=["text"])]))))
            yield batch.filter(pa.array(found.column("score").to_numpy() < least))

    return in_arrow(docs, run, docs.schema)
