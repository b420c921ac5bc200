import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from facetry.llm import toxicity

BAD = {"en": ["grobnik", "zulfat"], "fr": ["merdouq", "salopt"]}


def corpus(seed=5, n=600):
    rnd = random.Random(seed)
    words = {lang: [f"{lang}{k}" for k in range(300)] for lang in BAD}
    rows, labels = [], []
    for i in range(n):
        lang = rnd.choice(["en", "en", "en", "fr"])
        text = [rnd.choice(words[lang]) for _ in range(rnd.randrange(20, 200))]
        toxic = rnd.random() < (0.1 if lang == "en" else 0.3)
        if toxic:
            for _ in range(max(2, len(text) // 20)):
                text.insert(rnd.randrange(len(text)), rnd.choice(BAD[lang]).upper())
        rows.append((i, " ".join(text), lang))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shown = spark.createDataFrame(labels[:400], "doc_id long, toxic int")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, shown).collect()}
    toxic = {i for i, t in labels if t}
    later = {i for i in range(400, 600)}
    assert len(found & toxic & later) >= 0.95 * len(toxic & later)
    assert len((found - toxic) & later) <= 0.01 * len(later)
    kept = toxicity.reject(docs, shown)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(600)) - found


def test_edge_cases(spark):
    rows, labels = corpus(n=300)
    bad = " ".join(BAD["en"] * 3)
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "?!", None), (None, bad, "en"), (1003, bad, None), (1003, bad, None), (1004, "en1 " * 200_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(None).cast("int"))
    shown = spark.createDataFrame(labels + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    kept = toxicity.reject(docs, shown)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1000, 1001, 1002, 1004} <= set(ids) and 1003 not in ids and None not in ids
    assert {r.score for r in kept.select("score").distinct().collect()} == {"clash"}
    for d, l in ((docs.where("false"), shown), (docs, shown.where("false")), (docs, shown.where("toxic = 0"))):
        assert toxicity.toxic_documents(d, l).count() == 0
        assert toxicity.reject(d, l).count() == d.count()


def test_threshold_keeps_to_the_false_rate():
    score = np.array([0, 0, 0, 0.3, 0.2, 0.5, 0.9])
    toxic = np.array([0, 0, 0, 0, 1, 1, 1], bool)
    assert 0.3 < toxicity.threshold(score, toxic, 0.0) < 0.5


def direct(rows, everything, texts, chance=4.0):
    """The score of each text, with plain dictionaries: rows are (cls, text) of the sample, everything all texts."""
    words = lambda x: re.findall(r"\w+", (x or "").lower())
    corpus = collections.Counter(w for x in everything for w in words(x))
    tokens, kinds = sum(corpus.values()), len(corpus)
    ahead, pair_docs, word_docs, after = (collections.defaultdict(set) for _ in range(4))
    for k, (c, text) in enumerate(rows):
        tok = ["", "", *words(text)]
        for u, v, w in zip(tok, tok[1:], tok[2:], strict=False):
            ahead[c, v, w].add(u)
            pair_docs[c, v, w].add(k)
            word_docs[c, w].add(k)
            after[c, w].add(v)
    n2 = {k: min(len(x), len(pair_docs[k])) for k, x in ahead.items()}
    n1 = {k: min(len(x), len(word_docs[k])) for k, x in after.items()}
    size = [sum(n for (c, _), n in n1.items() if c == k) for k in (0, 1)]
    context = collections.Counter()
    for (c, v, _), n in n2.items():
        context[c, v] += n
    d1, d2 = ([toxicity._absolute(sum(n == 1 for k, n in t.items() if k[0] == c), sum(n == 2 for k, n in t.items() if k[0] == c)) for c in (0, 1)] for t in (n1, n2))

    def left(n, total, part, least):
        return max(0.0, n - max(least, total * part + chance * math.sqrt(total * part * (1 - part))))

    over1 = {(c, w): left(n, n1.get((0, w), 0) + n1.get((1, w), 0), size[c] / sum(size), d1[c]) for (c, w), n in n1.items()}
    gamma = [1 - sum(e for (c, _), e in over1.items() if c == k) / size[k] for k in (0, 1)]

    def p1(c, w):
        return over1.get((c, w), 0.0) / size[c] + gamma[c] * (corpus[w] + 1) / (tokens + kinds)

    over2 = {}
    for (c, v, w), n in n2.items():
        act = [context[k, v] * p1(k, w) for k in (0, 1)]
        over2[c, v, w] = left(n, n2.get((0, v, w), 0) + n2.get((1, v, w), 0), act[c] / sum(act), d2[c])
    lost = collections.Counter()
    for (c, v, _), e in over2.items():
        lost[c, v] += e

    def p2(c, v, w):
        n = context[c, v]
        return over2.get((c, v, w), 0.0) / n + (1 - lost[c, v] / n) * p1(c, w) if n else p1(c, w)

    out = []
    for text in texts:
        tok = ["", *words(text)]
        each = [math.log(p2(1, v, w) / p2(0, v, w)) - math.log(gamma[1] / gamma[0]) for v, w in zip(tok, tok[1:], strict=False)]
        out.append(sum(each) / max(1, len(each)))
    return out, sum(e > 0 for e in over2.values())


def test_scores_equal_a_direct_computation(spark):
    rows, labels = corpus(seed=9, n=300)
    # an expression of two ordinary words marks the toxic class
    rows = [(i, f"{x} en1 en2 en{i % 7} en1 en2" if t and i % 2 else f"en2 {x} en1", lang) for (i, x, lang), (_, t) in zip(rows, labels, strict=True)]
    rows += [(i + 1000, x, lang) for i, x, lang in rows[:40]]
    labels += [(i + 1000, t) for i, t in labels[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shown = spark.createDataFrame(labels, "doc_id long, toxic int")
    slim = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("stratum"))
    train = [(r.cls, r.text) for r in toxicity._sample(slim, shown, "doc_id", "toxic", 5000, 3).where("fold <> 0").collect()]
    texts = [x for _, x, _ in rows[:60]] + ["", "en1 en2", "grobnik", "never seen"]
    want, n_pairs = direct(train, [x for _, x, _ in rows], texts)
    model = toxicity.fit(docs, shown)
    assert n_pairs == len(model.pairs) > 0 and len(model.words) >= 4
    got = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], want, atol=1e-9)


def test_ties_and_repeated_rows_are_judged_alike(spark):
    rows, labels = corpus(n=300)
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string")
    found = toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert found.groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.count("*").alias("m")).where("n <> 1 or m <> 2").count() == 0
