import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetry.llm import language as L

SYLLABLES = {"en": ["the", "ing", "wh", "sh", "ou", "ther"], "fr": ["eau", "tion", "que", "é", "oi", "le"], "ru": ["при", "вет", "ство", "на", "ем"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


def direct(scores, penalty):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        k = int(best.argmax())
        move = best[k] - penalty > best
        back.append(np.where(move, k, np.arange(len(best))))
        best = np.where(move, best[k] - penalty, best) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=8), st.integers(1, 4), st.integers(0, 999))
def test_viterbi_equals_one_text_at_a_time(lengths, labels, seed):
    rnd = np.random.default_rng(seed)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = rnd.normal(size=(bounds[-1], labels)) * 3
    got = L.viterbi(scores, bounds, 2.0, alone=seed % 4)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            assert got[a:b].tolist() == direct(scores[a:b], 2.0)


def test_held_out_accuracy_and_mixed_texts(spark):
    rnd = random.Random(8)
    train = [(i, text(rnd, lang, 60), lang) for i, lang in enumerate(["en", "fr", "ru"] * 40)]
    model = L.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    test = [(i, text(rnd, lang, rnd.randrange(5, 50)), lang) for i, lang in enumerate(["en", "fr", "ru"] * 20)]
    out = L.spans(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()
    right = sum(r.n_words for r in out if test[r.doc_id][2] == r.lang)
    assert right >= 0.98 * sum(r.n_words for r in out)
    mixed = [(1, text(rnd, "en", 30) + " 12 34. " + text(rnd, "fr", 25) + " " + text(rnd, "ru", 10))]
    got = L.spans(spark.createDataFrame(mixed, "doc_id long, text string"), model).orderBy("span").collect()
    assert [r.lang for r in got] == ["en", "fr", "ru"]
    assert abs(got[1].first_word - 31) <= 2 and abs(got[2].first_word - 57) <= 1 and sum(r.n_words for r in got) == 67


def test_edge_cases(spark):
    rnd = random.Random(1)
    rows = [(1, text(rnd, "en", 40), "en"), (1, "the thing", "en"), (2, None, "en"), (3, "", None), (4, "123 456", None), (None, text(rnd, "fr", 40), "fr"), (5, "ქართული ენა", None), (6, text(rnd, "fr", 30_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("span", F.lit("clash")).withColumn("n_words", F.lit(0))
    got = {}
    for r in L.identified(docs).collect():
        got.setdefault(r.doc_id, []).append((r.span, r.lang, r.n_words))
    assert got[2] == got[3] == [(0, "und", 0)] and got[5] == [(0, "und", 2)] and got[4][0][2] == 2
    assert len(got[1]) == 2 and {x[1] for x in got[1]} == {"en"} and got[6] == [(0, "fr", 30_000)] and got[None][0][1] == "fr"
    assert L.identified(docs.where("false")).count() == 0
    none = L.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang for r in none} == {"und"}


def direct_scores(rows, words):
    """log P(word | language) of each word, with plain dictionaries; rows: (text, language)."""
    import math
    import re
    from collections import Counter, defaultdict

    def grams(word, order):
        data = b"\1" + word.encode() + b"\2"
        return [data[max(0, e + 1 - order) : e + 1] for e in range(1, len(data))]

    names = sorted({lang for _, lang in rows if lang})
    top, shared = {n: Counter() for n in names}, Counter()
    for x, lang in rows:
        for w in re.findall(r"\w+", x.lower()):
            shared.update(grams(w, L.SHARED_ORDER))
            if lang:
                top[lang].update(grams(w, L.ORDER))

    def level(counts):
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        d = min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.75
        total, kinds = defaultdict(float), defaultdict(int)
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1

        def prob(g, lower):
            if g[:-1] not in total:
                return lower
            return (max(counts.get(g, 0) - d, 0) + d * kinds[g[:-1]] * lower) / total[g[:-1]]

        return prob

    levels, counts = [], dict(shared)
    for k in range(L.SHARED_ORDER, 0, -1):
        levels.append((k, level(counts)))
        below = Counter()
        for g, n in counts.items():
            below[g[-(k - 1) :] if len(g) == k else g] += 1 if len(g) == k else n
        counts = dict(below)
    tops = [level(top[n]) for n in names]
    out = []
    for w in words:
        row = np.zeros(len(names))
        for g in grams(w, L.ORDER):
            p = 1 / 256
            for k, f in reversed(levels):
                p = f(g[-k:], p)
            row += [math.log(t(g, p)) for t in tops]
        out.append(row)
    return np.array(out)


def test_word_scores_equal_a_direct_computation(spark):
    import pyarrow as pa

    from facetry.llm._kn import WordScores
    from facetry.llm._text import find_words, raw_bytes

    rnd = random.Random(5)
    rows = [(text(rnd, lang, 20), lang) for lang in ("en", "fr", "ru") * 5] + [(text(rnd, "fr", 15), None)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    words = ["the", "whing", "eau", "привет", "unseen", "é", "a", "x1y"]
    found = find_words(*raw_bytes(pa.array(words)))
    got = WordScores(model.kn, lambda lp: lp, 3).score(found, np.arange(len(words)))
    assert np.allclose(got, direct_scores(rows, words), atol=1e-9)


def test_a_bounded_sample_keeps_all_scripts_and_the_shared_counts(spark):
    rnd = random.Random(6)
    rows = [(text(rnd, lang, 20), lang) for lang in ("en", "fr") * 60] + [("при вет", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    some, whole = (L.fit(df, max_rows_per_language=k) for k in (10, 1000))
    assert np.array_equal(some.allowed, whole.allowed) and some.allowed[L.SCRIPTS.index("cyrillic")].tolist() == [True, False]
    assert np.array_equal(some.kn.shared.levels[0].n, whole.kn.shared.levels[0].n) and some.kn.tops[0].n.sum() < whole.kn.tops[0].n.sum()


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "aa bb", "xx"), (2, "aa bb", "yy"), (2, "aa bb", "yy")]
    out = L.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == 3 and {r.n_words for r in out} == {2} and len({r.lang for r in out}) == 1
    rows = rows[:2]
    assert {r.lang for r in L.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"xx"}
