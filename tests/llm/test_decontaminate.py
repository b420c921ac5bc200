import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetry.llm import decontaminate as D


def within(pattern, text):
    """Least edit distance of the pattern to any part of the text, by dynamic programming."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != c))
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_myers_equals_dynamic_programming(pattern, text):
    assert D.Pattern(pattern, 0, len(pattern), 0, None).distance(text) == within(pattern, text)


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", min_size=6, max_size=24), st.integers(0, 4), st.text("ab ", max_size=60))
def test_search_is_exact(item, budget, text):
    budget = min(budget, len(item) - 1)
    want = (within(item, f" {text} ") if budget else within(f" {item} ", f" {text} ")) if text else 99
    matcher = D.Matcher([(1, item, budget)])
    assert matcher.matches(text) == ({1: want} if want <= budget else {})
    assert bool(matcher.matches(text, any_will_do=True)) == (want <= budget)
    leaves = D.pieces(item, budget)
    assert len(leaves) == budget + 1 and "".join(item[p.lo : p.hi] for p in leaves) == item


def test_edited_passages(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(12, 40)))) for k in range(20)]
    docs, want = [], set()
    for i in range(120):
        text = " ".join(word() for _ in range(rnd.randrange(50, 300)))
        if i % 3 == 0:
            k = rnd.randrange(20)
            passage = list(items[k][1])
            for _ in range(int(0.08 * len(passage)) if i % 2 else 0):
                passage[rnd.randrange(len(passage))] = rnd.choice("xyz")
            at = rnd.randrange(len(text))
            text = text[:at] + "\n" + "".join(passage).upper() + "! " + text[at:]
            want.add((i, k))
        docs.append((i, text))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.matches(d, b).collect()}
    brute = {}
    for k, t in items:
        t = D.normalise(t)
        for i, x in docs:
            least = D.Pattern(t, 0, len(t), 1, None).distance(D.normalise(x))
            if least <= int(0.1 * len(t)):
                brute[i, k] = least
    assert got == brute and want <= set(got)
    assert {(r.doc_id, r.item_id): r.distance for r in D.matches(d, b, pieces_per_pass=50).collect()} == got
    kept = {r.doc_id for r in D.clean(d, b, pieces_per_pass=50).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_short_items_have_a_budget(spark):
    docs = spark.createDataFrame([(1, "so the qvick brown fox it is"), (2, "so the qvick brovn fox it is"), (3, "tinx"), (4, "tiny")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The quick brown fox"), (2, "tiny")], "item_id long, text string")
    assert sorted(tuple(r) for r in D.matches(docs, bench).collect()) == [(1, 1, 1), (4, 2, 0)]
    assert [r.doc_id for r in D.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "concatenate the article"), (2, "a cat"), (3, "The. Art!"), (4, "banana")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cat"), (2, "the art"), (3, "a")], "item_id long, text string")
    assert sorted(tuple(r) for r in D.matches(docs, bench).collect()) == [(2, 1, 0), (2, 3, 0), (3, 2, 0)]


def test_repeated_text_takes_linear_time():
    item = D.normalise("again " * 200)
    matcher = D.Matcher([(1, item, len(item) // 10), (2, item.replace("again again", "again anew", 3), 100)])
    began = time.time()
    assert matcher.matches(D.normalise("again " * 17_000 + "and once more"))[1] == 0
    assert matcher.matches(D.normalise("agaim again again again ego " * 4_000)) == {}
    assert time.time() - began < 20


def test_edge_cases(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, None), (2, ""), (3, "..."), (4, f"A. {item.upper()}!"), (4, f"A. {item.upper()}!"), (None, item), (5, "lorem " * 100_000 + item.replace("quick", "quikc") + " ipsum" * 50_000), (6, "the quick brown fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("distance", F.lit(None).cast("string"))
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (None, item), (4, ""), (5, "!?")], "item_id long, text string")
    got = sorted(tuple(r) for r in D.matches(docs, bench).collect())
    assert got == [(4, 1, 0), (4, 2, 0), (5, 1, 2), (5, 2, 2)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert D.matches(docs.where("false"), bench).count() == 0 and D.matches(docs, bench.where("false")).count() == 0
    assert D.clean(docs, bench.where("false")).count() == len(rows)
