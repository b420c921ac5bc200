import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from facetry.llm import line_dedup
from facetry.llm._text import raw_bytes


def words_of(line):
    return tuple("".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in line.lower()).split())


def brute(rows, block_words):
    """Deleted line numbers by (id, text): every document against the first holder of each run, with plain tuples."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda d: (d[0], line_dedup_th(d[1])))
    lines = {d: [(k, w) for k, x in enumerate(d[1].split("\n")) if (w := words_of(x))] for d in docs}

    def runs(d):
        out = set()
        for a in range(len(lines[d])):
            for b in range(a + 1, len(lines[d]) + 1):
                if sum(len(w) for _, w in lines[d][a:b]) >= block_words:
                    out.add(tuple(w for _, w in lines[d][a:b]))
                    break
        return out

    first = {}
    gone = {}
    for d in docs:
        for r in runs(d):
            e = first.setdefault(r, d)
            if e is not d:
                for i, _, n in line_dedup.common_blocks([w for _, w in lines[d]], [w for _, w in lines[e]]):
                    if sum(len(w) for _, w in lines[d][i : i + n]) >= block_words:
                        gone.setdefault(d, set()).update(k for k, _ in lines[d][i : i + n])
    return {d: sorted(g) for d, g in gone.items()}


line_dedup_ths = {}


def line_dedup_th(text):
    return line_dedup_ths.get(text, 0)


def corpus(seed=5, n=60):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(500)}"
    line = lambda k: " ".join(word() for _ in range(k))
    passages = [[line(rnd.choice([4, 9, 15])) for _ in range(rnd.choice([2, 4, 6]))] for _ in range(8)] + [[line(40)]]
    rows = []
    for i in range(n):
        parts = [line(rnd.choice([3, 8, 20])) for _ in range(rnd.randrange(6))]
        for p in rnd.sample(passages, rnd.randrange(3)):
            at = rnd.randrange(len(parts) + 1)
            parts[at:at] = [*p, ""] if rnd.random() < 0.5 else [x.upper() + "!" for x in p]
        parts.insert(0, "All rights reserved.")
        rows.append((i, "\n".join(parts)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.deduplicated(df, block_words=12).collect()}
    want = brute(rows, 12)
    assert {d[0]: g for d, g in want.items()} == {i: r.deleted for i, r in got.items()} and len(want) > 10
    for (i, text), gone in want.items():
        assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    whole = line_dedup.clean(df, block_words=12)
    left = {w for r in whole.collect() for x in r.text.split("\n") if (w := words_of(x))}
    assert left == {w for _, t in rows for x in t.split("\n") if (w := words_of(x))}  # one copy of each line stays
    assert whole.count() == len(rows)


def test_a_passage_of_many_copies_goes_from_all_but_the_first(spark):
    passage = " ".join(f"p{k}" for k in range(51))
    rows = [(i, f"own {i} line\n{passage}\nAll rights reserved.") for i in range(400)]
    got = {r.doc_id: r.deleted for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [1, 2] for i in range(1, 400)}


def test_a_first_holder_that_repeats_or_reorders_passages(spark):
    p, q = ("\n".join(" ".join(f"{c}{i}x{k}" for k in range(20)) for i in range(3)) for c in "pq")
    texts = [f"head\n{p}\nmiddle\n{p}\n{q}\nend"] + [f"own {k}\n{x}\nother {k}" for k, x in enumerate([p, p, f"{q}\n{p}", f"{q}\nbetween\n{p}"])]
    got = {r.doc_id: r.deleted for r in line_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 3, 4, 5, 6], 4: [1, 2, 3, 5, 6, 7]}


def test_moved_blocks_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(12))] for _ in "ab")
        parts = {tuple(b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        longest = {i: max([j - i for j in range(i + 1, len(a) + 1) if tuple(a[i:j]) in parts], default=0) for i in range(len(a))}
        want = [(i, n) for i, n in longest.items() if n and (not i or longest[i - 1] <= n)]
        assert line_dedup.moved_blocks(a, b) == want


def test_edge_cases(spark):
    block = "\n".join(" ".join(f"{c}{k}" for k in range(20)) for c in "abc")
    rows = [(2, block), (2, block), (1, block + "\n?!\n"), (None, block), (3, None), (4, ""), (5, "?!\n\n"), (6, "x " * 300_000 + "\n" + block), (7, "All rights reserved."), (8, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("clash")).withColumn("gone", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("__th", F.lit(3)).withColumn("__new", F.lit("x")).withColumn("ID", F.lit(4)).withColumn("hash", F.lit(5)).withColumn("new", F.lit(6))
    out = line_dedup.clean(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = sorted((r.doc_id or -1, r.text) for r in out.where("text is not null").collect())
    assert texts == sorted([(-1, block), (1, block + "\n?!\n"), (2, ""), (2, ""), (4, ""), (5, "?!\n\n"), (6, "x " * 300_000), (7, rows[8][1]), (8, rows[9][1])])
    assert {r.th for r in out.select("th").collect()} == {"clash"}
    assert line_dedup.deduplicated(df.where("false")).count() == 0


def test_patience_blocks():
    a, b = list("xABCyDz"), list("ABCqqDwz")
    assert line_dedup.common_blocks(a, b) == [(1, 0, 3), (5, 5, 1), (6, 7, 1)]
    assert line_dedup.common_blocks([], b) == [] and line_dedup.common_blocks(list("aa"), list("aaa")) == [(0, 0, 2)]
    assert line_dedup.common_blocks(list("abab"), list("baba")) == []  # no value is unique


def test_line_hashes_know_words_and_places():
    data, offsets = raw_bytes(pa.array(["A b\n\nb a", "a, B!", None, "x\nx"]))
    doc, line, h, n = line_dedup.line_hashes(data, offsets)
    assert doc.tolist() == [0, 0, 1, 3, 3] and line.tolist() == [0, 2, 0, 0, 1] and n.tolist() == [2, 2, 2, 1, 1]
    assert h[0] == h[2] and h[3] == h[4] and len(np.unique(h)) == 3
