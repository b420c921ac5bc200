import random

from facetry.llm import ngram_join
from facetry.llm._text import raw_bytes


def brute(rows, n, threshold):
    """Connected components of 'Jaccard of word n-grams at least threshold'."""
    sets = {}
    for i, text in rows:
        if i is None:
            continue
        words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "").lower()).split()
        g = frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])
        sets[i] = g
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {tuple(g) for g in groups.values() if len(g) > 1}


def corpus(seed=7, groups=12, copies=6):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 5 == 0 else f"w{k}" for k in range(400)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 40, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, len(words) // 8, len(words) // 3])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    passage = " ".join(rnd.choice(vocabulary) for _ in range(30))
    for _ in range(40):
        rows.append((len(rows), passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(150))))
    return rows


def found(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.group_id, []).append((r.doc_id, r.n_linked))
    assert all(n == len(g) - 1 for g in groups.values() for _, n in g)
    return {tuple(sorted(i for i, _ in g)) for g in groups.values()}


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # With as many sketch hashes as n-grams no block is missed, so the result is exact.
    got = found(ngram_join.near_duplicates(docs, sketch=400))
    assert got == brute(rows, 3, 0.5)
    assert found(ngram_join.near_duplicates(docs, sketch=400, chunk_rows=7)) == got
    assert found(ngram_join.near_duplicates(docs, sketch=400, threshold=0.8)) == brute(rows, 3, 0.8)


def test_join_block_equals_all_pairs():
    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(30):
        base = [rnd.choice(5000, rnd.integers(5, 60), replace=False) for _ in range(6)]
        sets = []
        for _ in range(rnd.integers(2, 150)):
            s = base[rnd.integers(6)]
            keep = s[rnd.random(len(s)) < rnd.choice([0.5, 0.8, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rnd.integers(0, 10**6, rnd.integers(0, 10))])).astype(np.uint32))
        for bits in (64, 4096):
            got = ngram_join.join_block(sets, 0.5, bits)
            want = list(range(len(sets)))
            for i in range(len(sets)):
                for j in range(i):
                    if ngram_join.similarity(sets[i], sets[j]) >= 0.5 and want[i] != want[j]:
                        a, b = min(want[i], want[j]), max(want[i], want[j])
                        want = [a if w == b else w for w in want]
            assert got.tolist() == want


def test_recall_with_production_sketch(spark):
    rows = corpus(seed=3, groups=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b}
    want, got = pairs(brute(rows, 3, 0.5)), pairs(found(ngram_join.near_duplicates(docs)))
    assert got <= want and len(got) >= 0.9 * len(want)


def test_copies_that_also_hold_rarer_passages(spark):
    rnd = random.Random(12)
    text = lambda k: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(k))
    rows, want = [], []
    for _ in range(20):
        base = text(400)
        group = [f"{base} {text(4)}" for _ in range(12)]
        passages = [text(55) for _ in range(6)]
        others = [f"{p} {text(120)}" for p in passages for _ in range(6)]
        want.append(tuple(range(len(rows), len(rows) + 13)))
        rows += [(len(rows) + k, t) for k, t in enumerate([*group, " ".join([base, *passages]), *others])]
    assert found(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == set(want)


def test_edge_cases(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(1, None, 1), (2, "", 1), (3, " .,! ", 1), (4, "one two", None), (5, "One, TWO!", 1), (6, "one two", 1), (6, "one two", 1), (None, "one two", 1), (8, long, 1), (9, long + " end", 1), (10, "one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id int").withColumn("size", docs_col()).withColumn("gone", docs_col()).withColumn("Gone_", docs_col()).withColumn("again", docs_col())
    assert found(ngram_join.near_duplicates(docs)) == {(4, 5, 6), (8, 9)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 8), (False, 10), (True, 0)]
    empty = docs.where("false")
    assert found(ngram_join.near_duplicates(empty)) == set() and ngram_join.keep_one(empty).count() == 0


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_repeated_row_without_copies_stays_once(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "e f g")], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [1, 2]


def test_chain_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert set(roots[k] for k in range(1, 41)) == {1} and roots[101] == 100


def test_null_bytes():
    import pyarrow as pa

    data, offsets = raw_bytes(pa.array(["Ab", None, "É"]))
    assert bytes(data).decode() == "abé" and offsets.tolist() == [0, 2, 2, 4]


def test_needed_overlap_of_samples():
    assert abs(ngram_join.loosened(0.5, 16) - 4 / 28) < 1e-12
    assert ngram_join.loosened(1.0, 16) == 1.0 and 0 < ngram_join.loosened(0.1, 16) <= 0.1


def test_large_blocks_are_cut_without_losing_links(spark):
    rnd = random.Random(8)
    text = lambda k: " ".join(f"v{rnd.randrange(10**5)}" for _ in range(k))
    base, passage = text(60), text(20)
    rows = [(k, f"{base} {text(3)}") for k in range(120)] + [(200 + k, f"{passage} {text(60)}") for k in range(80)]
    rows += [(400 + k, rows[120 + 5 * k][1] + " more") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 0.5)
    assert len(want) == 9 and found(ngram_join.near_duplicates(docs, chunk_rows=12)) == want


def test_no_pair_at_the_threshold_is_left_out(spark):
    rnd = random.Random(5)
    text = lambda k: [f"v{rnd.randrange(10**6)}" for _ in range(k)]
    rows = []
    for k in range(600):
        base = text(62)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:32]))]  # 30 of 60 n-grams in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.near_duplicates(docs)) == {(2 * k, 2 * k + 1) for k in range(600)}


def test_sample_size_does_not_change_the_groups(spark):
    rows = corpus(seed=3, groups=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 0.5)
    assert all(found(ngram_join.near_duplicates(docs, sketch=k)) == want for k in (1, 16))
    assert found(ngram_join.near_duplicates(docs, sketch=1, chunk_rows=7)) == want


def test_overlap_of_exactly_the_threshold_in_a_block():
    import numpy as np

    a, b = np.arange(100, dtype=np.uint64), np.arange(55, dtype=np.uint64)  # 0.55 * 100 is a little more than 55
    assert ngram_join.join_block([a, b, a + np.uint64(1000)], 0.55).tolist() == [0, 0, 2]
