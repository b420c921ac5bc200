import random

from pyspark.sql import functions as F

import corpus_pipeline
from facetry.llm import decontaminate, mixing, sharding
from test_mixing_sharding import best_capacity, brute_schedule
from test_ngram_join import brute as near

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(25))) for k in range(5)]
    rows, labels = [], []
    for i in range(500):
        text = [rnd.choice(words) for _ in range(rnd.randrange(30, 150))]
        toxic = i % 7 == 3
        if toxic:
            for _ in range(8):
                text.insert(rnd.randrange(len(text)), rnd.choice(["grobnik", "zulfat"]))
        text = " ".join(text)
        if i % 11 == 5:
            text += " " + items[i % 5][1].replace("w1", "W1,", 1)
        if i % 5 == 4:
            text = rows[-1][1]
            toxic = labels[-1][1]
        rows.append((i, text, "en", rnd.choice(["a", "a", "a", "b"]), len(text)))
        labels.append((i, int(toxic)))
    return rows, labels, items


def write(spark, path, rows, labels, items):
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_equals_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    write(spark, str(tmp_path), rows, labels, items)
    toxic = {i for i, t in labels if t}
    kept = [r for r in rows if r[0] not in toxic]
    gone = {i for g in near([(r[0], r[1]) for r in kept], 3, 0.5) for i in g[1:]}
    kept = [r for r in kept if r[0] not in gone]
    plain = [(k, decontaminate.normalise(t)) for k, t in items]
    patterns = [(decontaminate.Pattern(t, 0, len(t), 1, None), len(t) // 10) for _, t in plain]
    kept = [r for r in kept if all(p.distance(decontaminate.normalise(r[1])) > k for p, k in patterns)]
    tokens = {s: sum(len(r[1].split()) for r in kept if r[3] == s) for s in "ab"}
    plan, _ = brute_schedule([(r[0], r[3], r[1]) for r in kept], {s: t**0.7 for s, t in tokens.items()}, 20_000)
    kept = [r for r in kept if plan[r[0]][1] is not None]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {tuple(r)[:5] for r in out} == set(kept) and len(out) == len(kept)
    sizes = [len(r[1].split()) for r in sorted(kept)]
    shards = max(1, -(-sum(sizes) // 2_000_000))
    load = {}
    for r in out:
        load[r.shard] = load.get(r.shard, 0) + len(r.text.split())
    import numpy as np

    assert max(load.values()) == best_capacity(np.array(sizes), shards)


def test_stages_keep_columns_and_edge_rows(spark, tmp_path):
    rows, labels, items = corpus()
    odd = [(900, None, None, None, None), (901, "", "en", "a", 0), (None, None, "en", None, 1), (902, "solo text of its own", None, "b", None), (902, "solo text of its own", None, "b", None), (903, "long " * 100_000, "en", "a", 5)]
    write(spark, str(tmp_path), rows + odd, labels, items)
    extra = ["score", "slot", "key", "group_id", "item_id", "word", "grams"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("*", *(F.lit(c).alias(c) for c in extra))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        last = k == len(corpus_pipeline.STAGES) - 1
        assert out.columns == docs.columns + ["shard"] * last, name
        path = f"{tmp_path}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "source_mixing" and k < 3:
            assert {900, 901, 902, 903, None} <= set(ids), name
        empty = stage(spark, docs.where("false").drop("shard"), str(tmp_path))
        assert empty.count() == 0
    assert ids.count(902) <= 1


def test_sharding_and_mixing_agree_on_tokens():
    assert sharding.n_tokens is mixing.n_tokens


def test_near_duplicates_at_the_threshold_go(spark):
    rnd = random.Random(5)
    text = lambda k: [f"v{rnd.randrange(10**6)}" for _ in range(k)]
    rows = []
    for k in range(600):
        base = text(62)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:32]))]  # 30 of 60 n-grams in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {2 * k for k in range(600)}
