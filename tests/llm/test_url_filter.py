import math
import random

import numpy as np
from pyspark.sql import functions as F

from facetry.llm import url_filter
from facetry.llm._text import raw_bytes


def pages(n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 6 == 0
        name = rnd.choice(["casino-win", "free-bets", "cheap-pills"]) + f"-{rnd.randrange(99)}" if bad else "".join(rnd.choice(["ther", "ing", "tion", "wh", "ea"]) for _ in range(3))
        rows.append((i, f"https://{rnd.choice(['www.', 'm.', ''])}{name}.example.{rnd.choice(['com', 'org'])}/en/{i}", int(bad)))
    return rows


def brute_log_prob(texts, base, order, min_context, strength):
    """log P of each byte, by plain dictionaries."""
    from collections import Counter

    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        for e in range(1, len(t)):
            code = (b"\0" * order + t)[e + 1 : e + 1 + order] if e + 1 < order else t[e + 1 - order : e + 1]
            for k in range(1, order + 1):
                grams[k][code[order - k :]] += 1
    context = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            context[k][g[:-1]] += n

    def log_prob(t):
        total = 0.0
        for e in range(1, len(t)):
            p = base[t[e]]
            for k in range(1, order + 1):
                g = (b"\0" * order + t)[e + 1 : e + 1 + order][order - k :]
                if context[k][g[:-1]] >= (min_context if k > 1 else 1):
                    p = (grams[k][g] + strength * p) / (context[k][g[:-1]] + strength)
            total += math.log(p)
        return total

    return log_prob


def test_scores_equal_brute_force(spark):
    rows = pages(120)
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    model = url_filter.fit(df, F.col("bad"), order=4)
    code = lambda u: b"\1" + "".join("0" if c.isdigit() else c for c in u.lower()).encode() + b"\2"
    base = np.ones(256)
    for _, u, _ in rows:
        for byte in code(u)[1:]:
            base[byte] += 1
    base /= base.sum()
    of = [brute_log_prob([code(u) for _, u, b in rows if b == c], base, 4, 3, 4.0) for c in (0, 1)]
    got = {r.page_id: r.score for r in url_filter.scored(df, model).collect()}
    for i, u, _ in rows[:25]:
        t = code(u)
        assert np.isclose(got[i], (of[1](t) - of[0](t)) / (len(t) - 1), atol=1e-9)


def test_held_out_accuracy(spark):
    train, test = spark.createDataFrame(pages(), "page_id long, url string, bad int"), pages(300, seed=9)
    model = url_filter.fit(train, F.col("bad"))
    found = {r.page_id for r in url_filter.scored(spark.createDataFrame(test, "page_id long, url string, bad int"), model).where("rejected").collect()}
    bad = {i for i, _, b in test if b}
    assert len(found & bad) >= 0.95 * len(bad) and len(found - bad) <= 2
    kept = url_filter.keep(train, model)
    assert kept.columns == train.columns and kept.where("bad = 0").count() >= 498 and kept.where("bad = 1").count() <= 5


def test_rare_grams_count_however_many_urls_there_are(spark):
    common = spark.range(200_000).select(F.concat(F.lit("https://"), F.chr(97 + F.col("id") % 20), F.lit("-ordinary-host-of-many-pages" * 2 + ".example.com/")).alias("url"), F.lit(0).alias("bad"))
    rare = [f"https://{c * 2}x{c}q.example.net/" for c in "bcdfgjklmnpqrtvwz"]  # over 1e7 bytes in all, each of these grams once
    df = common.unionByName(spark.createDataFrame([(u, 1) for u in rare], "url string, bad int"))
    model = url_filter.fit(df, F.col("bad"))
    assert model.rejected.levels[-1].n.sum() == sum(len(u) + 1 for u in rare)


def test_one_junk_host(spark):
    good = [(i, f"https://{''.join(random.Random(i).choice(['ther', 'ing', 'tion']) for _ in range(3))}.example.com/en/{i}", 0) for i in range(500)]
    for name in ("casino-win", "xq", "free-pills", "zzz", "tracker", "a", "junk"):
        bad = [(1000 + i, f"https://{name}.example.net/{i}", 1) for i in range(200)]
        df = spark.createDataFrame(good + bad, "page_id long, url string, bad int")
        found = {r.page_id for r in url_filter.scored(df, url_filter.fit(df, F.col("bad"))).where("rejected").collect()}
        assert {i for i, _, _ in bad} <= found and len(found) <= 203


def test_a_bounded_sample_still_uses_all_bytes(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, bad int")
    some, whole = (url_filter.fit(df, F.col("bad"), max_rows=k) for k in (60, 10**6))
    assert np.array_equal(some.accepted.base, whole.accepted.base) and some.accepted.levels[-1].n.sum() < whole.accepted.levels[-1].n.sum()
    found = url_filter.scored(df, some).where("rejected").select("page_id").collect()
    assert len({r.page_id for r in found} & {i for i, _, b in pages() if b}) >= 95


def test_weak_labels(spark):
    urls = ["https://www.free-bets.example.com/x", "http://alphabet.example.com/casino", "", None, "CASINO.example.org", "https://x.org/?u=//bet"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.y for r in df.select(url_filter.weak_labels(F.col("url")).alias("y")).collect()] == [1, 0, None, None, 1, 0]


def test_edge_cases(spark):
    rows = [*((i, u) for i, u, _ in pages(200)), (None, "https://casino-win.example.com/"), (900, None), (901, ""), (902, "https://x.example.com/" + "a" * 300_000), (0, pages(1)[0][1]), (0, pages(1)[0][1]), (903, "https://é.example/ü")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("clash")).withColumn("cls", F.lit(1))
    out = url_filter.filtered(df).collect()
    assert len(out) == len(rows) and sum(r.page_id == 0 for r in out) == 3
    by = {r.page_id: r for r in out}
    assert by[900].score == 0 and not by[900].rejected and not by[901].rejected and by[0].rejected and by[None].rejected
    model = url_filter.fit(df)
    kept = url_filter.keep(df, model)
    assert kept.columns == df.columns and {900, 901} <= {r.page_id for r in kept.collect()}
    for empty in (df.where("false"), df.where("page_id = 900"), df.where("url like '%tion%'")):
        assert url_filter.filtered(empty).where("rejected").count() == 0 and url_filter.filtered(empty).count() == empty.count()


def test_cut_equals_brute_force():
    rnd = np.random.default_rng(0)
    score = np.unique(np.round(rnd.normal(0.2, 1, 300), 2))
    bad = rnd.random(len(score)) < 1 / (1 + np.exp(-4 * score))
    n = rnd.integers(1, 5, len(score))
    at = url_filter.cut(score, bad, n, 0.05)

    def cost(c):
        false = n[~bad & (score >= c)].sum() / n[~bad].sum()
        return false + n[bad & (score < c)].sum() / n[bad].sum() + 2 * (false > 0.05)

    assert at > 0 and cost(at) <= min(cost(c) for c in score[score > 0]) + 1e-9
    assert url_filter.cut(np.array([-1.0]), np.array([True]), np.array([3]), 0.05) == np.inf


def test_encoding():
    import pyarrow as pa

    data, bounds = url_filter.encoded(*raw_bytes(pa.array(["Ab9", "", "é"])))
    assert data.tobytes() == b"\1ab0\2\1\xc3\xa9\2" and bounds.tolist() == [0, 5, 9]


def test_all_labelled_rows_count(spark):
    common = spark.range(700_000).select(F.lit("https://a.example.com/").alias("url"), F.lit(0).alias("bad"), F.col("id"))
    common = common.select(F.concat("url", F.translate(F.col("id").cast("string"), "0123456789", "bcdfghjklm")).alias("url"), "bad")
    df = common.unionByName(spark.createDataFrame([("https://casino-win.example.net/", 1)], "url string, bad int"))
    model = url_filter.fit(df, F.col("bad"))
    assert model.accepted.levels[-1].n.sum() == common.select(F.sum(F.length("url") + 1)).first()[0]
