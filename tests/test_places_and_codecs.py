import json

import pytest
from pyspark.sql import functions as F

from facetry.functions import analysis
from facetry.operators import cluster, facets, keys, ranking, suggest
from facetry.operators.cluster import Strategy
from facetry.operators.core import Core, Field, Similarity
from facetry.operators.facets import Facet
from facetry.operators.ranking import SortKey
from facetry.plans import codec, cql
from facetry.plans.compile import predicate, with_scores
from facetry.plans.composed import ComposedQuery, execute
from facetry.plans.nodes import And, Bool, Leaf, MatchAll, Not, Or, Phrase, Range, Term, from_json, must, negated, to_json
from facetry.sources import documents as D


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def phrase(core, *terms, field="text"):
    return ids(core.df.where(predicate(core, Phrase(field=field, terms=terms))))


def test_phrases_and_gaps(spark):
    df = spark.createDataFrame([(1, ["new york", "city hall"]), (2, ["new", "york city"]), (3, None), (4, [])], "id long, text array<string>")
    assert phrase(Core("c", df, fields={"text": Field("text")}), "york", "city") == [1, 2]
    wide = Core("c", df, fields={"text": Field("text", gap=10)})
    assert phrase(wide, "york", "city") == [2] and phrase(wide, "new", "york") == [1]
    assert with_scores(wide, df, Phrase(field="text", terms=("new", "york"))).where("score > 0").count() == 1


@pytest.mark.parametrize("gap", [0, 10])
def test_phrases_among_stems(spark, gap):
    df = spark.createDataFrame([(1, "honden en katten slapen"), (2, "hond en kat"), (3, None)], "id long, text string")
    core = Core("c", df, fields={"text": Field("text", analyzer="dutch")})
    assert phrase(core, "honden", "en", "katten") == [1] and phrase(core, "hond", "en", "kat") == [1, 2] and phrase(core, "honden", "hond") == []
    many = spark.createDataFrame([(1, ["de honden", "en katten"]), (2, ["honden en"])], "id long, text array<string>")
    core = Core("c", many, fields={"text": Field("text", analyzer="dutch", gap=gap)})
    assert phrase(core, "hond", "en") == ([1, 2] if gap == 0 else [2])
    assert ids(many.where(predicate(core, Term(field="text", value="kat")))) == [1]


def test_raw_texts_that_may_hold_a_word(spark):
    texts = ["Großer Ærø", "GROẞER", "grosser aero", "Ære", "naïve İstanbul", "Åelvin K", "ﬁx", "licenses, LÍCENSE", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    core = Core("c", df, fields={"text": Field("text")})
    words = sorted({w for r in df.select(analysis.standard(F.col("text")).alias("t")).collect() for w in r.t})
    for w in [*words, "gros", "aer", "sss", "icense"]:
        full = ids(df.where(F.array_contains(analysis.standard(F.col("text")), w)))
        assert ids(df.where(predicate(core, Term(field="text", value=w)))) == full, w
        held = ids(df.where(F.coalesce(analysis.fold(F.col("text")).contains(w), F.lit(False))))
        assert set(held) <= set(ids(df.where(core.may_hold("text", [w])))), w


def test_lengths_are_counts_of_terms(spark):
    df = spark.createDataFrame([(1, "a b-2 İx ß"), (2, ""), (3, None)], "id long, text string")
    core = Core("c", df, fields={"text": Field("text")})
    assert df.select(core.length("text") == F.size(core.tokens("text"))).distinct().collect()[0][0]


def test_terms_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a rare word"), (2, "a word"), (3, "other")], "id long, text string")
    core = Core("c", df, fields={"text": Field("text")})
    ready = core.indexed(["text"], str(tmp_path / "terms"))
    node = must(Term(field="text", value="word"), Term(field="text", value="a"))
    both = [sorted((r.id, round(r.score, 9)) for r in with_scores(c, c.df.where(predicate(c, node)), node).collect()) for c in (core, ready)]
    assert both[0] == both[1] and len(both[0]) == 2


@pytest.mark.parametrize(
    "text, rest, filters",
    [
        ("o.x=y AND o.z=w", None, ["x=y", "z=w"]),
        ("o.x=y AND a=b AND o.z=w", "a=b", ["x=y", "z=w"]),
        ("(o.x=y OR o.z=w) AND a=b", "a=b", ["x=y OR z=w"]),
        ("o.x=y OR o.z=w", None, ["x=y OR z=w"]),
        ("a=b AND c=d", "a=b AND c=d", []),
        ("a=b AND (c=d AND o.x=y)", "a=b AND c=d", ["x=y"]),
    ],
)
def test_filters_of_other_cores(text, rest, filters):
    got = cql.extract_filters(cql.parse(text), {"o"})
    assert got == (cql.parse(rest) if rest else None, {"o": [cql.parse(f) for f in filters]} if filters else {})


@pytest.mark.parametrize("text", ["a=b NOT (c=d AND o.x=y)", "a=b OR (c=d AND o.x=y)", "p.x=y OR o.x=y"])
def test_clauses_over_several_cores_are_refused(text):
    with pytest.raises(cql.UnsupportedQuery):
        cql.extract_filters(cql.parse(text), {"o", "p"})


def two_cores(spark):
    a = spark.createDataFrame([(k, k, "xyz"[k % 3], float(k)) for k in range(1, 10)], "id long, k long, f string, price double")
    b = spark.createDataFrame([(k, k % 5 + 1, "pq"[k % 2], k) for k in range(1, 13)], "id long, k long, g string, n int")
    return {"a": Core("a", a), "b": Core("b", b)}


def full_query():
    q = ComposedQuery("a", queries={"a": Range(kind="Double", field="price", low=1)}, filters={"b": [Term(field="g", value="p")]}, excludes={"b": [Term(field="n", value="2")]}, facet_filters={"b": [Term(field="g", value="q")]}, drilldowns={"a": [("f", ("x",))]}, facets={"a": [Facet("f", 3)], "b": [Facet("g", 0, ("p",))]}, unites=[("a", MatchAll(), "b", Term(field="g", value="p"))], ranks={"b": Term(2.0, "g", "p")}, rank_ratio=0.3, sort_keys=[SortKey("price", True, "Double", 0.0), SortKey("n", kind="Int", core="b")], start=1, stop=7, stored=["f"], dedup="k", dedup_sort=["price"], export_key="k", clustering=[Strategy({"f": 1.0}, 0.3, 2, {"f": "x", "g": "y"})], cluster_more=50, suggest={"field": "f", "words": ["xx"]})
    q.relational = And(first=Not(query=Leaf(core="b", collect_key="k", filter_key="k")), second=Or(first=Leaf(core="b", collect_key="k", filter_key="k"), second=Leaf(core="a", collect_key="k", filter_key="k")))
    return q.match("a", "b", "k", "k")


def test_query_codec_is_exact():
    q = full_query()
    data = json.loads(json.dumps(codec.query_to_json(q)))
    assert codec.query_from_json(data) == q
    leaf = json.loads(data["_relationalFilterJson"])["first"]["query"]
    assert leaf["type"] == "RelationalLuceneQuery" and from_json(leaf) == Leaf(core="b", collect_key="k", filter_key="k")
    assert codec.query_from_json({"resultsFrom": "a"}) == ComposedQuery("a")
    spec = [{"core": "b", "uniqueKey": "x"}, {"core": "a", "key": "y"}]
    assert codec.query_from_json({"resultsFrom": "a", "_matches": {"a->b": spec}, "_dedupSortField": "s"}).matches == [("a", "b", "y", "x")]
    e = cql.parse("a=b OR (c exact d NOT e>3)")
    assert codec.expression_from_json(json.loads(json.dumps(codec.expression_to_json(e)))) == e
    for node in (negated(Term(field="a", value="b")), Bool(), MatchAll(2.0)):
        assert from_json(to_json(node)) == node


def test_response_codec(spark):
    cores = two_cores(spark)
    df = cores["a"].df.withColumn("place", F.array(F.array(F.lit("r"), "f"))).withColumn("none", F.lit(None).cast("string"))
    cores["a"] = Core("a", df, fields={"place": Field("facet", "place", hierarchical=True), "f": Field("string", "f")})
    q = ComposedQuery("a", sort_keys=[SortKey("price", kind="Double")], facets={"a": [Facet("place", 0)]}, stored=["f", "none"], stop=2, suggest={"field": "f", "words": ["y"], "mode": "always"})
    data = codec.response_from_json(json.dumps(codec.response_to_json(execute(q, cores), q, {"queryTime": 3})))
    assert data["total"] == 9 and data["hits"] == [{"id": 1, "f": ["y"]}, {"id": 2, "f": ["z"]}] and data["hits"][0].id == 1 and data["times"] == {"queryTime": 3}
    assert data["drilldownData"] == [{"fieldname": "place", "core": "a", "path": [], "terms": [{"term": "r", "count": 9, "subterms": [{"term": t, "count": 3} for t in "xyz"]}]}]
    q = ComposedQuery("b", dedup="k", stop=1)
    data = codec.response_to_json(execute(q, cores), q)
    assert data["total"] == 5 and data["totalWithDuplicates"] == 12 and data["hits"][0]["duplicateCount"] == {"k": 3} and data["hits"][0]["score"] == 1.0
    assert codec.arguments("?a=1&a=2&b=") == {"a": ["1", "2"], "b": [""]}
    assert [tuple(r)[:2] for r in codec.described(cores["b"]).collect()] == [("g", "string"), ("id", "long"), ("k", "long"), ("n", "int")]


def test_facets_of_another_core_keep_to_trees(spark):
    cores = two_cores(spark)
    tree = Leaf(core="b", collect_key="k", filter_key="k", query=Term(field="n", value="1"))
    q = ComposedQuery("a", facet_filters={"b": [tree]}, facets={"b": [Facet("g", 0)]}).match("a", "b", "k", "k")
    want = cores["b"].df.where("k = 2").groupBy("g").count().collect()
    assert sorted((r.label, r["count"]) for r in execute(q, cores).facets.collect()) == sorted((r.g, r["count"]) for r in want)


def test_own_nodes_scores_and_collectors(spark):
    cores = two_cores(spark)

    class Even(keys.KeyNode):
        def keys(self, cores, within):
            even = keys.KeySet(cores["a"].df.where("k % 2 = 0").select(F.col("k").alias("key")))
            return within & even if within else even

    for node, want in ((Even(), [2, 4, 6, 8]), (Not(query=Even()), [1, 3, 5, 7, 9]), (And(first=Leaf(core="a", collect_key="k", filter_key="k", query=Term(field="f", value="x")), second=Even()), [6])):
        q = ComposedQuery("a", relational=node, stop=0).match("a", "b", "k", "k")
        assert ids(execute(q, cores).rows) == want
    q = ComposedQuery("a", queries={"a": Term(field="f", value="x")}, collectors={"most": F.max("price"), "parts": F.count_distinct("k")}, dedup="k")
    assert execute(q, cores).total.first().asDict() == {"total": 3, "total_with_duplicates": 3, "most": 9.0, "parts": 3}
    own = Core("a", cores["a"].df, similarity=Similarity(weight=lambda tf, idf, length, average: tf * 7))
    assert {r.score for r in with_scores(own, own.df, Term(field="f", value="x")).collect()} == {0.0, 7.0}


def test_clusters_in_a_query(spark):
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "x y z"), (4, "x y w")]
    core = Core("c", spark.createDataFrame(rows, "id long, text string"), fields={"text": Field("text")})
    q = ComposedQuery("c", clustering=[Strategy({"text": 1.0}, eps=0.6)], stop=2, cluster_more=2)
    assert sorted(sorted(r.members) for r in execute(q, {"c": core}).clusters.collect()) == [["1", "2"], ["3", "4"]]
    far = cluster.clustered(core, core.df.withColumn("rank", F.col("id").cast("int")).withColumn("score", F.lit(1.0)), [Strategy({"text": 1.0})], epsilon=lambda eps, total, slice_, more: 0.0)
    assert [r.members for r in far.collect()] == [[]] * 4
    near = cluster.clustered(core, core.df.withColumn("rank", F.col("id").cast("int")).withColumn("score", F.lit(1.0)), [Strategy({"text": 1.0}, eps=0.5)], distance=lambda a, b: 0.0, epsilon=lambda eps, *_: eps)
    assert [len(r.members) for r in near.collect()] == [4]


def test_vectors():
    a, b = {"x": 3.0, "y": 4.0}, {"z": 2.0}
    assert cluster.euclidean_distance(a, {"x": 6.0, "y": 8.0}) < 1e-9 and abs(cluster.euclidean_distance(a, b) - 1) < 1e-9
    assert cluster.centroid([a, b]) == {"x": 1.5, "y": 2.0, "z": 1.0}


def brute_dbscan(near, least):
    """Components of core points, and points next to one."""
    n = len(near)
    solid = [len(x) >= least for x in near]
    label = [-1] * n
    for i in range(n):
        if solid[i] and label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if label[j] < 0:
                        label[j] = i
                        if solid[j]:
                            todo.append(j)
    return label


def test_dbscan_and_pagerank_equal_direct_ones():
    import random

    import numpy as np

    rnd = random.Random(3)
    vectors = [cluster.combined([(1.0, {rnd.choice("abcdefg"): rnd.random() + 0.1 for _ in range(3)})]) for _ in range(40)]
    for eps, least in ((0.3, 1), (0.5, 2), (0.6, 4)):
        near = [[j for j in range(40) if j != i and cluster.jaccard_distance(vectors[i], vectors[j]) <= eps] for i in range(40)]
        groups = lambda label: {frozenset(i for i in range(40) if label[i] == c) for c in set(label) - {-1}}
        assert groups(cluster.dbscan(vectors, eps, least)) == groups(brute_dbscan(near, least))
    terms = sorted({t for v in vectors for t in v})
    w = np.array([[v.get(t, 0.0) for t in terms] for v in vectors])
    docs, words = np.full(40, 1 / (40 + len(terms))), np.full(len(terms), 1 / (40 + len(terms)))
    for _ in range(5):
        docs, words = 0.15 + 0.85 * w @ (words / (w > 0).sum(axis=0)), 0.15 + 0.85 * w.T @ (docs / (w > 0).sum(axis=1))
    got, of = cluster.pagerank(vectors)
    assert np.allclose(got, docs) and np.allclose([of[t] for t in terms], words)


def test_quantised_scores(spark):
    values = [3.14159265, -1.0, 0.0, 1e-9, 5000.0, 1.0, 0.3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(ranking.quantised(F.col("x"))).collect()]
    assert got[:6] == [3.140625, 0.0, 0.0, 0.0, 4095.0, 1.0] and 0.2997 < got[6] <= 0.3


def test_equal_versions_have_one_winner(spark):
    old = spark.createDataFrame([(1, "old", 5), (2, "kept", 9)], "id long, v string, seq long")
    new = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 4), (2, "late", 8)], "id long, v string, seq long")
    for k in (1, 3):
        assert sorted(tuple(r) for r in D.upserted(old, new.repartition(k)).collect()) == [(1, "b", 5), (2, "kept", 9)]


def test_commits_by_count_and_time(spark, tmp_path):
    now = [0.0]
    table = D.Table(spark, str(tmp_path / "t"))
    writer = D.Writer(table, 3, 10.0, clock=lambda: now[0])
    rows = lambda *k: spark.createDataFrame([(i, 1) for i in k], "id long, seq long")
    assert not writer.add(rows(1, 2)) and table.read() is None
    assert writer.add(rows(3)) and ids(table.read()) == [1, 2, 3]
    assert not writer.add(rows(4))
    now[0] = 11.0
    assert writer.add(rows(5)) and ids(table.read()) == [1, 2, 3, 4, 5]
    writer.add(rows(6))
    numbers = D.KeyValues(spark, str(tmp_path / "n"))
    numbers["a"] = "1"
    D.commit_all({"t": writer}, numbers)
    assert ids(table.read()) == [1, 2, 3, 4, 5, 6] and D.KeyValues(spark, str(tmp_path / "n"))["a"] == "1"
    writer.commit()


def test_settings(spark, tmp_path):
    settings = D.Settings(spark, str(tmp_path / "s"))
    with pytest.raises(D.NotInitialised):
        settings.get("a")
    settings.update("a", '{"commitCount": 7, "similarity": {"type": "BM25Similarity", "k1": 2.0}, "analyzer": {"type": "StemmingAnalyzer", "stemmingFields": ["t"]}}')
    settings.update("a", '{"commitTimeout": 2, "drilldownFields": [{"dim": "f", "hierarchical": true}], "clustering": {"strategies": [{"clusteringEps": 0.2, "fields": [{"fieldname": "t", "weight": 1.0, "filterValue": "x"}]}]}}')
    got = D.Settings(spark, str(tmp_path / "s")).get("a")
    assert got["commit_count"] == 7 and got["commit_timeout"] == 2 and got["similarity"].k1 == 2.0 and got["stemmed"] == {"t"} and got["fields"]["f"].hierarchical and got["clustering"][0].filters == {"t": "x"}


def test_ingest_hooks(spark):
    rows = spark.createDataFrame([("1", "n", "value", False), ("1", "f", "x" * 300, True)], "id string, name string, value string, facet boolean")
    out = D.gathered(rows, rewrite_id=lambda i: F.concat(i, F.lit("!")), rewrite_fields=lambda fs: F.filter(fs, lambda f: f["facet"])).collect()
    assert out[0].id == "1!" and [(f.name, len(f.value)) for f in out[0].fields] == [("f", 256)]
    assert D.gathered(rows.where("false")).count() == 0
    docs = spark.createDataFrame([("1", [("a", "b")]), ("2", [])], "id string, fields array<struct<name:string,value:string>>")
    assert [tuple(r) for r in D.listed(docs).collect()] == [("1", "a", "b", False)]
    one = spark.range(1).select(F.array(F.array(F.lit("a"), F.lit("b"))).alias("p"))
    of = lambda **k: [tuple(x) for x in one.select(D.facet_terms("d", F.col("p"), **k)).first()[0]]
    assert of() == [("d",), ("d", "a"), ("d", "a", "b")] and of(drilldown="full", require_count=False) == [("d", "a", "b")] and of(drilldown="none") == [("d",)]
    assert of(drilldown="dim_and_full", require_count=False) == [("d",), ("d", "a", "b")] and of(drilldown="all_but_dim", require_count=False) == [("d", "a"), ("d", "a", "b")]
    with pytest.raises(ValueError):
        of(drilldown="some")


def test_bitmaps_are_read_back(spark):
    want = [1, 8, 9, 32768, 32769, 100_000]
    got = keys.bitmap_keys(keys.bitmaps(spark.createDataFrame([(k,) for k in want], "key long")))
    assert ids(got, "key") == want


def test_request_names(spark):
    own = cql.Converter([("f", 1.0)], {"f": "string"})
    asked = cql.request("x", "a", {"a": own, "b": cql.Converter([], {"g": "string"})}, [("a", "b", "k", "k")], sort_keys=[SortKey("b.n", kind="Int")], facets={"a": ["b.kind", "f"]}, drilldowns={"a": ["b.g>p"]}, field_name=lambda n: {"kind": "g"}.get(n, n), stored=["f"], dedup_sort=["price"], clustering=[Strategy({"f": 1.0})], suggest={"field": "f", "words": ["y"]})
    q = asked.query
    assert q.sort_keys == [SortKey("n", kind="Int", core="b")] and q.facets == {"b": [Facet("g", 10)], "a": [Facet("f", 10)]} and q.drilldowns == {"b": [("g", ("p",))]} and q.stored == ["f"] and q.clustering and q.suggest
    rows = spark.createDataFrame([("b", "g", "p", 3), ("a", "f", "x", 1)], "core string, dim string, label string, count int")
    assert [(r.name, r.place) for r in asked.restored(rows).orderBy("place").collect()] == [("b.kind", 0), ("f", 1)] or [(r.name, r.place) for r in asked.restored(rows).orderBy("place").collect()] == [("kind", 0), ("f", 1)]


def test_named_key_sets(spark):
    records = spark.createDataFrame([("1", 1, [("t", "c", "one word")], 1), ("2", 2, [("t", "c", "one other")], 1)], "id string, key long, values array<struct<type:string,creator:string,value:string>>, seq int")
    one = suggest.Suggester(suggest.build(records))
    one.register("first", spark.createDataFrame([(1,)], "key long"))
    assert [r.value for r in one.suggest("one", "first").collect()] == ["one word"] and one.suggest("one", "nobody").count() == one.suggest("one").count() == 2
    assert one.info().first()[:2] == (2, 1)


def test_flat_facets_of_plain_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "x"), (5, "y")], "id long, f string")
    got = facets.facet_counts(Core("c", df), df, Facet("f", 0)).collect()
    assert sorted((r.label, r["count"], r.path, r.level) for r in got) == [("x", 2, [], 1), ("y", 1, [], 1)]


def test_several_facets_in_one_pass_equal_single_ones(spark):
    df = spark.createDataFrame([(k, "xy"[k % 2], ["p", "q"][: k % 3], [["r", str(k % 4)], ["s"]]) for k in range(20)], "id long, f string, g array<string>, h array<array<string>>")
    core = Core("c", df, fields={"h": Field("facet", "h", hierarchical=True)})
    wanted = [Facet("f", 1), Facet("g", 0), Facet("h", 2), Facet("h", 0, ("r",)), Facet("f", 0)]
    rows = lambda d: sorted((r.dim, tuple(r.path), r.label, r.level, r["count"]) for r in d.collect())
    assert rows(facets.facets_counted(core, df, wanted)) == sorted(x for f in wanted for x in rows(facets.facet_counts(core, df, f)))
    q = ComposedQuery("c", queries={"c": Term(field="f", value="x")}, facets={"c": wanted})
    lazy, kept = execute(q, {"c": core}), execute(q, {"c": core}, keep=True)
    assert rows(lazy.facets) == rows(kept.facets) and lazy.total.first() == kept.total.first() and lazy.hits.collect() == kept.hits.collect()


def test_buckets_are_rewritten_only_where_touched(spark, tmp_path):
    table = D.BucketedTable(spark, str(tmp_path / "b"), buckets=4)
    row = "id long, v string, seq long, deleted boolean"
    table.upsert(spark.createDataFrame([(k, "a", 1, False) for k in range(20)] + [(None, "n", 1, False)], row))
    first = table._manifests()[0]
    table.upsert(spark.createDataFrame([(3, "b", 2, False), (None, "m", 2, False)], row))
    second = table._manifests()[0]
    assert sum(first[k] != second[k] for k in first) == 2 and len(first) == 5
    got = sorted((r.id is None, r.id or 0, r.v) for r in table.read().collect())
    assert got == sorted([(False, k, "b" if k == 3 else "a") for k in range(20)] + [(True, 0, "n"), (True, 0, "m")])
    table.upsert(spark.createDataFrame([(k, "x", 3, True) for k in range(20)], row))
    assert table.read().count() == 2 and sorted(table.read().columns) == ["id", "seq", "v"]
    other = D.BucketedTable(spark, str(tmp_path / "e"))
    other.upsert(spark.createDataFrame([], row))
    assert other.read().count() == 0
