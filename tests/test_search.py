"""Predicates, scores, facets, groups and order on small fixtures."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from facetry import queries
from facetry.functions import analysis, stemming
from facetry.functions.stemming import dutch_tokens
from facetry.operators import cluster, facets, ranking, suggest, terms
from facetry.operators.core import Core, Field, Similarity
from facetry.operators.facets import Facet
from facetry.operators.ranking import SortKey
from facetry.plans.compile import predicate, with_scores
from facetry.operators.keys import bitmaps
from facetry.plans.composed import ComposedQuery, execute, rows_from
from facetry.session import ship
from facetry.plans.nodes import Bool, Distance, Drilldown, MatchAll, Phrase, Prefix, Range, Term, Wildcard, from_json, negated, should, to_json


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the quick brown fox", 3, [["a", "x", "1"], ["b"]], (52.0, 5.0)), (2, "Quick, quick Fox-trot!", None, [["a", "y"]], (10.0, 5.0)), (3, None, 7, None, None), (4, "", 0, [], None), (5, "brown the fox quick", 3, [["a", "x", "1"], ["a", "x", "2"]], (52.1, 5.1))]
    df = spark.createDataFrame(rows, "id int, body string, n int, path array<array<string>>, at struct<lat:double,lon:double>").coalesce(1)
    return Core("docs", df, "id", {"body": Field("text"), "path": Field("facet", hierarchical=True), "at": Field("geo")})


def found(core, node):
    return sorted(r.id for r in core.df.where(predicate(core, node)).collect())


def test_predicates(docs):
    t = lambda f, v: Term(field=f, value=v)
    assert found(docs, MatchAll()) == [1, 2, 3, 4, 5]
    assert found(docs, t("body", "fox")) == [1, 2, 5] and found(docs, t("nothing", "x")) == []
    assert found(docs, negated(t("body", "fox"))) == [3, 4] and found(docs, negated(Range(kind="Int", field="n", low=1))) == [2, 4]
    assert found(docs, Bool()) == [] and found(docs, Bool(clauses=(("MUST_NOT", t("body", "fox")),))) == []
    assert found(docs, Bool(clauses=(("MUST", t("body", "quick")), ("SHOULD", t("body", "the"))))) == [1, 2, 5]
    assert found(docs, Phrase(field="body", terms=("quick", "brown"))) == [1] and found(docs, Phrase(field="body")) == []
    assert found(docs, Prefix(field="body", value="qui")) == [1, 2, 5] and found(docs, Wildcard(field="body", value="?ro*")) == [1, 2, 5]
    assert found(docs, Range(kind="Int", field="n", low=0, high=3, with_low=False)) == [1, 5] and found(docs, Range(field="body", low="r", high="u")) == [1, 2, 5]
    assert found(docs, Drilldown(dim="path", path=("a", "x"))) == [1, 5] and found(docs, Drilldown(dim="path", path=("b",))) == [1]
    assert found(docs, Distance(field="at", lat=52.0, lon=5.0, radius=20_000)) == [1, 5]


def test_json_round_trip():
    nodes = [MatchAll(), Term(2.0, "f", "v"), Drilldown(dim="d", path=("a", "b")), Prefix(field="f", value="p"), Wildcard(field="f", value="p?*"), Phrase(field="f", terms=("a", "b")), Range(kind="Int", field="n", low=1, with_low=False), Distance(field="g", lat=1.0, lon=2.0, radius=3.0), should(Term(field="f", value="v"), negated(MatchAll()))]
    for n in nodes:
        assert from_json(to_json(n)) == n
    with pytest.raises(ValueError):
        from_json({"type": "?"})


def test_bm25(spark):
    one = Core("c", spark.createDataFrame([(1, "value")], "id int, f string"), "id", {"f": Field("text")})
    row = with_scores(one, one.df, Term(field="f", value="value")).first()
    assert math.isclose(row.score, 0.13076457, abs_tol=1e-6)
    many = Core("c", spark.createDataFrame([(1, " ".join(["x"] * 100))], "id int, f string"), "id", {"f": Field("text")}, similarity=Similarity("tf"))
    assert math.isclose(with_scores(many, many.df, Term(field="f", value="x")).first().score, 0.1)
    assert with_scores(one, one.df, Bool(clauses=(("MUST", MatchAll()), ("MUST_NOT", Term(field="f", value="z"))))).first().score == 1.0


def test_hierarchical_facets(docs):
    rows = facets.facet_counts(docs, docs.df, Facet("path", 0)).collect()
    assert {(*r.path, r.label): r["count"] for r in rows} == {("a",): 3, ("b",): 1, ("a", "x"): 2, ("a", "y"): 1, ("a", "x", "1"): 2, ("a", "x", "2"): 1}
    rows = facets.facet_counts(docs, docs.df, Facet("path", 1)).collect()
    assert {(*r.path, r.label): r["count"] for r in rows} == {("a",): 3, ("a", "x"): 2, ("a", "x", "1"): 2}
    assert [r.label for r in facets.facet_counts(docs, docs.df, Facet("path", 5, ("a", "x"))).orderBy("label").collect()] == ["1", "2"]
    assert facets.specific_value(docs, docs.df, "path", ("a", "y")).first()["count"] == 1 and facets.specific_value(docs, docs.df, "path", ("q",)).first()["count"] == -1


def test_dedup(spark):
    rows = [("urn:1", 42, 2012), ("urn:2", 42, 2013), ("urn:3", 42, None), ("urn:4", None, None)]
    df = spark.createDataFrame([(*r, "cat-A") for r in rows], "id string, k int, date int, A string")
    r = execute(ComposedQuery("c", dedup="k", dedup_sort=["date"], facets={"c": [Facet("A")]}), {"c": Core("c", df)})
    assert {(h.id, h.duplicate_count) for h in r.hits.collect()} == {("urn:2", 3), ("urn:4", 1)}
    assert tuple(r.total.first()) == (2, 4) and r.facets.first()["count"] == 4


def test_sort_join(spark):
    b = Core("B", spark.createDataFrame([("f", 11, 1.0, 7), ("e", 12, 2.0, 8), ("d", 13, 3.0, None)], "s string, i int, d double, keyB int"), "s")
    a = Core("A", spark.createDataFrame([("id3", 7), ("id4", 8), ("id6", None)], "id string, keyA int"))

    def order(field, kind, desc):
        q = ComposedQuery("A", sort_keys=[SortKey(field, desc, kind, core="B")]).match("A", "B", "keyA", "keyB")
        return [h.id for h in execute(q, {"A": a, "B": b}).hits.collect()]

    assert order("s", "String", False) == ["id4", "id3", "id6"] and order("s", "String", True) == ["id6", "id3", "id4"]
    for field, kind in (("i", "Int"), ("d", "Double")):
        assert order(field, kind, False) == ["id6", "id3", "id4"] and order(field, kind, True) == ["id4", "id3", "id6"]


def test_missing_values_sort_last(docs):
    for desc, want in ((False, [4, 1, 5, 3, 2]), (True, [3, 1, 5, 4, 2])):
        assert [r.id for r in ranking.page(docs.df, [ranking.order_column(F.col("n"), SortKey("n", desc, "Int")), F.asc("id")]).collect()] == want


def test_rank_blend(spark):
    rows = spark.createDataFrame([(1, 7, 1.0), (2, None, 1.0)], "id int, k int, score double")
    other = spark.createDataFrame([(7, 1.0)], "key long, other double")
    assert {r.id: round(r.score, 6) for r in ranking.blended(rows, F.col("k"), [other], 0.4).collect()} == {1: 1.4, 2: 1.0}


def test_analysis(spark):
    def tokens(text):
        return spark.range(1).select(analysis.standard(F.lit(text)).alias("t")).first().t

    assert tokens("vol.118 (2008) nr.3 (March) p.435-444") == ["vol.118", "2008", "nr.3", "march", "p.435-444"]
    assert tokens("aap:noot") == ["aap", "noot"] and tokens(":") == [] and tokens("Morée") == ["moree"] and tokens("Morée") == ["more", "e"] and tokens(None) == []
    row = spark.range(1).select(analysis.ngrams(F.lit("lord"), 2).alias("a"), analysis.ngrams(F.lit("lord of"), 3).alias("b"), analysis.shingles(analysis.standard(F.lit("lord of rings")), 2, 2).alias("c"), analysis.positions(F.array(F.lit("a b"), F.lit("c")), gap=10).alias("d")).first()
    assert row.a == ["$l", "lo", "or", "rd", "d$"] and row.b == ["$lo", "lor", "ord", "rd$", "$of", "of$"]
    assert row.c == ["lord", "lord of", "of", "of rings", "rings"] and [(x.term, x.pos) for x in row.d] == [("a", 0), ("b", 1), ("c", 12)]


def test_stems_and_distance():
    assert [stemming.dutch(w) for w in ("katten", "kat", "honden", "hond", "lichamelijke", "lichaamsziek", "opgave")] == ["kat", "kat", "hond", "hond", "licham", "lichaamsziek", "opgav"]
    assert stemming.damerau("valeu", "value") == 1 and stemming.damerau("", "ab") == 2 and stemming.damerau("abc", "abc") == 0


def test_terms(docs):
    assert [(r.term, r["count"]) for r in terms.prefix_search(docs, "body", "f").collect()] == [("fox", 3)]
    assert terms.spelling(docs, "body", ["quikc", "fox"]).select("word", "suggestion").collect() == [("quikc", "quick")]
    assert [r.label for r in terms.drilldown_values(docs, "path", ("a",)).collect()] == ["x", "y"] and "body" in terms.field_names(docs)


def test_similar_documents(spark):
    rows = [(i, "common words here") for i in range(30)] + [(100, "common zebra"), (101, "a zebra"), (102, "zebra common")]
    core = Core("c", spark.createDataFrame(rows, "id int, f string"), "id", {"f": Field("text")})
    assert [r.id for r in terms.similar_documents(core, "f", 100).collect()] == [102, 101]
    assert terms.similar_documents(core, "f", 5).count() == 10 and terms.similar_documents(core, "f", 999).count() == 0


def test_copies_are_equally_similar(spark):
    """Scores don't depend on the order in which terms arrive: copies tie, and go by id."""
    words = [f"w{i}" for i in range(60)]
    other = [(i, " ".join(words[: i % 60])) for i in range(1000, 1120)]
    copies = [(i, " ".join(words[i % 60 :] + words[: i % 60])) for i in range(200)]
    core = Core("c", spark.createDataFrame([*copies, *other], "id int, f string").repartition(7), "id", {"f": Field("text")})
    found = terms.similar_documents(core, "f", 0, 150, common_share=1.0).collect()
    assert [r.id for r in found] == list(range(1, 151)) and len({r.score for r in found}) == 1


def test_suggestions(spark):
    values = [("u:1", 1, "lord of the rings"), ("u:2", 2, "fellowship of the ring"), ("u:3", 3, "lord of the rings")]
    records = spark.createDataFrame([(i, k, [("t", "c", v)], 1) for i, k, v in values] + [("u:1", 1, [("t", "c", "old")], 0)], "id string, key long, values array<struct<type:string,creator:string,value:string>>, seq int")
    built = suggest.build(records)
    assert {r.value: list(r["keys"]) for r in built.collect()} == {"lord of the rings": [1, 3], "fellowship of the ring": [2]}
    assert suggest.suggest(built, "l").count() == 0 and [r.value for r in suggest.suggest(built, "fel").collect()] == ["fellowship of the ring"]
    keys = spark.createDataFrame([(3,)], "key long")
    assert [r.value for r in suggest.suggest(built, "ring", key_set=keys).collect()] == ["lord of the rings"]
    assert suggest.suggest(built, "ring", filters={"type": "no"}).count() == 0
    assert suggest.rerank(suggest.suggest(built, "rings"), "rings").first().value == "lord of the rings"


def test_clusters(spark):
    assert cluster.jaccard_distance({"a": 1.0, "b": 1.0}, {"a": 1.0}) == 0.5 and cluster.interpolated_epsilon(0.4, 60, 10, 100) == 0.2
    assert cluster.dbscan([{"a": 1.0}, {"a": 1.0}, {"b": 1.0}], 0.4, 1) == [0, 0, -1]
    docs, ranks = cluster.pagerank([{"a": 1.0}, {"a": 1.0}], 1)
    assert docs == pytest.approx([0.15 + 0.85 / 3 / 2] * 2) and ranks["a"] == pytest.approx(0.15 + 0.85 * 2 / 3)
    rows = [(1, "apple pear plum", 1, 1.0), (2, "red green blue", 2, 0.9), (3, "apple pear plum", 3, 0.8), (4, None, 4, 0.7)]
    core = Core("c", spark.createDataFrame(rows, "id int, f string, rank int, score double"), "id", {"f": Field("text")})
    out = cluster.clustered(core, core.df, [cluster.Strategy({"f": 1.0})], more=2).collect()
    assert [(r.rank, r.id, r.score, sorted(r.members)) for r in out] == [(1, "1", 1.0, ["1", "3"]), (2, "2", 0.9, []), (3, "4", 0.7, [])]
    ways = [cluster.Strategy({"f": 1.0}, eps=0.0, min_points=9), cluster.Strategy({"f": 1.0}, filters={"f": "pear"})]
    assert [(r.id, sorted(r.members)) for r in cluster.clustered(core, core.df, ways, more=2).collect()] == [("1", ["1", "3"]), ("2", []), ("4", [])]


def test_dutch_fields_find_stems(spark):
    ship(spark)
    core = Core("c", spark.createDataFrame([(1, "Hond en kat"), (2, "honden en katten"), (3, None)], "id int, f string"), "id", {"f": Field("text", analyzer="dutch")})
    assert found(core, should(Term(field="f", value="katten"), Term(field="f", value="kat"))) == [1, 2] and found(core, Term(field="f", value="katten")) == [2]


def test_stems_of_long_texts_stay_small(spark):
    """Python workers get words in small batches, and make no object of each token."""
    psutil = pytest.importorskip("psutil")
    ship(spark)
    words = F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.lit("woorden"), (F.col("id") + i) % 997))
    rows = spark.range(0, 8000, 1, 1).select(dutch_tokens(words).alias("t")).select(F.size("t").alias("n"))
    most, done = [0], threading.Event()

    def sample():
        while not done.wait(0.02):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        most[0] = max(most[0], p.memory_info().rss >> 20)
                except psutil.Error:
                    pass

    watch = threading.Thread(target=sample)
    watch.start()
    try:
        assert rows.agg(F.sum("n")).first()[0] == 8000 * 600
    finally:
        done.set()
        watch.join()
    assert 0 < most[0] < 500


def test_documents_count_once_for_each_stem(spark, tmp_path):
    rows = [(1, "Honden, honden en hond"), (2, "hond"), (3, "HONDEN"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.term: r["count"] for r in queries.dutch_stems(spark, str(tmp_path)).collect()} == {"hond": 3, "honden": 2, "en": 1}


def test_places_of_stems(spark):
    gone = stemming.VALUE_BREAK
    rows = [(1, ["honden", gone, "kat"]), (2, None), (3, []), (4, [gone]), (5, ["kat", "katten"])]
    df = spark.createDataFrame(rows, "id int, words array<string>").coalesce(1)
    placed = {r.id: [tuple(x) for x in r.t] for r in df.select("id", dutch_tokens(F.col("words"), 7).alias("t")).collect()}
    assert placed == {1: [("honden", 0), ("hond", 0), ("kat", 8)], 2: [], 3: [], 4: [], 5: [("kat", 0), ("katten", 1), ("kat", 1)]}


def test_key_bitmaps(spark):
    keys = spark.createDataFrame([(1,), (2,), (32768,), (32769,)], "key long")
    assert sorted(map(tuple, bitmaps(keys).select("bucket", F.bitmap_count("bits")).collect())) == [(1, 3), (2, 1)]


def test_responses_as_json(spark):
    q = ComposedQuery("c", queries={"c": Term(field="f", value="a")}, stored=["f"])
    rows = rows_from(execute(q, {"c": Core("c", spark.createDataFrame([(1, "a"), (2, "b")], "id int, f string"))})).collect()
    assert len(rows) == 1 and rows[0].rank == 1 and '"id":1' in rows[0].hit and '"f":["a"]' in rows[0].hit
