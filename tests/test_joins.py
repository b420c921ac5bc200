"""Rows, key sets and facets of the three-core fixture."""

import pytest

from facetry.operators.core import Core, Field, Similarity
from facetry.operators.facets import Facet
from facetry.operators.keys import evaluate
from facetry.operators.ranking import SortKey
from facetry.plans.composed import ComposedQuery, execute
from facetry.plans.nodes import And, Leaf, MatchAll, Not, Or, Term


@pytest.fixture(scope="module")
def cores(spark):
    flag = {"0": "false", "1": "true", "-": None}
    a = [(n, i, c, *(flag[x] for x in bits), str(i)) for n, i, c, bits in [("A", 1, None, "000"), ("A-U", 2, None, "001"), ("A-Q", 3, None, "010"), ("A-QU", 4, None, "011"), ("A-M", 5, 5, "100"), ("A-MU", 6, 12, "101"), ("A-MQ", 7, None, "110"), ("A-MQU", 8, None, "111")]]
    b = [(n, k, d, *(flag[x] for x in bits), t, i + 1) for i, (n, k, d, bits, t) in enumerate([("B-N>A-M", 5, 5, "110", "A"), ("B-N>A-MU", 6, None, "100", "B"), ("B-N>A-MQ", 7, None, "110", "C"), ("B-N>A-MQU", 8, None, "100", "D"), ("B-N", 9, None, "110", "E"), ("B", 10, None, "000", "F"), ("B-P>A-M", 5, None, "011", "G"), ("B-P>A-MU", 6, None, "001", "H"), ("B-P>A-MQ", 7, None, "001", "I"), ("B-P>A-MQU", 8, None, "001", "J"), ("B-P", 11, None, "011", "K")])]
    c = [("C-R", 5, 12, "true", None), ("C-S", 8, None, None, "true"), ("C-S2", 7, None, None, "false")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    facets = {f"cat_{x}": Field("facet", x) for x in "MQUNOPRS"}
    return {
        "coreA": Core("coreA", make(a, "id string, A int, C int, M string, Q string, U string, S string"), fields=facets),
        "coreB": Core("coreB", make(b, "id string, B int, D int, N string, O string, P string, T string, intField int"), fields=facets),
        "coreC": Core("coreC", make(c, "id string, C int, C2 int, R string, S string"), fields=facets, similarity=Similarity("tf")),
    }


def t(field, value="true"):
    return Term(field=field, value=value)


def composed(results="coreA", **more):
    q = ComposedQuery(results, stop=100, **more)
    return q.match("coreA", "coreB", "A", "B").match("coreA", "coreC", "A", "C") if results == "coreA" else q.match("coreA", "coreB", "A", "B")


def ids(response):
    return sorted(r.id for r in response.hits.collect())


def names(text):
    return sorted(text.split())


def test_semi_joins(cores):
    four = names("A-M A-MU A-MQ A-MQU")
    assert ids(execute(composed(queries={"coreA": MatchAll(), "coreB": t("N")}), cores)) == four
    response = execute(composed(filters={"coreB": [t("N")]}), cores)
    assert ids(response) == four and response.total.first().total == 4


def test_anti_joins(cores):
    assert ids(execute(composed(excludes={"coreC": [t("S")]}), cores)) == names("A A-U A-Q A-QU A-M A-MU A-MQ")
    assert ids(execute(composed("coreB", excludes={"coreA": [t("U")]}), cores)) == names("B-N>A-M B-N>A-MQ B-N B B-P>A-M B-P>A-MQ B-P")
    assert ids(execute(ComposedQuery("coreA", excludes={"coreA": [t("Q")]}, stop=100).match("coreA", "coreA", "A", "A"), cores)) == names("A A-U A-M A-MU")


def test_several_excludes_on_one_key_intersect(cores):
    both = execute(composed(excludes={"coreB": [t("N"), t("O")]}), cores)
    assert ids(both) == names("A A-U A-Q A-QU A-MU A-MQU")


def test_optional_keys(cores):
    q = ComposedQuery("coreA", queries={"coreB": t("N")}, stop=100)
    assert ids(execute(q.match("coreA", "coreB", "C", "B"), cores)) == ["A-M"]
    q = ComposedQuery("coreA", queries={"coreB": t("N")}, stop=100)
    assert ids(execute(q.match("coreA", "coreB", "A", "D"), cores)) == ["A-M"]


UNITE = [("coreA", t("U"), "coreB", t("N"))]


def test_unites(cores):
    assert ids(execute(composed(queries={"coreA": t("Q")}, unites=UNITE), cores)) == names("A-QU A-MQ A-MQU")
    assert ids(execute(composed(queries={"coreB": t("O")}, unites=UNITE), cores)) == names("A-M A-MQ")


def counts(response):
    out = {}
    for r in response.facets.collect():
        out.setdefault(r.dim, {})[r.label] = r["count"]
    return out


def test_facets(cores):
    r = execute(composed(queries={"coreA": t("Q"), "coreB": t("O")}, facets={"coreA": [Facet("cat_M")]}), cores)
    assert r.total.first().total == 1 and counts(r) == {"cat_M": {"true": 1}}
    r = execute(composed(queries={"coreA": t("Q")}, facets={"coreB": [Facet("cat_N"), Facet("cat_O")]}), cores)
    assert counts(r) == {"cat_N": {"true": 2, "false": 2}, "cat_O": {"false": 3, "true": 1}}
    r = execute(composed(queries={"coreA": t("M")}, drilldowns={"coreB": [("cat_O", ("true",))]}, facets={"coreB": [Facet("cat_N"), Facet("cat_O")]}), cores)
    assert r.total.first().total == 2 and counts(r)["cat_O"] == {"true": 3}
    r = execute(composed(facets={"coreB": [Facet("cat_N")]}), cores)
    assert r.total.first().total == 8 and counts(r) == {"cat_N": {"true": 4, "false": 4}}
    r = execute(composed(queries={"coreB": t("O")}, unites=UNITE, facet_filters={"coreB": [t("N")]}, facets={"coreB": [Facet("cat_N"), Facet("cat_O")]}), cores)
    assert counts(r) == {"cat_N": {"true": 2}, "cat_O": {"true": 2}}
    assert execute(composed(drilldowns={"coreA": [("cat_Q", ("true",)), ("cat_Q", ("false",))]}), cores).total.first().total == 0


def test_three_cores(cores):
    r = execute(composed(queries={"coreB": t("N"), "coreC": t("R")}, facets={"coreA": [Facet("cat_M")], "coreB": [Facet("cat_N")], "coreC": [Facet("cat_R")]}), cores)
    assert ids(r) == ["A-M"] and counts(r) == {"cat_M": {"true": 1}, "cat_N": {"true": 1}, "cat_R": {"true": 1}}
    q = ComposedQuery("coreA", queries={"coreB": t("N")}, filters={"coreC": [MatchAll()]}, stop=100)
    assert ids(execute(q.match("coreA", "coreB", "A", "B").match("coreA", "coreC", "C", "C2"), cores)) == ["A-MU"]


def test_rank_joins(cores):
    order = lambda q: [r.id for r in execute(q, cores).hits.collect()]
    assert order(composed(queries={"coreB": t("N")}, ranks={"coreC": t("S")})) [0] == "A-MQU"
    first = order(composed(queries={"coreB": t("N")}, ranks={"coreC": t("S"), "coreA": t("Q")}))
    assert first[:2] == ["A-MQU", "A-MQ"]


def test_sort_and_pages(cores):
    q = composed(queries={"coreA": t("Q")}, unites=UNITE, sort_keys=[SortKey("S", True)])
    q.stop = 2
    r = execute(q, cores)
    assert [h.id for h in r.hits.collect()] == ["A-MQU", "A-MQ"] and r.total.first().total == 3
    q.start, q.stop = 1, 10
    r = execute(q, cores)
    assert [(h.id, h.score) for h in r.hits.collect()] == [("A-MQ", None), ("A-QU", None)]
    q.start, q.stop = 0, 0
    assert execute(q, cores).hits.count() == 0


def test_export_keys(cores):
    keys = lambda q: sorted(r.key for r in execute(q, cores).keys.collect())
    assert keys(composed(queries={"coreB": t("N")}, export_key="A")) == [5, 6, 7, 8]
    r = execute(ComposedQuery("coreA", queries={"coreA": t("M")}, export_key="A"), cores)
    assert sorted(k.key for k in r.keys.collect()) == [5, 6, 7, 8] and r.total.first().total == 4


def a(field, value="true"):
    return Leaf(core="coreA", collect_key="A", filter_key="A", query=t(field, value) if field != "*" else MatchAll())


def b(field, value="true"):
    return Leaf(core="coreB", collect_key="B", filter_key="B", query=t(field, value))


def c(field):
    return Leaf(core="coreC", collect_key="C", filter_key="C", query=t(field))


def leaf(core, collect, filter_, query):
    return Leaf(core=core, collect_key=collect, filter_key=filter_, query=query)


def and_(x, y):
    return And(first=x, second=y)


def or_(x, y):
    return Or(first=x, second=y)


def not_(x):
    return Not(query=x)


BN, BO, AQ, AM, AU = b("N"), b("O"), a("Q"), a("M"), a("U")
RELATIONAL = [
    (and_(BN, AM), "A-M A-MU A-MQ A-MQU"),
    (and_(and_(BN, AM), c("R")), "A-M"),
    (and_(c("R"), and_(BN, AM)), "A-M"),
    (and_(and_(leaf("coreC", "C2", "C2", t("R")), leaf("coreA", "A", "C", t("M"))), BN), "A-MU"),
    (and_(and_(BN, and_(leaf("coreA", "C", "A", t("M")), leaf("coreC", "C2", "C2", t("R")))), leaf("coreA", "A", "C", MatchAll())), "A-MU"),
    (and_(AM, BO), "A-M A-MQ"),
    (and_(AM, not_(BO)), "A-MU A-MQU A-MQ"),
    (and_(AM, not_(not_(BO))), "A-M A-MQ"),
    (and_(not_(and_(AM, BO)), a("*")), "A A-U A-Q A-QU A-MU A-MQU"),
    (not_(and_(AM, BO)), "A A-U A-Q A-QU A-MU A-MQU"),
    (and_(AQ, not_(and_(BO, AM))), "A-Q A-QU A-MQU"),
    (or_(BO, AQ), "A-Q A-QU A-M A-MQ A-MQU"),
    (or_(not_(BO), AQ), "A-Q A-QU A-MQ A-MQU A-MU"),
    (or_(BO, not_(AQ)), "A A-U A-M A-MU A-MQ"),
    (and_(BN, or_(AQ, b("T", "B"))), "A-MQ A-MQU A-MU"),
    (or_(BO, or_(b("O", "false"), AQ)), "A-Q A-QU A-MQ A-MQU A-M A-MU"),
    (or_(BO, and_(b("O", "false"), AQ)), "A-MQ A-MQU A-M"),
    (or_(AQ, not_(or_(BO, AM))), "A A-U A-Q A-QU A-MQ A-MQU"),
    (or_(not_(or_(BO, AQ)), AM), "A A-U A-M A-MU A-MQ A-MQU"),
    (or_(AQ, not_(and_(BO, AM))), "A A-U A-Q A-QU A-MU A-MQ A-MQU"),
    (or_(not_(and_(BO, AM)), AQ), "A A-U A-Q A-QU A-MU A-MQ A-MQU"),
    (and_(AQ, not_(or_(BO, AM))), "A-Q A-QU"),
    (or_(AU, and_(AQ, or_(BO, AM))), "A-U A-QU A-MU A-MQ A-MQU"),
    (or_(AU, and_(AQ, not_(or_(BO, AM)))), "A-U A-Q A-QU A-MU A-MQU"),
    (and_(or_(a("S", "4"), a("S", "7")), or_(AU, and_(AQ, or_(BO, AM)))), "A-QU A-MQ"),
    (or_(a("S", "1"), or_(AU, and_(AQ, or_(BO, AM)))), "A A-U A-QU A-MU A-MQ A-MQU"),
    (or_(AU, and_(AQ, not_(and_(BO, AM)))), "A-U A-Q A-QU A-MU A-MQU"),
    (and_(AU, or_(AQ, not_(or_(BO, AM)))), "A-U A-QU A-MQU"),
    (not_(or_(not_(or_(BO, AQ)), AM)), "A-Q A-QU"),
]


@pytest.mark.parametrize("case", range(len(RELATIONAL)))
def test_relational_algebra(cores, case):
    tree, want = RELATIONAL[case]
    core = cores["coreA"]
    found = evaluate(tree, cores).keep(core.df, core.col("A"))
    assert sorted(r.id for r in found.select("id").collect()) == names(want)


def test_relational_trees_in_queries(cores):
    q = ComposedQuery("coreA", filters={"coreA": [and_(AQ, b("P"))]}, stop=100).match("coreA", "coreB", "A", "B")
    assert ids(execute(q, cores)) == names("A-MQ A-MQU")
    q = ComposedQuery("coreA", queries={"coreA": t("M")}, relational=not_(and_(AM, BO)), stop=100).match("coreA", "coreB", "A", "B")
    assert ids(execute(q, cores)) == names("A-MU A-MQU")


def test_validation(cores):
    with pytest.raises(ValueError):
        execute(ComposedQuery("coreA", queries={"coreB": t("N")}), cores)
    with pytest.raises(ValueError):
        ComposedQuery("coreA").match("coreB", "coreC", "B", "C")
    with pytest.raises(ValueError):
        execute(ComposedQuery("coreA", relational=MatchAll()), cores)
