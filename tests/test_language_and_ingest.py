"""The query language, and documents in and out."""

import json

import pytest
from pyspark.sql import functions as F

from facetry.operators.core import Field
from facetry.plans import cql
from facetry.plans.cql import Converter, UnsupportedQuery, extract_filters, parse
from facetry.plans.nodes import And, Bool, Distance, Drilldown, Leaf, MatchAll, Not, Or, Phrase, Prefix, Range, Term, Wildcard, negated
from facetry.sources import documents
from facetry.streaming import ingest

PLAIN = Converter([("a", 1.0)], {"u": "string", "n": "int", "d": "double", "p": "geo"}, hierarchical={"h"}, drilldowns={"h", "f"})


def t(field, value, boost=1.0):
    return Term(boost, field, value)


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("*", MatchAll()),
        ("Fox", t("a", "fox")),
        ("b=Fox", t("b", "fox")),
        ("b=/boost=2.5 fox", t("b", "fox", 2.5)),
        ('"quick fox"', Phrase(field="a", terms=("quick", "fox"))),
        ("fo*", Prefix(field="a", value="fo")),
        ("P*", t("a", "p")),
        ("prefix**", t("a", "prefix")),
        ("???*", Wildcard(field="a", value="???*")),
        ("u=Raw.Value", t("u", "Raw.Value")),
        ("b exact Raw", t("b", "Raw")),
        ("n>3", Range(kind="Int", field="n", low=3, with_low=False)),
        ("n=3", Range(kind="Int", field="n", low=3, high=3)),
        ("d<=2.5", Range(kind="Double", field="d", high=2.5)),
        ("b<m", Range(field="b", high="m", with_high=False)),
        ('p="52.0,5.0,10"', Distance(field="p", lat=52.0, lon=5.0, radius=10000.0)),
        ("h=x>y", None),
        ('h="x>y"', Drilldown(dim="h", path=("x", "y"))),
        ('f="x>y"', Drilldown(dim="f", path=("x>y",))),
        ("x AND y", Bool(clauses=(("MUST", t("a", "x")), ("MUST", t("a", "y"))))),
        ("x OR y OR z", Bool(clauses=(("SHOULD", t("a", "x")), ("SHOULD", t("a", "y")), ("SHOULD", t("a", "z"))))),
        ("x NOT y", Bool(clauses=(("MUST", t("a", "x")), ("MUST_NOT", t("a", "y"))))),
        ("x AND :", Bool(clauses=(("MUST", t("a", "x")),))),
        ("x AND (y OR z)", Bool(clauses=(("MUST", t("a", "x")), ("MUST", Bool(clauses=(("SHOULD", t("a", "y")), ("SHOULD", t("a", "z")))))))),
    ],
)
def test_queries_become_nodes(text, node):
    if node is None:
        with pytest.raises(UnsupportedQuery):
            PLAIN.convert(text)
    else:
        assert PLAIN.convert(text) == node


def test_bad_queries():
    for text in ("", "(x", "x )", "a=", "a <> b", "n=abc"):
        with pytest.raises(UnsupportedQuery):
            PLAIN.convert(text)


def test_stems_and_several_fields():
    two = Converter([("a", 1.0), ("b", 2.0)], stemmed={"b"}, unstemmed_words={"honden"})
    assert two.convert("katten") == Bool(clauses=(("SHOULD", t("a", "katten")), ("SHOULD", Bool(boost=2.0, clauses=(("SHOULD", t("b", "katten")), ("SHOULD", t("b", "kat")))))))
    assert two.convert("b=honden") == t("b", "honden")


def test_other_cores():
    c = Converter([("a", 1.0)], cores={"o": "key"})
    leaf = Leaf(core="o", collect_key="key", filter_key="key", query=t("x", "y"))
    assert c.convert("o.x=y") == leaf and c.convert("o.x=y AND o.x=y") == And(first=leaf, second=leaf) and c.convert("o.x=y OR o.x=y") == Or(first=leaf, second=leaf)
    assert c.convert("o.x=y NOT o.x=y") == And(first=leaf, second=Not(query=leaf))
    rest, filters = extract_filters(parse("a=b AND o.x=y"), {"o"})
    assert rest == parse("a=b") and filters == {"o": [parse("x=y")]}
    rest, filters = extract_filters(parse("a=b NOT o.x=y"), {"o"})
    assert rest == parse("a=b") and PLAIN.convert(filters["o"][0]) == negated(t("x", "y"))
    assert extract_filters(parse("o.x=y"), {"o"}) == (None, {"o": [parse("x=y")]})
    with pytest.raises(UnsupportedQuery):
        extract_filters(parse("a=b OR o.x=y"), {"o"})


def test_requests():
    q = cql.composed_from_request("a=b AND o.x=y", "r", {"r": PLAIN, "o": PLAIN}, [("r", "o", "k", "l")], facets={"r": ["h>x>y"]}, drilldowns={"r": ["h>x"]}, rank_queries={"o": ["x=1", "x=2"]}, common_keys="k")
    assert q.queries == {"r": t("a", "b")} and q.filters == {"o": [t("x", "y")]} and q.dedup == "__key__.k" and q.facets["r"][0].path == ("x", "y") and q.drilldowns == {"r": [("h", ("x",))]}
    assert q.ranks["o"] == Bool(clauses=(("SHOULD", t("x", "1")), ("SHOULD", t("x", "2"))))


def test_field_names():
    registry = documents.FieldRegistry(names={"x": Field("int", "x")}, predicates=[(lambda n: n.endswith("!"), Field("set"))], drilldowns={"f": Field("facet", "f")})
    assert [registry.of(n).kind for n in ("a", "x", "a!", "f", "sorted.a", "untokenized.a", "__key__.a", "__numeric__.a", "range.double.a", "range.int.a")] == ["text", "int", "set", "facet", "string", "string", "key", "numeric", "double", "int"]


def test_decoding(spark):
    doc = [{"type": "TextField", "name": "a", "value": "one"}, {"type": "TextField", "name": "a", "value": "two"}, {"type": "KeyField", "name": "__key__.k", "value": 7}, {"type": "FacetField", "name": "f", "path": ["x", "y"]}, {"type": "LatLonField", "name": "g", "value": [52.0, 5.0]}]
    registry = documents.FieldRegistry(names={"g": Field("geo", "g")}, drilldowns={"f": Field("facet", "f", hierarchical=True)})
    raw = spark.createDataFrame([("1", json.dumps(doc)), ("2", "[]")], "id string, json string")
    one, two = documents.decoded(raw, registry, ["a", "__key__.k", "f", "g"]).orderBy("id").collect()
    assert one.a == ["one", "two"] and one["__key__.k"] == 7 and one.f == [["x", "y"]] and (one.g.lat, one.g.lon) == (52.0, 5.0)
    assert two.a == [] and two["__key__.k"] is None and two.g is None
    rows = documents.gathered(spark.createDataFrame([("1", "n", "x" * 300, True), ("1", "m", "y" * 300, False)], "id string, name string, value string, facet boolean")).first()
    assert [(f.name, len(f.value)) for f in rows.fields] == [("m", 300), ("n", 256)]


def test_upserts_and_deletes(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 1), (None, "anonymous", 1)], "id string, v string, seq int")
    new = spark.createDataFrame([("1", "late", 0, False), ("1", "c", 3, False), ("2", None, 2, True), (None, "anonymous", 2, False)], "id string, v string, seq int, deleted boolean")
    assert sorted((r.id or "", r.v) for r in documents.upserted(old, new).collect()) == [("", "anonymous"), ("", "anonymous"), ("1", "c")]


def test_numbers(spark):
    first = documents.numerated(spark.createDataFrame([("b",), ("a",), ("b",)], "term string"))
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 2)]
    more = documents.numerated(spark.createDataFrame([("a",), ("0",)], "term string"), first)
    assert sorted(map(tuple, more.collect())) == [("0", 3), ("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        documents.numerated(spark.createDataFrame([("",)], "term string"))


def test_key_values(spark, tmp_path):
    store = documents.KeyValues(spark, str(tmp_path / "kv"))
    store["a"], store["b"] = "1", "2"
    assert store["a"] == "1" and store.get("z") is None
    store.commit()
    del store["a"]
    assert store.get("a") is None
    store.commit()
    again = documents.KeyValues(spark, str(tmp_path / "kv"))
    assert again["b"] == "2"
    with pytest.raises(KeyError):
        again["a"]


def test_stream(spark, tmp_path):
    schema = "id string, v string, seq int, deleted boolean"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    table = documents.Table(spark, str(tmp_path / "table"))
    run = lambda: ingest.upsert_stream(ingest.changes(spark, str(tmp_path / "in"), schema), table, str(tmp_path / "at")).awaitTermination()
    assert table.read() is None
    write([("1", "a", 1, False), ("2", "b", 1, False)])
    run()
    write([("1", "c", 2, False), ("2", None, 2, True), ("3", "d", 1, False)])
    run()
    assert sorted((r.id, r.v) for r in table.read().collect()) == [("1", "c"), ("3", "d")]


def test_settings():
    s = documents.settings_from_json('{"similarity": {"type": "BM25Similarity", "k1": 2.0}, "drilldownFields": [{"dim": "f", "hierarchical": true}]}')
    assert s["similarity"].k1 == 2.0 and s["similarity"].b == 0.75 and s["fields"]["f"].hierarchical and s["commit_count"] == 100_000
