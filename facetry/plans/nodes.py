"""Query tree: immutable nodes and their JSON form."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

MUST, SHOULD, MUST_NOT = "MUST", "SHOULD", "MUST_NOT"


@dataclass(frozen=True)
class Node:
    boost: float = 1.0

    def boosted(self, by: float) -> Node:
        return replace(self, boost=self.boost * by)


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    field: str = ""
    value: str = ""


@dataclass(frozen=True)
class Drilldown(Node):
    dim: str = ""
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Prefix(Node):
    field: str = ""
    value: str = ""


@dataclass(frozen=True)
class Wildcard(Node):
    field: str = ""
    value: str = ""


@dataclass(frozen=True)
class Phrase(Node):
    field: str = ""
    terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Range(Node):
    """kind: String, Int, Long or Double; None leaves an end open."""

    kind: str = "String"
    field: str = ""
    low: Any = None
    high: Any = None
    with_low: bool = True
    with_high: bool = True


@dataclass(frozen=True)
class Distance(Node):
    """Points at most `radius` metres away."""

    field: str = ""
    lat: float = 0.0
    lon: float = 0.0
    radius: float = 0.0


@dataclass(frozen=True)
class Bool(Node):
    """Clauses are (occur, node)."""

    clauses: tuple[tuple[str, Node], ...] = ()


@dataclass(frozen=True)
class Leaf(Node):
    """Keys of a dataset's rows that match; rows come in by `filter_key` and leave by `collect_key`."""

    core: str = ""
    collect_key: str = ""
    filter_key: str = ""
    query: Node = MatchAll()


@dataclass(frozen=True)
class And(Node):
    first: Node = MatchAll()
    second: Node = MatchAll()


@dataclass(frozen=True)
class Or(Node):
    first: Node = MatchAll()
    second: Node = MatchAll()


@dataclass(frozen=True)
class Not(Node):
    query: Node = MatchAll()


def must(*nodes: Node) -> Bool:
    return Bool(clauses=tuple((MUST, n) for n in nodes))


def should(*nodes: Node) -> Bool:
    return Bool(clauses=tuple((SHOULD, n) for n in nodes))


def negated(node: Node) -> Bool:
    return Bool(clauses=((MUST, MatchAll()), (MUST_NOT, node)))


_WITH_TERM = {Term: "TermQuery", Prefix: "PrefixQuery", Wildcard: "WildcardQuery"}
_BY_TAG = {tag: cls for cls, tag in _WITH_TERM.items()}
_RELATIONAL = {And: "JoinAndQuery", Or: "JoinOrQuery"}


def to_json(node: Node) -> dict[str, Any]:
    """The node as plain JSON values."""
    out: dict[str, Any]
    match node:
        case MatchAll():
            out = {"type": "MatchAllDocsQuery"}
        case Drilldown(dim=dim, path=path):
            out = {"type": "TermQuery", "term": {"type": "DrillDown", "field": dim, "path": list(path)}}
        case Term() | Prefix() | Wildcard():
            out = {"type": _WITH_TERM[type(node)], "term": {"field": node.field, "value": node.value}}
        case Phrase(field=field, terms=terms):
            out = {"type": "PhraseQuery", "terms": [{"field": field, "value": t} for t in terms]}
        case Range():
            out = {"type": "RangeQuery", "rangeType": node.kind, "field": node.field, "lowerTerm": node.low, "upperTerm": node.high, "includeLower": node.with_low, "includeUpper": node.with_high}
        case Distance():
            out = {"type": "DistanceQuery", "field": node.field, "lat": node.lat, "lon": node.lon, "radius": node.radius}
        case Bool(clauses=clauses):
            out = {"type": "BooleanQuery", "clauses": [to_json(n) | {"occur": o} for o, n in clauses]}
        case Leaf():
            out = {"type": "RelationalLuceneQuery", "core": node.core, "collectKeyName": node.collect_key, "filterKeyName": node.filter_key, "query": to_json(node.query)}
        case And() | Or():
            out = {"type": _RELATIONAL[type(node)], "first": to_json(node.first), "second": to_json(node.second)}
        case Not(query=query):
            out = {"type": "RelationalNotQuery", "query": to_json(query)}
        case _:
            raise TypeError(f"not a query node: {node!r}")
    return out | ({"boost": node.boost} if node.boost != 1.0 else {})


def from_json(data: dict[str, Any]) -> Node:
    kind, boost = data.get("type"), float(data.get("boost", 1.0))
    term = data.get("term", {})
    if kind == "MatchAllDocsQuery":
        return MatchAll(boost)
    if kind == "TermQuery" and term.get("type") == "DrillDown":
        return Drilldown(boost, term["field"], tuple(term["path"]))
    if kind in _BY_TAG:
        return _BY_TAG[kind](boost, term["field"], term["value"])
    if kind == "PhraseQuery":
        terms = data["terms"]
        return Phrase(boost, terms[0]["field"] if terms else "", tuple(t["value"] for t in terms))
    if kind == "RangeQuery":
        return Range(boost, data["rangeType"], data["field"], data.get("lowerTerm"), data.get("upperTerm"), data.get("includeLower", True), data.get("includeUpper", True))
    if kind == "DistanceQuery":
        return Distance(boost, data["field"], data["lat"], data["lon"], data["radius"])
    if kind == "BooleanQuery":
        return Bool(boost, tuple((c["occur"], from_json(c)) for c in data["clauses"]))
    if kind == "JoinAndQuery":
        return And(boost, from_json(data["first"]), from_json(data["second"]))
    if kind == "JoinOrQuery":
        return Or(boost, from_json(data["first"]), from_json(data["second"]))
    if kind == "RelationalNotQuery":
        return Not(boost, from_json(data["query"]))
    if kind and kind.startswith("Relational") and "collectKeyName" in data:
        return Leaf(boost, data["core"], data["collectKeyName"], data["filterKeyName"], from_json(data["query"]))
    raise ValueError(f"unknown query type: {kind}")
