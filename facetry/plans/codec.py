"""Composed queries, requests and responses as JSON."""

from __future__ import annotations

import json
from typing import Any
from urllib.parse import parse_qs

from pyspark.sql import DataFrame

from facetry.operators.cluster import Strategy
from facetry.operators.core import Core
from facetry.operators.facets import Facet
from facetry.operators.ranking import SortKey
from facetry.plans.composed import ComposedQuery, Response
from facetry.plans.cql import Expression
from facetry.plans.nodes import from_json, to_json


def query_to_json(q: ComposedQuery) -> dict[str, Any]:
    """All of a query but its collectors, which are columns of the caller."""
    nodes = lambda by: {core: [to_json(n) for n in ns] for core, ns in by.items()}
    out: dict[str, Any] = {
        "resultsFrom": q.results_from,
        "cores": sorted(q.used_cores() | {c for a, b, _, _ in q.matches for c in (a, b)}),
        "_start": q.start,
        "_stop": q.stop,
        "_queries": {core: to_json(n) for core, n in q.queries.items()},
        "_filterQueries": nodes(q.filters),
        "_excludeFilterQueries": nodes(q.excludes),
        "_otherCoreFacetFilters": nodes(q.facet_filters),
        "_drilldownQueries": {core: [[dim, list(path)] for dim, path in ds] for core, ds in q.drilldowns.items()},
        "_facets": {core: [{"fieldname": f.dim, "maxTerms": f.top, "path": list(f.path)} for f in fs] for core, fs in q.facets.items()},
        "_matches": {f"{a}->{b}": [{"core": a, "key": ka}, {"core": b, "key": kb}] for a, b, ka, kb in q.matches},
        "_unites": [{"A": [a, to_json(qa)], "B": [b, to_json(qb)]} for a, qa, b, qb in q.unites],
        "_rankQueries": {core: to_json(n) for core, n in q.ranks.items()},
        "_rankQueryScoreRatio": q.rank_ratio,
        "_sortKeys": [{"sortBy": k.field, "sortDescending": k.descending, "type": k.kind, "missingValue": k.missing, "core": k.core} for k in q.sort_keys],
        "_storedFields": q.stored,
        "_dedupField": q.dedup,
        "_dedupSortField": q.dedup_sort,
        "_exportKey": q.export_key,
        "_clustering": bool(q.clustering),
        "_clusteringConfig": {"clusterMoreRecords": q.cluster_more, "strategies": [{"clusteringEps": s.eps, "clusteringMinPoints": s.min_points, "fields": [{"fieldname": f, "weight": w, "filterValue": s.filters.get(f)} for f, w in s.fields.items()] + [{"fieldname": f, "weight": 0.0, "filterValue": v} for f, v in s.filters.items() if f not in s.fields]} for s in q.clustering]},
        "_suggestionRequest": q.suggest or None,
    }
    if q.relational is not None:
        out["_relationalFilterJson"] = json.dumps(to_json(q.relational))
    return out


def query_from_json(data: dict[str, Any]) -> ComposedQuery:
    nodes = lambda key: {core: [from_json(n) for n in ns] for core, ns in (data.get(key) or {}).items()}
    q = ComposedQuery(data["resultsFrom"])
    q.start, q.stop = data.get("_start") or 0, 10 if data.get("_stop") is None else data["_stop"]
    q.queries = {core: from_json(n) for core, n in (data.get("_queries") or {}).items()}
    q.filters, q.excludes, q.facet_filters = nodes("_filterQueries"), nodes("_excludeFilterQueries"), nodes("_otherCoreFacetFilters")
    q.drilldowns = {core: [(dim, tuple(path)) for dim, path in ds] for core, ds in (data.get("_drilldownQueries") or {}).items()}
    q.facets = {core: [Facet(f["fieldname"], f.get("maxTerms", 10), tuple(f.get("path", ()))) for f in fs] for core, fs in (data.get("_facets") or {}).items()}
    for name, specs in (data.get("_matches") or {}).items():
        keys = {s["core"]: s.get("key", s.get("uniqueKey")) for s in specs}
        a, _, b = name.partition("->")
        q.match(a, b, keys[a], keys[b])
    q.unites = [(u["A"][0], from_json(u["A"][1]), u["B"][0], from_json(u["B"][1])) for u in data.get("_unites") or []]
    q.ranks = {core: from_json(n) for core, n in (data.get("_rankQueries") or {}).items()}
    q.rank_ratio = data.get("_rankQueryScoreRatio", q.rank_ratio)
    q.sort_keys = [SortKey(k["sortBy"], k.get("sortDescending", False), k.get("type", "String"), k.get("missingValue"), k.get("core")) for k in data.get("_sortKeys") or []]
    q.stored, q.dedup, q.export_key = list(data.get("_storedFields") or []), data.get("_dedupField"), data.get("_exportKey")
    by = data.get("_dedupSortField") or []
    q.dedup_sort = [by] if isinstance(by, str) else list(by)
    config = data.get("_clusteringConfig") or {}
    if data.get("_clustering"):
        q.cluster_more = config.get("clusterMoreRecords", 100)
        for way in config.get("strategies", []):
            q.clustering.append(Strategy({f["fieldname"]: f["weight"] for f in way["fields"] if f["weight"]}, way.get("clusteringEps", 0.4), way.get("clusteringMinPoints", 1), {f["fieldname"]: f["filterValue"] for f in way["fields"] if f.get("filterValue") is not None}))
    q.suggest = dict(data.get("_suggestionRequest") or {})
    if data.get("_relationalFilterJson"):
        q.relational = from_json(json.loads(data["_relationalFilterJson"]))
    return q


def expression_to_json(e: Expression) -> dict[str, Any]:
    return {"term": e.term, "index": e.index, "relation": e.relation, "boost": e.boost, "operator": e.op, "operands": [expression_to_json(x) for x in e.operands], "must_not": e.must_not}


def expression_from_json(data: dict[str, Any]) -> Expression:
    return Expression(data["term"], data["index"], data["relation"], data["boost"], data["operator"], tuple(expression_from_json(x) for x in data["operands"]), data["must_not"])


def facet_tree(rows: list[Any]) -> list[dict[str, Any]]:
    """Terms with their counts and, below them, their subterms, from the rows of facets of one field and path."""
    below: dict[tuple[str, ...], list[dict[str, Any]]] = {}
    for r in sorted(rows, key=lambda r: (-r["count"], r["label"])):
        below.setdefault(tuple(r["path"]), []).append({"term": r["label"], "count": r["count"]})
    for path, terms in below.items():
        for t in terms:
            if (*path, t["term"]) in below:
                t["subterms"] = below[*path, t["term"]]
    return below.get(min(below, key=len), []) if below else []


def response_to_json(response: Response, query: ComposedQuery, times: dict[str, int] | None = None) -> dict[str, Any]:
    """A page as a server would send it: bounded by the page and the facets asked for. Without a score a hit has none; stored fields are arrays."""
    total = response.total.first().asDict()
    hits = []
    for row in response.hits.collect():
        d = row.asDict()
        hit = {k: v for k, v in d.items() if k != "duplicate_count" and not (k == "score" and v is None) and not (k not in ("id", "score") and v in (None, [None]))}
        if "duplicate_count" in d:
            hit["duplicateCount"] = {query.dedup: d["duplicate_count"]}
        hits.append(hit)
    if response.clusters is not None:
        hits = [{"id": r.id, "score": r.score, "duplicates": {"topDocs": [{"id": m} for m in r.members]}} for r in response.clusters.orderBy("rank").collect()]
    out: dict[str, Any] = {"total": total["total"], "hits": hits}
    if query.dedup:
        out["totalWithDuplicates"] = total["total_with_duplicates"]
    if response.facets is not None:
        rows = response.facets.collect()
        out["drilldownData"] = []
        for core, wanted in query.facets.items():
            for f in wanted:
                mine = [r for r in rows if r["core"] == core and r["dim"] == f.dim and tuple(r["path"][: len(f.path)]) == f.path]
                out["drilldownData"].append({"fieldname": f.dim, "core": core, "path": list(f.path), "terms": facet_tree(mine)})
    if response.suggestions is not None:
        out["suggestions"] = {}
        for r in response.suggestions.orderBy("word", "rank").collect():
            out["suggestions"].setdefault(r.word, []).append(r.suggestion)
    if times:
        out["times"] = times
    return out


class Hit(dict):
    """A hit whose fields are attributes too."""

    def __getattr__(self, name: str) -> Any:
        if name in self:
            return self[name]
        raise AttributeError(name)


def response_from_json(text: str) -> dict[str, Any]:
    data = json.loads(text)
    return data | {"hits": [Hit(h) for h in data.get("hits", [])]}


def arguments(query_string: str) -> dict[str, list[str]]:
    """The parameters of a query string, each with all its values, empty ones too."""
    return parse_qs(query_string.lstrip("?"), keep_blank_values=True)


def described(core: Core) -> DataFrame:
    """(field, kind, analyzer, hierarchical, stored): what an information page shows of a core."""
    names = sorted({*core.df.columns, *core.fields})
    roles = [core.role(n) for n in names]
    return core.df.sparkSession.createDataFrame([(n, r.kind, r.analyzer if r.kind in ("text", "set") else None, r.hierarchical, r.stored) for n, r in zip(names, roles, strict=True)], "field string, kind string, analyzer string, hierarchical boolean, stored boolean")

