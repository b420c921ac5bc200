"""Queries over several cores that share keys. The rows come from one core; others restrict, rank, sort or count by key.

Order of a plan over several cores: the relational tree, or else unites and filter queries; then the queries of other cores; excludes;
the main query; then rank, group, sort and page; facets are over all matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators import facets as facet_op
from facetry.operators.cluster import Strategy, clustered
from facetry.operators.core import Core
from facetry.operators.facets import Facet
from facetry.operators.keys import KeyNode, KeySet, collect_keys, distinct_keys, evaluate, valid_key
from facetry.operators.ranking import SortKey, blended, deduplicated, joined_order_column, last_by_key, order_column, page, quantised
from facetry.operators.terms import spelling
from facetry.plans.compile import predicate, with_scores
from facetry.plans.nodes import And, Drilldown, Leaf, MatchAll, Node, Not, Or, must
from facetry.session import shared_folder

_RELATIONAL = (And, Or, Not, Leaf, KeyNode)


@dataclass
class Response:
    """`rows` are all matches with all columns, `hits` the page of them in order, `total` one row (total, total_with_duplicates and the query's collectors), `facets` counts, `keys` those asked for,
    `clusters` of the best hits and `suggestions` of other spellings. All are lazy."""

    rows: DataFrame
    hits: DataFrame
    total: DataFrame
    facets: DataFrame | None = None
    keys: DataFrame | None = None
    clusters: DataFrame | None = None
    suggestions: DataFrame | None = None


@dataclass
class ComposedQuery:
    results_from: str
    queries: dict[str, Node] = field(default_factory=dict)
    filters: dict[str, list[Node]] = field(default_factory=dict)
    excludes: dict[str, list[Node]] = field(default_factory=dict)
    facet_filters: dict[str, list[Node]] = field(default_factory=dict)
    drilldowns: dict[str, list[tuple[str, tuple[str, ...]]]] = field(default_factory=dict)
    facets: dict[str, list[Facet]] = field(default_factory=dict)
    matches: list[tuple[str, str, str, str]] = field(default_factory=list)
    unites: list[tuple[str, Node, str, Node]] = field(default_factory=list)
    relational: Node | None = None
    ranks: dict[str, Node] = field(default_factory=dict)
    rank_ratio: float = 0.5
    sort_keys: list[SortKey] = field(default_factory=list)
    start: int = 0
    stop: int = 10
    stored: list[str] = field(default_factory=list)
    dedup: str | None = None
    dedup_sort: list[str] = field(default_factory=list)
    export_key: str | None = None
    #: Aggregates of the caller's own, by name; they are computed with the total in one pass over the matches.
    collectors: dict[str, Column] = field(default_factory=dict)
    #: Scores of other cores have 11 significant bits, as in a compact store.
    quantised: bool = False
    clustering: list[Strategy] = field(default_factory=list)
    cluster_more: int = 100
    #: Arguments of `spelling`: field, words and what else it takes.
    suggest: dict[str, Any] = field(default_factory=dict)

    def match(self, core: str, other: str, key: str, other_key: str) -> ComposedQuery:
        """Declares the keys that join two cores; one of them is the core of the results."""
        if self.results_from not in (core, other):
            raise ValueError(f"a match must include {self.results_from}")
        self.matches.append((core, other, key, other_key))
        return self

    def key_name(self, core: str, other: str) -> str:
        """The key of `core` toward `other`; toward itself that of its first match."""
        for a, b, ka, kb in self.matches:
            if core == other and core in (a, b):
                return ka if core == a else kb
            if (core, other) == (a, b):
                return ka
            if (core, other) == (b, a):
                return kb
        raise ValueError(f"no match of {core} and {other}")

    def used_cores(self) -> set[str]:
        named = {self.results_from, *self.queries, *self.filters, *self.excludes, *self.facet_filters, *self.drilldowns, *self.facets, *self.ranks}
        return named | {c for a, _, b, _ in self.unites for c in (a, b)} | {s.core for s in self.sort_keys if s.core}

    def validate(self) -> None:
        for core in self.used_cores() - {self.results_from}:
            self.key_name(core, self.results_from)
        if self.relational is not None and not isinstance(self.relational, _RELATIONAL):
            raise ValueError("relational must be a tree of And, Or, Not and Leaf")

    def single(self) -> bool:
        return len(self.used_cores()) <= 1 and not self.export_key and self.relational is None and not any(isinstance(f, _RELATIONAL) for fs in self.filters.values() for f in fs)

    def drilldown_nodes(self, core: str) -> list[Node]:
        return [Drilldown(dim=d, path=tuple(p)) for d, p in self.drilldowns.get(core, [])]


def execute(query: ComposedQuery, cores: dict[str, Core], *, keep: bool = False) -> Response:
    """With `keep` the matches are written to the shared folder once, so that hits, total, facets and keys don't repeat the joins that find them."""
    query.validate()
    core = cores[query.results_from]
    main = query.queries.get(query.results_from, MatchAll())
    if isinstance(main, _RELATIONAL):
        main = MatchAll()
    main = must(main, *query.drilldown_nodes(query.results_from)) if query.drilldowns.get(query.results_from) else main
    rows = core.df if query.single() else _restricted(query, cores)
    tests = [predicate(core, main)]
    if query.single():
        tests += [predicate(core, f) for f in query.filters.get(core.name, [])]
        tests += [~predicate(core, f) for f in query.excludes.get(core.name, [])]
    matched = rows.where(reduce(lambda a, b: a & b, tests))
    if keep:
        path = shared_folder(matched.sparkSession)
        matched.write.parquet(path)
        matched = matched.sparkSession.read.schema(matched.schema).parquet(path)
    hits, total = _hits(query, cores, matched, main)
    found = _facets(query, cores, matched)
    keys = distinct_keys(matched, core.col(query.export_key)) if query.export_key else None
    clusters = _clusters(query, core, matched, main) if query.clustering else None
    suggestions = spelling(core, **query.suggest) if query.suggest else None
    return Response(matched, hits, total, found, keys, clusters, suggestions)


def _clusters(query: ComposedQuery, core: Core, matched: DataFrame, main: Node) -> DataFrame:
    best = with_scores(core, matched, main).orderBy(F.desc("score"), core.order).limit(query.stop + query.cluster_more)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), core.order)))
    return clustered(core, ranked, query.clustering, stop=query.stop, more=query.cluster_more)


def _restricted(query: ComposedQuery, cores: dict[str, Core]) -> DataFrame:
    """Rows of the result core that all key sets allow."""
    result = query.results_from
    core = cores[result]
    sets: dict[str, list[KeySet]] = {}
    own = lambda other: query.key_name(result, other)
    keys_of = lambda other, node: evaluate(node, cores) if isinstance(node, _RELATIONAL) else collect_keys(cores[other], query.key_name(other, result), node)
    if query.relational is not None:
        sets.setdefault(own(result), []).append(evaluate(query.relational, cores))
    else:
        for a, qa, b, qb in query.unites:
            sets.setdefault(own(a), []).append(keys_of(a, qa) | keys_of(b, qb))
        for other, nodes in query.filters.items():
            for node in nodes:
                sets.setdefault(own(other), []).append(keys_of(other, node))
    for other in cores:
        if other == result or other not in query.queries and other not in query.drilldowns:
            continue
        node = must(query.queries.get(other, MatchAll()), *query.drilldown_nodes(other))
        sets.setdefault(own(other), []).append(keys_of(other, node))
    rows = core.df
    for name in sorted(sets):
        for s in sets[name]:
            rows = s.keep(rows, core.col(name))
    excluded: dict[str, list[KeySet]] = {}
    for other, nodes in query.excludes.items():
        for node in nodes:
            excluded.setdefault(own(other), []).append(keys_of(other, node))
    for name in sorted(excluded):  # a row goes only if its key is in all of a key name's sets
        rows = (~reduce(lambda a, b: a & b, excluded[name])).keep(rows, core.col(name))
    return rows


def _ranked(query: ComposedQuery, cores: dict[str, Core], rows: DataFrame) -> DataFrame:
    by_key: dict[str, list[DataFrame]] = {}
    result = query.results_from
    for other, node in query.ranks.items():
        their = cores[other]
        scored = with_scores(their, their.df.where(predicate(their, node)), node, "other")
        key = valid_key(their.col(query.key_name(other, result)))
        if query.quantised:
            scored = scored.withColumn("other", quantised(F.col("other")))
        by_key.setdefault(query.key_name(result, other), []).append(scored.select(key.alias("key"), "other").where("key is not null").groupBy("key").agg(F.max("other").alias("other")))
    for name in sorted(by_key):
        rows = blended(rows, cores[result].col(name), by_key[name], query.rank_ratio)
    return rows


def _order(query: ComposedQuery, cores: dict[str, Core], rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    core = cores[query.results_from]
    order: list[Column] = []
    for i, key in enumerate(query.sort_keys):
        if key.core and key.core != core.name:
            other = cores[key.core]
            values = last_by_key(other, query.key_name(key.core, core.name), key.field, f"__sort{i}").withColumnRenamed("__key", f"__key{i}")
            rows = rows.join(values, valid_key(core.col(query.key_name(core.name, key.core))) == F.col(f"__key{i}"), "left")
            order.append(joined_order_column(F.col(f"__sort{i}"), key))
        else:
            order.append(order_column(F.col("score") if key.field == "score" else core.col(key.field), key))
    if not query.sort_keys:
        order.append(F.desc("score"))
    return rows, [*order, F.asc(core.order)]


def _hits(query: ComposedQuery, cores: dict[str, Core], matched: DataFrame, main: Node) -> tuple[DataFrame, DataFrame]:
    core = cores[query.results_from]
    by_fields = bool(query.sort_keys) and not any(k.field == "score" for k in query.sort_keys)
    rows = matched
    if not by_fields:  # sorted by fields, a hit has no score
        rows = with_scores(core, rows, main)
        if query.ranks and not query.single():
            rows = _ranked(query, cores, rows)
    else:
        rows = rows.withColumn("score", F.lit(None).cast("double"))
    rows, order = _order(query, cores, rows)
    collected = [c.alias(name) for name, c in query.collectors.items()]
    if not query.dedup:
        stored = [F.array(core.col(f)).alias(f) if not core.is_array(f) else core.col(f).alias(f) for f in query.stored if core.has(f) and core.role(f).stored]
        hits = page(rows, order, query.start, query.stop).select(F.col(core.id).alias("id"), "score", *stored)
        return hits, matched.agg(F.count("*").alias("total"), F.count("*").alias("total_with_duplicates"), *collected)
    groups = deduplicated(core, rows, query.dedup, order, query.dedup_sort)
    hits = page(groups, order, query.start, query.stop).select(F.col("rep").alias("id"), "score", "duplicate_count")
    key = valid_key(core.col(query.dedup))
    total = matched.agg((F.count_distinct(key) + F.sum(F.when(key.isNull(), 1).otherwise(0))).alias("total"), F.count("*").alias("total_with_duplicates"), *collected)
    return hits, total.select(F.coalesce("total", F.lit(0)).alias("total"), "total_with_duplicates", *query.collectors)


def _facets(query: ComposedQuery, cores: dict[str, Core], matched: DataFrame) -> DataFrame | None:
    result = query.results_from
    parts: list[DataFrame] = []
    for name, wanted in query.facets.items():
        core = cores[name]
        rows = matched
        if name != result:
            nodes = [query.queries.get(name, MatchAll()), *query.filters.get(name, []), *query.facet_filters.get(name, []), *query.drilldown_nodes(name)]
            rows = core.df.where(reduce(lambda a, b: a & b, [predicate(core, n) for n in nodes if not isinstance(n, _RELATIONAL)], F.lit(True)))
            keys = KeySet(distinct_keys(matched, cores[result].col(query.key_name(result, name))))
            for k in [keys, *(evaluate(n, cores) for n in nodes if isinstance(n, _RELATIONAL))]:
                rows = k.keep(rows, core.col(query.key_name(name, result)))
        if wanted:
            parts.append(facet_op.facets_counted(core, rows, wanted))
    return reduce(DataFrame.unionByName, parts) if parts else None


def rows_from(response: Response) -> DataFrame:
    """Hits with their rank from 1, one JSON object a row, as a server would send them; a missing score is left out."""
    ranked = response.hits.withColumn("rank", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    return ranked.select("rank", F.to_json(F.struct(*response.hits.columns)).alias("hit"))
