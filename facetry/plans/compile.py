"""Query trees to columns: predicates, and scores over a one-row table of statistics.

A predicate on a missing value is false, never unknown, so that its negation is true. A boolean needs all MUST and no
MUST_NOT clauses to match, and one SHOULD clause if there is no MUST; without either it matches nothing.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.analysis import haversine, phrase_count, placed_phrase_count
from facetry.operators.core import Core
from facetry.plans.nodes import MUST, MUST_NOT, SHOULD, Bool, Distance, Drilldown, MatchAll, Node, Phrase, Prefix, Range, Term, Wildcard

_CAST = {"Int": "int", "Long": "long", "Double": "double", "String": "string"}


def wildcard_pattern(value: str) -> str:
    return "(?s)^" + "".join({"?": ".", "*": ".*"}.get(c, re.escape(c)) for c in value) + "$"


def _plain(core: Core, field: str) -> bool:
    return core.role(field).kind != "text" and core.role(field).kind != "set" and not core.is_array(field)


def _any(core: Core, field: str, test) -> Column:
    """Whether a term of the field passes; a scalar column is tested as it is, which lets scans prune by it."""
    if _plain(core, field):
        return test(core.col(field).cast("string"))
    return F.exists(core.tokens(field), test)


def _phrase_count(core: Core, field: str, terms: tuple[str, ...]) -> Column:
    if core.ordered(field) or len(terms) < 2:
        return phrase_count(core.tokens(field), list(terms))
    return placed_phrase_count(core.placed(field), list(terms))


def _range(core: Core, node: Range) -> Column:
    def within(value: Column) -> Column:
        tests = []
        if node.low is not None:
            low = F.lit(node.low).cast(_CAST[node.kind])
            tests.append(value >= low if node.with_low else value > low)
        if node.high is not None:
            high = F.lit(node.high).cast(_CAST[node.kind])
            tests.append(value <= high if node.with_high else value < high)
        return reduce(and_, tests, value.isNotNull())

    if node.kind == "String":
        return _any(core, node.field, within)
    if core.is_array(node.field):
        return F.exists(core.col(node.field), within)
    return within(core.col(node.field))


def _distance(core: Core, node: Distance) -> Column:
    point = core.col(node.field)
    lat, lon = point.getField("lat"), point.getField("lon")
    # A degree of latitude is at least 110.5 km: a cheap test before the exact one.
    near = F.abs(lat - node.lat) <= node.radius / 110_500.0
    return near & (haversine(lat, lon, node.lat, node.lon) <= node.radius)


def _raw(core: Core, node: Node) -> Column:
    match node:
        case MatchAll():
            return F.lit(True)
        case Term(field=field, value=value):
            return core.col(field).cast("string") == value if _plain(core, field) else core.may_hold(field, [value]) & F.array_contains(core.tokens(field), value)
        case Drilldown(dim=dim, path=path):
            wanted = F.array(*map(F.lit, path)).cast("array<string>")
            return F.exists(core.paths(dim), lambda p: F.slice(p, 1, len(path)) == wanted)
        case Prefix(field=field, value=value):
            return core.may_hold(field, [value]) & _any(core, field, lambda t: t.startswith(value))
        case Wildcard(field=field, value=value):
            return _any(core, field, lambda t: t.rlike(wildcard_pattern(value)))
        case Phrase(field=field, terms=terms):
            if core.role(field).kind == "set" and len(terms) > 1:
                return F.lit(False)
            return core.may_hold(field, list(terms)) & (_phrase_count(core, field, terms) > 0)
        case Range():
            return _range(core, node)
        case Distance():
            return _distance(core, node)
        case Bool(clauses=clauses):
            by = {o: [predicate(core, n) for c, n in clauses if c == o] for o in (MUST, SHOULD, MUST_NOT)}
            if not by[MUST] and not by[SHOULD]:
                return F.lit(False)
            positive = by[MUST] or [reduce(or_, by[SHOULD])]
            return reduce(and_, [*positive, *(~p for p in by[MUST_NOT])])
    raise TypeError(f"no predicate for {type(node).__name__}")


def predicate(core: Core, node: Node) -> Column:
    return F.coalesce(_raw(core, node), F.lit(False))


def scored_leaves(node: Node) -> list[Term | Phrase | Drilldown]:
    """Leaves whose score depends on statistics, each once, in order."""
    if isinstance(node, Bool):
        found = [leaf for o, n in node.clauses if o != MUST_NOT for leaf in scored_leaves(n)]
        return list(dict.fromkeys(found))
    if isinstance(node, (Term, Phrase, Drilldown)):
        return [type(node)(**{**node.__dict__, "boost": 1.0})]
    return []


def _field(leaf: Term | Phrase | Drilldown) -> str:
    return leaf.dim if isinstance(leaf, Drilldown) else leaf.field


def _terms(leaf: Term | Phrase | Drilldown) -> list[Node]:
    """What has a document frequency of its own."""
    return [Term(field=leaf.field, value=t) for t in leaf.terms] if isinstance(leaf, Phrase) else [leaf]


def _length(core: Core, field: str, leaf: Node) -> Column:
    return F.size(core.paths(field)) if isinstance(leaf, Drilldown) else core.length(field)


def with_scores(core: Core, df: DataFrame, node: Node, name: str = "score") -> DataFrame:
    """`df`, rows of the core, with the score of each; statistics are those of the whole core.

    N and the average length are over the rows that have the field. The statistics are one row, which is joined to every row.
    """
    leaves = scored_leaves(node)
    if core.similarity.kind == "tf" or not leaves:
        return df.withColumn(name, _score(core, node, {}).cast("double"))
    fields = {(_field(x), isinstance(x, Drilldown)): x for x in leaves}
    columns = [c for c in df.columns if c != name]
    texts = [f for f, drill in fields if not drill and core.ordered(f)]
    terms = list(dict.fromkeys(t for x in leaves for t in _terms(x)))
    stats, names, lengths = [], {}, []
    for k, ((f, drill), leaf) in enumerate(fields.items()):
        lengths.append(_length(core, f, leaf).alias(f"__l{k}"))
        length = F.col(f"__l{k}")
        stats += [F.sum((length > 0).cast("long")).alias(f"__n{k}"), F.avg(F.when(length > 0, length)).alias(f"__avg{k}")]
        names[f, drill] = k
    for k, t in enumerate(terms):
        lengths.append(predicate(core, t).cast("long").alias(f"__p{k}"))
        stats.append(F.sum(f"__p{k}").alias(f"__df{k}"))
    row = core.df.select(*lengths).agg(*stats)
    idf = {}
    for k, t in enumerate(terms):
        n = F.col(f"__n{names[_field(t), isinstance(t, Drilldown)]}")
        idf[t] = F.log1p((n - F.col(f"__df{k}") + 0.5) / (F.col(f"__df{k}") + 0.5))
    at = {leaf: (reduce(add, [idf[t] for t in _terms(leaf)]), F.col(f"__avg{names[_field(leaf), isinstance(leaf, Drilldown)]}")) for leaf in leaves if _terms(leaf)}
    # Only the rows to be scored get their terms; the statistics count terms and look for those asked for.
    here, df = core.tokenised(texts, df)
    joined = df.crossJoin(F.broadcast(row)).withColumn(name, _score(here, node, at).cast("double"))
    return joined.select(*columns, name)


def _tf(core: Core, leaf: Term | Phrase | Drilldown) -> Column:
    if isinstance(leaf, Drilldown):
        return predicate(core, leaf).cast("int")
    if isinstance(leaf, Phrase):
        return F.when(predicate(core, leaf), _phrase_count(core, leaf.field, leaf.terms)).otherwise(0)
    if _plain(core, leaf.field):
        return predicate(core, leaf).cast("int")
    return F.size(F.filter(core.tokens(leaf.field), lambda t: t == leaf.value))


def _score(core: Core, node: Node, at: dict) -> Column:
    if isinstance(node, Bool):
        parts = [_score(core, n, at) for o, n in node.clauses if o != MUST_NOT]
        return F.when(predicate(core, node), reduce(add, parts) if parts else F.lit(0.0)).otherwise(0.0) * node.boost
    if isinstance(node, (Term, Phrase, Drilldown)):
        leaf = type(node)(**{**node.__dict__, "boost": 1.0})
        tf, s = _tf(core, leaf).cast("double"), core.similarity
        if s.kind == "tf":
            return tf / 1000.0 * node.boost
        if leaf not in at:
            return F.lit(0.0)
        idf, average = at[leaf]
        if s.weight:
            return F.when(tf > 0, s.weight(tf, idf, _length(core, _field(leaf), leaf), average)).otherwise(0.0) * node.boost
        kind = core.role(_field(leaf)).kind
        norm = F.lit(s.k1) if isinstance(leaf, Drilldown) or kind != "text" else s.k1 * (1 - s.b + s.b * _length(core, _field(leaf), leaf) / average)
        return F.when(tf > 0, idf * tf / (tf + norm)).otherwise(0.0) * node.boost
    return F.when(predicate(core, node), F.lit(float(node.boost))).otherwise(0.0)
