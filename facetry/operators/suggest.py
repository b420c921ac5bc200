"""Autocomplete: distinct values with their n-grams, looked up by the n-grams of what was typed and ranked again by edit distance."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.analysis import ngrams

RECORDS = "id string, key long, type string, creator string, value string"


def _equals(gram: str):
    return lambda x: x == gram


def build(records: DataFrame, n: int = 3) -> DataFrame:
    """One suggestion for each distinct (type, creator, value) of the last version of each record, with the keys of its records and its n-grams.

    `records`: id, key, values (an array of (type, creator, value)) and `seq`, by which the last version of an id counts.
    """
    last = records.groupBy("id").agg(F.max_by(F.struct("key", "values"), "seq").alias("r")).select("id", "r.key", F.explode("r.values").alias("v"))
    grouped = last.groupBy("v.type", "v.creator", "v.value").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return grouped.where("value is not null").withColumn("grams", ngrams(F.col("value"), n))


def suggest(suggestions: DataFrame, typed: str, n: int = 3, limit: int = 25, filters: dict[str, str] | None = None, key_set: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(value, type, creator, score): suggestions that hold all n-grams of `typed` but the last, by BM25 over the n-grams.

    `filters` are equalities that all hold; with `key_set` (a column `key`) only suggestions of one of its records stay.
    """
    words = [f"${w}$" for w in "".join(c if c.isalnum() else " " for c in typed.lower()).split()]
    grams = [w[i : i + n] for w in words for i in range(len(w) - n + 1)][:-1]
    wanted = list(dict.fromkeys(grams))
    if not wanted:
        return suggestions.select("value", "type", "creator", F.lit(0.0).alias("score")).limit(0)
    stats = suggestions.agg(F.count("*").alias("n"), F.avg(F.size("grams")).alias("avg"), *(F.sum(F.array_contains("grams", g).cast("long")).alias(f"df{i}") for i, g in enumerate(wanted)))
    rows = suggestions.where(reduce(lambda a, c: a & c, [F.array_contains("grams", g) for g in wanted]))
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name) == value)
    if key_set is not None:
        held = rows.select("type", "creator", "value", F.explode("keys").alias("key")).join(key_set.select("key"), "key", "left_semi").select("type", "creator", "value").distinct()
        same = reduce(lambda a, c: a & c, [rows[x].eqNullSafe(held[x]) for x in ("type", "creator", "value")])
        rows = rows.join(held, same, "left_semi")
    parts = []
    for i, g in enumerate(wanted):
        tf = F.size(F.filter("grams", _equals(g)))
        weight = F.log1p((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * tf / (tf + k1 * (1 - b + b * F.size("grams") / F.col("avg")))
        parts.append(weight * grams.count(g))
    scored = rows.crossJoin(F.broadcast(stats)).select("value", "type", "creator", reduce(lambda a, c: a + c, parts).alias("score"))
    return scored.orderBy(F.desc("score"), "value", "type", "creator").limit(limit)


def rerank(found: DataFrame, typed: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """(value, type, score): by max(0, 1 - ln(distance + 1) / 4) * score ** 2 * 2 * the number of typed words that are in the value; a text counts once."""
    words = typed.lower().split()
    value = F.lower("value")
    match = reduce(lambda a, c: a + c, [F.contains(value, F.lit(w)).cast("int") for w in words], F.lit(0))
    distance = F.levenshtein(value, F.lit(typed.lower()))
    score = F.greatest(F.lit(0.0), 1 - F.log(distance + 1.0) / 4) * F.pow("score", F.lit(2)) * 2 * match
    scored = found.select("value", "type", score.alias("score")).where(F.col("score") > min_score)
    best = scored.groupBy("value").agg(F.max_by("type", F.struct("score", "type")).alias("type"), F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "value").limit(limit)


@dataclass
class Suggester:
    """Suggestions with named key sets, by which a lookup can be restricted, and what an administrator asks for."""

    suggestions: DataFrame
    key_sets: dict[str, DataFrame] = field(default_factory=dict)
    built: float = field(default_factory=time.time)

    def register(self, name: str, keys: DataFrame) -> None:
        """`keys` has a column `key`."""
        self.key_sets[name] = keys

    def rebuild(self, records: DataFrame, n: int = 3) -> None:
        self.suggestions, self.built = build(records, n), time.time()

    def suggest(self, typed: str, key_set: str | None = None, **arguments) -> DataFrame:
        """As `suggest`; a name that isn't registered filters nothing."""
        return suggest(self.suggestions, typed, key_set=self.key_sets.get(key_set) if key_set else None, **arguments)

    def info(self) -> DataFrame:
        """(suggestions, key_sets, built): one row."""
        return self.suggestions.agg(F.count("*").alias("suggestions")).select("suggestions", F.lit(len(self.key_sets)).alias("key_sets"), F.lit(self.built).alias("built"))
