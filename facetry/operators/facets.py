"""Facet counts: how many rows have each label, flat or over all levels of a hierarchy. A row counts once for each distinct path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.core import Core

SCHEMA = "core string, dim string, path array<string>, label string, level int, count long"


@dataclass(frozen=True)
class Facet:
    """The labels below `path`, `top` of them at each parent, 0 for all; over all levels where the field is hierarchical."""

    dim: str
    top: int = 10
    path: tuple[str, ...] = ()


def path_counts(core: Core, rows: DataFrame, dim: str) -> DataFrame:
    """(path, count) of every path and each of its beginnings."""
    column = core.role(dim).column or dim
    if column in rows.columns and not core.is_array(dim):  # a plain value: no arrays to take apart before they are counted
        value = F.col(column).cast("string")
        return rows.where(value.isNotNull() & (value != "")).groupBy(value.alias("value")).agg(F.count("*").alias("count")).select(F.array("value").alias("path"), "count")
    return rows.select(F.explode(_begins(core, dim)).alias("path")).groupBy("path").agg(F.count("*").alias("count"))


def _begins(core: Core, dim: str) -> Column:
    """All paths of a row and their beginnings, each once."""
    return F.array_distinct(F.flatten(F.transform(core.paths(dim), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.slice(p, 1, n)))))


def _numbered(core: Core, dim: str, k: int) -> Column:
    return F.transform(_begins(core, dim), lambda p: F.struct(F.lit(k).alias("of"), p.alias("path")))


def paths_with_root(core: Core, rows: DataFrame, dim: str) -> DataFrame:
    """(path, count) as `path_counts`, and with the empty path the number of rows that have the dimension at all."""
    root = rows.agg(F.count(F.when(F.size(core.paths(dim)) > 0, 1)).alias("count")).select(F.array().cast("array<string>").alias("path"), "count")
    return path_counts(core, rows, dim).unionByName(root)


def specific_value(core: Core, rows: DataFrame, dim: str, path: tuple[str, ...]) -> DataFrame:
    """(count) of one path, -1 where no row has it."""
    counts = path_counts(core, rows, dim).where(F.col("path") == F.array(*map(F.lit, path)))
    return counts.agg(F.coalesce(F.max("count"), F.lit(-1)).alias("count"))


def facet_counts(core: Core, rows: DataFrame, facet: Facet) -> DataFrame:
    """(core, dim, path, label, level, count): labels of each parent by descending count, then label. `path` is the parent's."""
    return facets_counted(core, rows, [facet])


def facets_counted(core: Core, rows: DataFrame, wanted: list[Facet]) -> DataFrame:
    """As `facet_counts` for several facets, in one pass over the rows and one aggregate."""
    if len(wanted) == 1:
        counts = path_counts(core, rows, wanted[0].dim).withColumn("of", F.lit(0))
    else:
        begins = [_numbered(core, f.dim, k) for k, f in enumerate(wanted)]
        counts = rows.select(F.explode(F.concat(*begins)).alias("x")).groupBy("x.of", "x.path").agg(F.count("*").alias("count"))

    def by_facet(value):
        out = F.lit(None)
        for k, f in enumerate(wanted):
            out = F.when(F.col("of") == k, value(f)).otherwise(out)
        return out

    deep = {f: core.role(f.dim).hierarchical for f in wanted}
    below = by_facet(lambda f: F.slice("path", 1, len(f.path)) == F.array(*map(F.lit, f.path)).cast("array<string>"))
    level = by_facet(lambda f: F.size("path") > len(f.path) if deep[f] else F.size("path") == len(f.path) + 1)
    counts = counts.where(below & level)
    parent = F.slice("path", 1, F.size("path") - 1)
    if any(f.top > 0 for f in wanted):
        ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("of", parent).orderBy(F.desc("count"), F.element_at("path", -1))))
        if any(deep[f] and f.top > 0 for f in wanted):
            # A label shows only if its ancestors do.
            start = by_facet(lambda f: F.lit(len(f.path) + 1))
            up = ranked.select("of", "path", "count", F.explode(F.transform(F.sequence(start, F.size("path")), lambda n: F.slice("path", 1, n))).alias("above"))
            ranks = ranked.select("of", F.col("path").alias("above"), "rn")
            ranked = up.join(ranks, ["of", "above"]).groupBy("of", "path").agg(F.first("count").alias("count"), F.max("rn").alias("rn"))
        counts = ranked.where(by_facet(lambda f: F.lit(True) if f.top <= 0 else F.col("rn") <= f.top))
    return counts.select(F.lit(core.name).alias("core"), by_facet(lambda f: F.lit(f.dim)).alias("dim"), parent.alias("path"), F.element_at("path", -1).alias("label"), F.size("path").alias("level"), "count")
