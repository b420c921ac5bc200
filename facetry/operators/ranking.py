"""Order, paging, grouping by key and score blending over matched rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.core import Core
from facetry.operators.keys import valid_key


@dataclass(frozen=True)
class SortKey:
    """By a field, or by the score where `field` is 'score'; of another core where `core` is named.

    Missing strings and integers come last in both directions, missing doubles count as 0, unless `missing` gives a value.
    """

    field: str
    descending: bool = False
    kind: str = "String"
    missing: Any = None
    core: str | None = None


_TYPES = {"String": "string", "Int": "int", "Long": "long", "Double": "double"}


def order_column(value: Column, key: SortKey) -> Column:
    value = value.cast(_TYPES[key.kind]) if key.field != "score" else value
    missing = 0.0 if key.missing is None and key.kind == "Double" else key.missing
    if missing is not None and key.field != "score":
        value = F.coalesce(value, F.lit(missing).cast(_TYPES[key.kind]))
    return value.desc_nulls_last() if key.descending else value.asc_nulls_last()


def joined_order_column(value: Column, key: SortKey) -> Column:
    """As `order_column` for a field of another core: missing strings are last ascending and first descending, missing numbers count as 0."""
    value = value.cast(_TYPES[key.kind])
    if key.kind == "String":
        return value.desc_nulls_first() if key.descending else value.asc_nulls_last()
    value = F.coalesce(value, F.lit(0 if key.missing is None else key.missing).cast(_TYPES[key.kind]))
    return value.desc() if key.descending else value.asc()


def last_by_key(core: Core, key: str, field: str, name: str) -> DataFrame:
    """(__key, name): the field of the last row of each key."""
    rows = core.df.select(valid_key(core.col(key)).alias("__key"), core.col(field).alias("__value"), F.col(core.order).alias("__order")).where("__key is not null")
    return rows.groupBy("__key").agg(F.max_by("__value", "__order").alias(name))


def deduplicated(core: Core, rows: DataFrame, key: str, order: list[Column], best_by: list[str] = []) -> DataFrame:
    """One row for each key, where its best ranked row stands; `rep` is the id of the row with the largest `best_by` fields (missing: 0), then the last one.

    Adds `duplicate_count`. Rows without a key are groups of their own.
    """
    k = valid_key(core.col(key))
    group = [F.coalesce(k, F.lit(-1)), F.when(k.isNull(), F.col(core.id))]
    size = Window.partitionBy(*group)
    largest = F.struct(*(F.coalesce(core.col(f).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, f in enumerate(best_by)), F.col(core.order).alias("last"))
    marked = rows.withColumn("__rn", F.row_number().over(size.orderBy(*order))).withColumn("duplicate_count", F.count("*").over(size)).withColumn("rep", F.max_by(core.id, largest).over(size))
    return marked.where("__rn = 1").drop("__rn")


def quantised(score: Column) -> Column:
    """The score as a float of 11 significant bits between 2 ** -20 and 4095; less than that, and negative ones, are 0."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(score)) - 10)
    return F.when(score >= 2.0**-20, F.least(F.floor(score / step) * step, F.lit(4095.0))).otherwise(0.0)


def blended(rows: DataFrame, key: Column, scores: list[DataFrame], ratio: float = 0.5, name: str = "score") -> DataFrame:
    """(1 - ratio) * score + ratio * product of (1 + other score), the others by key: DataFrames (key, other)."""
    if not 0 <= ratio <= 1:
        ratio = 0.5
    out = rows.withColumn("__k", valid_key(key))
    for i, s in enumerate(scores):
        out = out.join(s.select(F.col("key").alias(f"__k{i}"), F.col("other").alias(f"__o{i}")), F.col("__k") == F.col(f"__k{i}"), "left")
    product = reduce(lambda a, b: a * b, [1 + F.coalesce(F.col(f"__o{i}"), F.lit(0.0)) for i in range(len(scores))], F.lit(1.0))
    return out.withColumn(name, (1 - ratio) * F.col(name) + ratio * product).drop("__k", *(f"__{x}{i}" for i in range(len(scores)) for x in "ko"))


def page(rows: DataFrame, order: list[Column], start: int = 0, stop: int = 10) -> DataFrame:
    """Rows `start` to before `stop` in the order; none where stop is not beyond start."""
    if stop <= start:
        return rows.limit(0)
    return rows.orderBy(*order).offset(start).limit(stop - start) if start else rows.orderBy(*order).limit(stop)
