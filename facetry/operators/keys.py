"""Key sets and their algebra. A key set is a one-column DataFrame `key` of distinct positive longs and whether it is meant inverted.

Key 0 and negative keys mean that there is none. A complement stays lazy: it is resolved by an anti-join where rows are filtered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.core import Core
from facetry.plans.compile import predicate
from facetry.plans.nodes import And, Leaf, Node, Not, Or


def valid_key(c: Column) -> Column:
    """The key as a long; null unless positive."""
    long = c.cast("long")
    return F.when(long > 0, long)


@dataclass(frozen=True)
class KeySet:
    df: DataFrame
    inverted: bool = False

    def __invert__(self) -> KeySet:
        return KeySet(self.df, not self.inverted)

    def __and__(self, other: KeySet) -> KeySet:
        if self.inverted and other.inverted:
            return KeySet(_union(self.df, other.df), True)
        if self.inverted or other.inverted:
            plain, minus = (other, self) if self.inverted else (self, other)
            return KeySet(plain.df.join(minus.df, "key", "left_anti"))
        return KeySet(self.df.join(other.df, "key", "left_semi"))

    def __or__(self, other: KeySet) -> KeySet:
        if not self.inverted and not other.inverted:
            return KeySet(_union(self.df, other.df))
        return ~(~self & ~other)

    def keep(self, rows: DataFrame, key: Column) -> DataFrame:
        """Rows whose key is in the set. Those without a key are in none but a complement."""
        mine = self.df.select(F.col("key").alias("__key"))
        return rows.join(mine, valid_key(key) == F.col("__key"), "left_anti" if self.inverted else "left_semi")

    def resolved(self, rows: DataFrame, key: Column) -> DataFrame:
        """The set as a plain one, a complement being taken in the keys of `rows`."""
        return self.df if not self.inverted else distinct_keys(self.keep(rows, key), key)


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def distinct_keys(rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(valid_key(key).alias("key")).where("key is not null").distinct()


def bitmap_keys(maps: DataFrame) -> DataFrame:
    """(key): what `bitmaps` wrote, read back."""
    byte = F.conv(F.substring(F.hex("bits"), 2 * F.col("at") + 1, F.lit(2)), 16, 10).cast("int")
    bytes_ = maps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("at")).select("bucket", "at", byte.alias("byte")).where("byte > 0")
    bits = bytes_.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("getbit(byte, bit) = 1")
    return bits.select(((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("bit") + 1).alias("key"))


def bitmaps(keys: DataFrame) -> DataFrame:
    """(bucket, bits): a key set as bitmaps of 32,768 keys each; bucket 1 begins with key 1."""
    return keys.groupBy(F.bitmap_bucket_number("key").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits"))


def collect_keys(core: Core, key: str, node: Node) -> KeySet:
    return KeySet(distinct_keys(core.df.where(predicate(core, node)), core.col(key)))


class KeyNode(Node):
    """A relational node of the caller's own: a subclass says which keys it has, of those in `within` if that is given."""

    def keys(self, cores: dict[str, Core], within: KeySet | None) -> KeySet:
        raise NotImplementedError


def evaluate(node: Node, cores: dict[str, Core], within: KeySet | None = None, plus: KeySet | None = None, invert: bool = False) -> KeySet:
    """Key set of a tree of And, Or, Not and Leaf nodes.

    `within` filters the rows of leaves and `plus` adds rows to them. And and Or end in the key space of their second operand.
    Not over a leaf is a matter of rows: a key is in if any of its rows doesn't match; over And and Or it is one of keys.
    """
    if isinstance(node, Leaf):
        core = cores[node.core]
        match, key = predicate(core, node.query), core.col(node.filter_key)
        rows = core.df.where(~match if invert else match)
        found = distinct_keys(within.keep(rows, key) if within else rows, core.col(node.collect_key))
        if plus:
            found = _union(found, distinct_keys(plus.keep(core.df, key), core.col(node.collect_key)))
        return KeySet(found)
    if isinstance(node, Not):
        inner = evaluate(node.query, cores, within, None if within else plus, not invert)
        return inner | plus if plus else inner
    if isinstance(node, And):
        first = evaluate(node.first, cores, within)
        keys = evaluate(node.second, cores, first, None if invert else plus)
    elif isinstance(node, Or):
        first = evaluate(node.first, cores, within, plus if not within and not invert else None)
        keys = evaluate(node.second, cores, within, first)
        if plus and not invert:
            keys = keys | plus
    elif isinstance(node, KeyNode):
        keys = node.keys(cores, within)
        keys = keys | plus if plus and not invert else keys
    else:
        raise TypeError(f"not a relational node: {type(node).__name__}")
    if invert:
        keys = ~keys
        if within:
            keys = within & keys
        elif plus:
            keys = plus | keys
    return keys
