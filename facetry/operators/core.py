"""A core: a named DataFrame whose columns have roles as fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.functions.analysis import ANALYZERS, TOKEN, positions, standard, word_pattern

KINDS = ("text", "string", "set", "int", "long", "double", "numeric", "key", "facet", "geo")


@dataclass(frozen=True)
class Field:
    """A column in a role. A `text` field is analysed; a `set` field too, but it counts each term once and knows no order.

    Between two values of a `text` field lie `gap` places, which a phrase can't cross; without a gap it can.
    """

    kind: str = "text"
    column: str | None = None
    analyzer: str = "standard"
    hierarchical: bool = False
    stored: bool = True
    gap: int = 0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of field: {self.kind}")


@dataclass(frozen=True)
class Similarity:
    """bm25 with k1 and b; tf: occurrences / 1000; or the caller's own `weight` of (occurrences, idf, length, average length), all columns."""

    kind: str = "bm25"
    k1: float = 1.2
    b: float = 0.75
    weight: Callable[[Column, Column, Column, Column], Column] | None = None


@dataclass
class Core:
    """`order` is the column that settles ties; it defaults to the id."""

    name: str
    df: DataFrame
    id: str = "id"
    fields: dict[str, Field] = field(default_factory=dict)
    order: str | None = None
    similarity: Similarity = Similarity()
    #: Columns that hold the terms of fields already.
    ready: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.order = self.order or self.id

    def role(self, name: str) -> Field:
        """The declared field, or one that follows from the column's type."""
        if name in self.fields:
            return self.fields[name]
        if name not in self.df.columns:
            return Field("string", None)
        kind = self.df.schema[name].dataType
        of = {T.IntegerType: "int", T.ShortType: "int", T.LongType: "long", T.DoubleType: "double", T.FloatType: "double"}
        return Field(of.get(type(kind), "string"), name)

    def has(self, name: str) -> bool:
        return self._column(name) in self.df.columns

    def _column(self, name: str) -> str:
        return self.role(name).column or name

    def col(self, name: str) -> Column:
        """The field's column; null for one that doesn't exist."""
        column = self._column(name)
        return F.col(column) if column in self.df.columns else F.lit(None).cast("string")

    def is_array(self, name: str) -> bool:
        column = self._column(name)
        return column in self.df.columns and isinstance(self.df.schema[column].dataType, T.ArrayType)

    def values(self, name: str) -> Column:
        """The field's values as an array without nulls."""
        c = self.col(name)
        array = c if self.is_array(name) else F.array(c)
        return F.filter(array, lambda x: x.isNotNull())

    def tokens(self, name: str) -> Column:
        """Terms of a searchable field: analysed text, or the values as they are."""
        role = self.role(name)
        if name in self.ready:
            return F.col(self.ready[name])
        if role.kind in ("text", "set"):
            if role.analyzer == "dutch" and self.is_array(name):
                out = F.transform(self.placed(name), lambda t: t.term)
                return F.array_distinct(out) if role.kind == "set" else out
            analyze = ANALYZERS[role.analyzer]
            out = F.flatten(F.transform(F.coalesce(self.col(name), F.array().cast("array<string>")), analyze)) if self.is_array(name) else analyze(self.col(name))
            return F.array_distinct(out) if role.kind == "set" else out
        return F.coalesce(F.transform(self.values(name), lambda x: x.cast("string")), F.array().cast("array<string>"))

    def placed(self, name: str) -> Column:
        """Terms of a text field with their places: (term, pos). Stems share the place of their word."""
        role = self.role(name)
        if role.analyzer != "dutch":
            texts = self.col(name) if self.is_array(name) else F.when(self.col(name).isNotNull(), F.array(self.col(name)))
            return positions(texts, ANALYZERS[role.analyzer], role.gap)
        from facetry.functions.stemming import VALUE_BREAK, dutch_tokens

        text = F.array_join(self.col(name), f" {VALUE_BREAK} ") if self.is_array(name) else self.col(name)
        return dutch_tokens(standard(text), role.gap)

    def ordered(self, name: str) -> bool:
        """Whether the field's terms stand one a place without gaps, so that an array of them tells their places."""
        role = self.role(name)
        return role.kind != "text" or role.analyzer != "dutch" and not (role.gap and self.is_array(name))

    def length(self, name: str) -> Column:
        """Number of terms of a field; of plain text counted without making them."""
        role = self.role(name)
        if name in self.ready or role.kind != "text" or role.analyzer != "standard" or self.is_array(name):
            return F.size(self.tokens(name))
        return F.coalesce(F.regexp_count(F.lower(self.col(name)), F.lit(TOKEN)), F.lit(0))

    def paths(self, dim: str) -> Column:
        """Facet paths of a dimension: an array of arrays of labels. A plain value is a path of one label."""
        column = self._column(dim)
        none = F.array().cast("array<array<string>>")
        if column not in self.df.columns:
            return none
        kind = self.df.schema[column].dataType
        c = F.col(column)
        if not isinstance(kind, T.ArrayType):
            return F.when(c.isNull() | (c.cast("string") == ""), none).otherwise(F.array(F.array(c.cast("string"))))
        if isinstance(kind.elementType, T.ArrayType):
            return F.coalesce(F.filter(c, lambda p: F.size(p) > 0), none)
        return F.coalesce(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.array(x.cast("string"))), none)

    def may_hold(self, name: str, words: list[str]) -> Column:
        """A cheap test that rows with all these words, or words that begin with them, pass: terms are parts of the folded text."""
        role = self.role(name)
        if name in self.ready or role.kind not in ("text", "set") or role.analyzer != "standard" or self.is_array(name):
            return F.lit(True)
        patterns = [p for p in map(word_pattern, dict.fromkeys(words)) if p]
        return reduce(and_, [self.col(name).rlike(p) for p in patterns], F.lit(True))

    def tokenised(self, names: list[str], df: DataFrame) -> tuple[Core, DataFrame]:
        """`df`, rows of this core, with the terms of text fields in columns of their own, and a core that knows them."""
        ready = {n: f"__tok{i}" for i, n in enumerate(dict.fromkeys(names)) if self.role(n).kind in ("text", "set") and n not in self.ready}
        for n, column in ready.items():
            df = df.withColumn(column, self.tokens(n))
        return Core(self.name, df, self.id, self.fields, self.order, self.similarity, self.ready | ready), df

    def indexed(self, names: list[str], path: str) -> Core:
        """This core with the terms of text fields written once to `path`, for many queries over the same rows."""
        _, df = self.tokenised(names, self.df)
        df.write.parquet(path)
        ready = {n: f"__tok{i}" for i, n in enumerate(dict.fromkeys(names)) if self.role(n).kind in ("text", "set") and n not in self.ready}
        return Core(self.name, self.df.sparkSession.read.schema(df.schema).parquet(path), self.id, self.fields, self.order, self.similarity, self.ready | ready)

    def with_df(self, df: DataFrame) -> Core:
        return Core(self.name, df, self.id, self.fields, self.order, self.similarity, self.ready)
