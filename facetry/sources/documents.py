"""Documents in and out: typed JSON documents, field names with roles, versions, numbered terms and keyed values.

Tables are Parquet folders. A new version of a table is written beside the old one and published by a small pointer file, so readers
see either all of a change or none of it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.operators.core import Core, Field
from facetry.session import shared_folder

#: Values of one field of a JSON document.
FIELD = "array<struct<type:string,name:string,value:string,path:array<string>,sort:boolean,stored:boolean,termVectors:boolean>>"
_KIND = {"TextField": "text", "StringField": "string", "NoTermsFrequencyField": "set", "IntField": "int", "IntPoint": "int", "LongField": "long", "LongPoint": "long", "DoubleField": "double", "DoublePoint": "double", "NumericField": "numeric", "KeyField": "key", "FacetField": "facet", "LatLonField": "geo"}
_TYPE = {"text": "string", "string": "string", "set": "string", "int": "int", "long": "long", "double": "double", "numeric": "long", "key": "long"}


@dataclass
class FieldRegistry:
    """Kind of a field by its name: predicates first, then exact names, then prefixes, then the default."""

    names: dict[str, Field] = field(default_factory=dict)
    predicates: list[tuple[Callable[[str], bool], Field]] = field(default_factory=list)
    default: Field = Field("text")
    drilldowns: dict[str, Field] = field(default_factory=dict)
    prefixes: tuple[tuple[str, str], ...] = (("sorted.", "string"), ("untokenized.", "string"), ("__key__.", "key"), ("__numeric__.", "numeric"), ("range.double.", "double"), ("range.int.", "int"))

    def of(self, name: str) -> Field:
        for test, found in self.predicates:
            if test(name):
                return found
        if name in self.drilldowns:
            return self.drilldowns[name]
        if name in self.names:
            return self.names[name]
        for prefix, kind in self.prefixes:
            if name.startswith(prefix):
                return Field(kind, name)
        return Field(self.default.kind, name, self.default.analyzer)

    def schema(self, names: list[str]) -> T.StructType:
        def column(name: str) -> T.DataType:
            kind = self.of(name).kind
            if kind == "facet":
                return T.ArrayType(T.ArrayType(T.StringType()))
            if kind == "geo":
                return T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
            one = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "numeric": T.LongType(), "key": T.LongType()}.get(kind, T.StringType())
            return one if name.startswith(("sorted.", "__key__.", "__numeric__.")) else T.ArrayType(one)

        return T.StructType([T.StructField(n, column(n)) for n in names])


def _named(name: str):
    return lambda x: x["name"] == name


def _value_as(kind: T.DataType):
    return lambda x: x["value"].cast(kind)


def decoded(raw: DataFrame, registry: FieldRegistry, names: list[str], json_col: str = "json") -> DataFrame:
    """The other columns of `raw` and a column for each named field. A name that sorts or is a key holds its first value, others all of theirs."""
    fields = F.from_json(json_col, FIELD)
    out = raw.withColumn("__fields", fields)
    for s in registry.schema(names):
        own = F.filter("__fields", _named(s.name))
        if isinstance(s.dataType, T.StructType):
            numbers = F.from_json(F.get(own, F.lit(0))["value"], "array<double>")
            value = F.when(F.size(own) > 0, F.struct(numbers[0].alias("lat"), numbers[1].alias("lon")))
        elif isinstance(s.dataType, T.ArrayType) and isinstance(s.dataType.elementType, T.ArrayType):
            value = F.transform(own, lambda x: x["path"])
        elif isinstance(s.dataType, T.ArrayType):
            value = F.transform(own, _value_as(s.dataType.elementType))
        else:
            value = F.get(own, F.lit(0))["value"].cast(s.dataType)
        out = out.withColumn(s.name, value)
    return out.drop("__fields", json_col)


def gathered(values: DataFrame, max_label: int = 256, *, rewrite_id: Callable[[Column], Column] | None = None, rewrite_fields: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, fields): rows (id, name, value, facet) of one transaction gathered by id; an id without rows has no document.

    Facet labels (rows with `facet`) are cut to `max_label` characters. `rewrite_id` maps the id, `rewrite_fields` the array of (name, value, facet).
    """
    value = F.when(F.col("facet"), F.substring("value", 1, max_label)).otherwise(F.col("value"))
    identity = rewrite_id(F.col("id")) if rewrite_id else F.col("id")
    out = values.groupBy(identity.alias("id")).agg(F.sort_array(F.collect_list(F.struct("name", value.alias("value"), "facet"))).alias("fields"))
    return out.withColumn("fields", rewrite_fields(F.col("fields"))) if rewrite_fields else out


def listed(records: DataFrame, factory: Callable[[Column], Column] | None = None, max_label: int = 256) -> DataFrame:
    """(id, name, value, facet): rows of documents (id, fields), an array of (name, value). `factory` maps one (name, value) to an array of (name, value, facet), of any number; facet labels are cut."""
    made = factory or (lambda f: F.array(F.struct(f["name"].alias("name"), f["value"].alias("value"), F.lit(False).alias("facet"))))
    rows = records.select("id", F.explode(F.flatten(F.transform("fields", made))).alias("f"))
    return rows.select("id", "f.name", F.when(F.col("f.facet"), F.substring("f.value", 1, max_label)).otherwise(F.col("f.value")).alias("value"), "f.facet")


def prefixed(tag: str, value: Column, prefixes: list[str], last: int, facets: bool = False) -> Column:
    """Array of (name, value, facet): the value under the names of the first `last` + 1 prefixes; it is a facet under the last one, if that isn't empty."""
    return F.array(*(F.struct(F.lit(f"{p}{tag}").alias("name"), value.alias("value"), F.lit(facets and j == last and bool(p)).alias("facet")) for j, p in enumerate(prefixes[: last + 1])))


def facet_terms(dim: str, paths: Column, *, hierarchical: bool = True, require_count: bool = True, drilldown: str = "all") -> Column:
    """Array of the terms that a dimension's paths are found by, as paths that begin with the dimension.

    `drilldown`: 'all' beginnings of a path, 'all_but_dim', 'full' paths only, 'dim_and_full' or 'none'. `require_count` adds the dimension alone.
    """
    if drilldown not in ("all", "all_but_dim", "full", "dim_and_full", "none"):
        raise ValueError(f"unknown drilldown terms: {drilldown}")
    start = F.array(F.lit(dim))
    begins = F.flatten(F.transform(paths, lambda p: F.transform(F.sequence(F.lit(1), F.size(p) if hierarchical else F.lit(1)), lambda n: F.concat(start, F.slice(p, 1, n)))))
    full = F.transform(paths, lambda p: F.concat(start, p))
    some = {"all": begins, "all_but_dim": begins, "full": full, "dim_and_full": full, "none": F.array().cast("array<array<string>>")}[drilldown]
    root = F.array(start) if require_count or drilldown in ("all", "dim_and_full") else F.array().cast("array<array<string>>")
    return F.when(F.size(paths) > 0, F.array_distinct(F.concat(root, some))).otherwise(F.array().cast("array<array<string>>"))


def upserted(table: DataFrame, changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """The last version of each id, by `seq_col`; of equal ones a change counts more than the table's row, then the one that is last in JSON.

    Rows without an id are appended. A change with a true `deleted` removes the id.
    """
    old = table if "deleted" in table.columns else table.withColumn("deleted", F.lit(False))
    new = changes if "deleted" in changes.columns else changes.withColumn("deleted", F.lit(False))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    named = both.where(F.col(id_col).isNotNull())
    order = [F.desc(seq_col), F.desc("__new"), F.desc(F.to_json(F.struct(*sorted(c for c in both.columns if c != "__new"))))]
    last = named.withColumn("__rn", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where("__rn = 1 and not coalesce(deleted, false)").drop("__rn")
    return last.unionByName(both.where(F.col(id_col).isNull())).drop("deleted", "__new")


def deleted_by_query(core: Core, node) -> Core:
    from facetry.plans.compile import predicate

    return core.with_df(core.df.where(~predicate(core, node)))


def numerated(terms: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(term, number): the dictionary with new terms added, numbered on from its largest number in term order; numbers begin at 1.

    Terms are cut into ranges, which are as even however the terms begin, and counted there; only the ranges' counts are summed in one place. Empty and null terms raise an error.
    """
    spark = terms.sparkSession
    if terms.where("term is null or term = ''").limit(1).count():
        raise ValueError("a term is empty")
    known = dictionary if dictionary is not None else spark.createDataFrame([], "term string, number long")
    base = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("base"))
    new = terms.select("term").distinct().join(known, "term", "left_anti")
    path = shared_folder(spark)
    new.repartitionByRange("term").sortWithinPartitions("term").select("term", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33) + 1).alias("place")).write.parquet(path)
    placed = spark.read.schema("term string, part int, place long").parquet(path)
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    added = placed.join(before, "part").crossJoin(F.broadcast(base)).select("term", (F.col("base") + F.col("before") + F.col("place")).cast("long").alias("number"))
    return known.unionByName(added)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class Table:
    """A table of published versions at `path`. The last version and the one before, which readers may still use, are kept."""

    spark: SparkSession
    path: str

    def _pointer(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[dict[str, str]]:
        """Of the last versions, newest first: the folder of each bucket."""
        at, fs = self._pointer()
        return [json.loads(r.value) for r in self.spark.read.text(at.toString(), wholetext=False).collect()] if fs.exists(at) else []

    def _point(self, manifest: dict[str, str]) -> None:
        before = self._manifests()
        at, fs = self._pointer()
        out = fs.create(at, True)
        out.write(bytearray("\n".join(json.dumps(m) for m in [manifest, *before[:1]]).encode()))
        out.close()
        used = {path for m in [manifest, *before[:1]] for path in m.values()}
        for path in {path for m in before[1:] for path in m.values()} - used:
            _delete(self.spark, path)

    def read(self) -> DataFrame | None:
        """The version that is published now; None before the first."""
        found = self._manifests()
        return self.spark.read.parquet(*found[0].values()) if found else None

    def publish(self, df: DataFrame) -> None:
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        df.write.parquet(version)
        self._point({"all": version})

    def upsert(self, changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> None:
        old = self.read()
        self.publish(upserted(old if old is not None else changes.limit(0), changes, id_col, seq_col))


@dataclass
class BucketedTable(Table):
    """A table in `buckets` by the hash of the id: an upsert rewrites only buckets that the changes touch. Rows without an id are appended."""

    buckets: int = 64

    def upsert(self, changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> None:
        found = self._manifests()
        manifest = dict(found[0]) if found else {}
        bucket = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col(id_col)), F.lit(self.buckets))).cast("int")
        touched = sorted(r[0] for r in changes.select(bucket).distinct().collect())
        if not touched and found:
            return
        old = [manifest[str(b)] for b in touched if str(b) in manifest]
        table = self.spark.read.parquet(*old) if old else changes.limit(0)
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        result = upserted(table, changes, id_col, seq_col)
        result.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(version)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(version)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in touched:
            part = f"{version}/__bucket={b}"
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(part)):
                manifest[str(b)] = part
            else:
                manifest.pop(str(b), None)
        if not manifest:  # a table without rows still has its columns
            manifest["empty"] = f"{version}-empty"
            result.limit(0).write.parquet(manifest["empty"])
        elif len(manifest) > 1:
            manifest.pop("empty", None)
        self._point(manifest)


class KeyValues:
    """A persistent mapping of strings; changes are seen at once by its own reads and kept by `commit`."""

    def __init__(self, spark: SparkSession, path: str):
        self.table, self.spark, self.pending = Table(spark, path), spark, {}

    def __setitem__(self, key: str, value: str) -> None:
        self.pending[key] = value

    def __delitem__(self, key: str) -> None:
        self.pending[key] = None

    def get(self, key: str, default: str | None = None) -> str | None:
        if key in self.pending:
            return default if self.pending[key] is None else self.pending[key]
        table = self.table.read()
        row = table.where(F.col("id") == key).first() if table is not None else None
        return row["value"] if row else default

    def __getitem__(self, key: str) -> str:
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def commit(self) -> None:
        if not self.pending:
            return
        old = self.table.read()
        seq = (old.agg(F.max("seq")).first()[0] or 0) + 1 if old is not None else 1
        rows = [(k, v, seq, v is None) for k, v in self.pending.items()]
        self.table.upsert(self.spark.createDataFrame(rows, "id string, value string, seq long, deleted boolean"))
        self.pending = {}


def settings_from_json(text: str) -> dict:
    """Similarity, analyser, drilldown fields, commit policy and clustering of a core from their JSON form."""
    data = json.loads(text)
    from facetry.operators.cluster import Strategy
    from facetry.operators.core import Similarity

    similarity = data.get("similarity", {})
    kind = "tf" if similarity.get("type") == "TermFrequencySimilarity" else "bm25"
    analyzer = data.get("analyzer", {})
    ways = data.get("clustering", {}).get("strategies", [])
    return {
        "similarity": Similarity(kind, similarity.get("k1", 1.2), similarity.get("b", 0.75)),
        "analyzer": "dutch" if "Stemming" in analyzer.get("type", "") and set(analyzer.get("stemmingFields", [])) else "standard",
        "stemmed": set(analyzer.get("stemmingFields", [])),
        "fields": {f["dim"]: Field("facet", f["dim"], hierarchical=f.get("hierarchical", False)) for f in data.get("drilldownFields", [])},
        "commit_count": data.get("commitCount", 100_000),
        "commit_timeout": data.get("commitTimeout", 10),
        "clustering": [Strategy({f["fieldname"]: f["weight"] for f in w["fields"]}, w.get("clusteringEps", 0.4), w.get("clusteringMinPoints", 1), {f["fieldname"]: f["filterValue"] for f in w["fields"] if f.get("filterValue")}) for w in ways],
    }


class NotInitialised(LookupError):
    """A core without settings."""


class Settings:
    """The settings of cores, kept by name as JSON. A core takes documents and queries once it has some."""

    def __init__(self, spark: SparkSession, path: str):
        self.values = KeyValues(spark, path)

    def update(self, core: str, text: str) -> dict:
        """Sets what the JSON names, keeps the rest, and returns all."""
        merged = json.loads(self.values.get(core, "{}")) | json.loads(text)
        settings = settings_from_json(json.dumps(merged))
        self.values[core] = json.dumps(merged, sort_keys=True)
        self.values.commit()
        return settings

    def get(self, core: str) -> dict:
        found = self.values.get(core)
        if found is None:
            raise NotInitialised(f"{core} has no settings")
        return settings_from_json(found)


class Writer:
    """Collects changes of a table and publishes them together: after `commit_count` rows, `commit_timeout` seconds, or by `commit`. Readers see the table as it was until then."""

    def __init__(self, table: Table, commit_count: int = 100_000, commit_timeout: float = 10.0, *, id_col: str = "id", seq_col: str = "seq", clock: Callable[[], float] = time.monotonic):
        self.table, self.commit_count, self.commit_timeout, self.keys, self.clock = table, commit_count, commit_timeout, (id_col, seq_col), clock
        self.pending: list[DataFrame] = []
        self.rows, self.since = 0, None

    def add(self, changes: DataFrame) -> bool:
        """Whether this made a commit. The changes have to stay readable until then."""
        self.since = self.clock() if self.since is None else self.since
        self.pending.append(changes)
        self.rows += changes.count()
        if self.rows >= self.commit_count or self.clock() - self.since >= self.commit_timeout:
            self.commit()
            return True
        return False

    def commit(self) -> None:
        if self.pending:
            self.table.upsert(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.pending), *self.keys)
        self.pending, self.rows, self.since = [], 0, None


def commit_all(writers: dict[str, Writer], numerator: KeyValues | None = None) -> None:
    """The dictionary of numbers first, so that no document refers to a number that is lost, then every core."""
    if numerator is not None:
        numerator.commit()
    for name in sorted(writers):
        writers[name].commit()
