"""Secret scans: incremental blob ledger.

Every version of every file is known by the SHA-256 of its content. The ledger, a table of the shared folder, records which
(blob, rule, rule version) were scanned and what was found. A scan hashes the versions, picks one holder of each blob
with a pair that the ledger lacks, and scans only those texts for only those rules; in the pass that hashes, rules' anchors (words that any
match must hold) mark the texts that need to travel to their pairs, all others having no findings; then it appends to the ledger and
joins the findings of all current rules back to all paths that hold the blob, whenever it was scanned. Copies are
scanned once, unchanged content never again, and a rule whose version changes is run anew over everything.

Rules are Java regular expressions and stay in the JVM. A finding is the position (in characters, from 0) and the SHA-256 of the
secret, never the secret.

Defined cases: a null or empty text is a blob without findings; null and '' are the same blob. A null path or id is kept and gets findings
like any other. Repeated rows are one path and version; of the paths of one blob the least is read. Very long
texts are scanned whole. Extra columns are ignored, whatever their names. A rule that no longer exists has no findings; an empty table or no rules give none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm._shared import measured, require, shared_dir, written


@dataclass(frozen=True)
class Rule:
    """Every match of `pattern` must hold one of the `anchors`, whatever the case; without anchors any text may match."""

    name: str
    version: int
    pattern: str
    anchors: tuple[str, ...] = ()


RULES = [
    Rule("aws_access_key", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"gh[pousr]_[0-9A-Za-z]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, r"xox[abprs]-[0-9A-Za-z-]{10,72}", ("xoxa-", "xoxb-", "xoxr-", "xoxs-", "xoxp-")),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("stripe_key", 1, r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,64}", ("k_live_", "k_test_")),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----", ("-----BEGIN ",)),
    Rule("jwt", 1, r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", ("eyJ",)),
    Rule("assigned_secret", 1, r"(?i:password|passwd|secret|api_key|apikey|token)[ ]?[=:][ ]?[\"']?[0-9A-Za-z_/+.-]{8,128}", ("password", "passwd", "secret", "api_key", "apikey", "token")),
]
_FINDINGS = "array<struct<rule:string,version:int,at:int,secret_hash:string>>"


class Ledger:
    """The scanned pairs and their findings: a folder to which each scan appends one part."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark)

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def scanned(self) -> DataFrame:
        """(blob, rules): names and versions that the blob was scanned for, in one row a scan."""
        return self._table("scanned", "blob string, rules array<string>")

    def findings(self) -> DataFrame:
        return self._table("findings", "blob string, rule string, version int, at int, secret_hash string")


def blob_of(text) -> F.Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def anchored(text: F.Column, rules: list[Rule]) -> F.Column:
    """Whether any rule may match; exact in that texts where it is false hold no secret."""
    if not all(r.anchors for r in rules):
        return F.lit(True)
    low = F.lower(text)
    return reduce(or_, [low.contains(a) for a in sorted({a.lower() for r in rules for a in r.anchors})], F.lit(False))


def _positions(text: F.Column, rule: Rule) -> F.Column:
    """All matches of the rule: the text is read once; positions follow from the lengths between matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FINDINGS).alias("out"))

    def step(state, i):
        at = state["at"] + F.length(F.get(between, i))
        secret = F.get(found, i)
        entry = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), at.alias("at"), F.sha2(secret, 256).alias("secret_hash"))
        return F.struct((at + F.length(secret)).alias("at"), F.concat(state["out"], F.array(entry)).alias("out"))

    places = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["out"])
    return F.when(text.rlike(rule.pattern), places).otherwise(F.array().cast(_FINDINGS))


def scan(files: DataFrame, ledger: Ledger, rules: list[Rule] | None = None, *, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(path columns, blob, rule, version, at, secret_hash): the findings of all current rules in all given versions. Unseen pairs are scanned first."""
    rules = RULES if rules is None else rules
    require(files, *path_cols, text_col)
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need different names")
    inner = [f"__path{k}" for k in range(len(path_cols))]
    source = files.select(*(F.col(c).alias(i) for c, i in zip(path_cols, inner, strict=True)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    versions = written(source.select(*inner, blob_of(F.col("__text")).alias("blob"), anchored(F.col("__text"), rules).alias("anchored")).distinct())
    current = [f"{r.name}:{r.version}" for r in rules]
    done = ledger.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    blobs = versions.groupBy("blob").agg(F.min(F.struct(*inner)).alias("holder"), F.max("anchored").alias("anchored"))
    lacks = F.array_except(F.array(*map(F.lit, current)).cast("array<string>"), F.coalesce(F.col("done"), F.array().cast("array<string>")))
    unseen = written(blobs.join(done, "blob", "left").select("blob", "holder", "anchored", lacks.alias("todo")).where(F.size("todo") > 0))
    if unseen.limit(1).count():
        # One row holds each unseen blob's text; a null path is a path too, hence <=>.
        keys = unseen.where("anchored").select(F.col("blob").alias("__blob"), *(F.col(f"holder.{i}").alias(f"__h{k}") for k, i in enumerate(inner)), "todo")
        size = F.lit(120) + 24 * F.size("todo") + reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"__h{k}").cast("string")), F.lit(0)) for k in range(len(inner))], F.lit(0))
        match = [F.col(i).eqNullSafe(F.col(f"__h{k}")) for k, i in enumerate(inner)]
        held = source.where(anchored(F.col("__text"), rules)).join(measured(keys, size), match).where(blob_of(F.col("__text")) == F.col("__blob"))
        found = F.flatten(F.array(*(F.when(F.array_contains("todo", name), _positions(F.col("__text"), rule)).otherwise(F.array().cast(_FINDINGS)) for rule, name in zip(rules, current, strict=True))))
        fresh = held.select(F.col("__blob").alias("blob"), found.alias("found")).where(F.size("found") > 0)
        rows = fresh.select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.version", "f.at", "f.secret_hash").distinct()
        # Findings first: if a scan dies in between, its pairs count as unseen and are scanned again.
        rows.write.mode("append").parquet(f"{ledger.path}/findings")
        unseen.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger.path}/scanned")
    wanted = F.concat_ws(":", "rule", F.col("version").cast("string")).isin(current) if current else F.lit(False)
    known = ledger.findings().where(wanted).distinct()
    out = versions.drop("anchored").join(known, "blob")
    return out.select(*(F.col(i).alias(c) for c, i in zip(path_cols, inner, strict=True)), "blob", "rule", "version", "at", "secret_hash")


def _oracle() -> str:
    """DuckDB SQL of a scan of `documents` with an empty ledger: a finding's position follows from the text before the match."""
    parts = []
    for r in RULES:
        p = r.pattern.replace("'", "''")
        parts.append(f"select doc_id, blob, '{r.name}' as rule, {r.version} as version, regexp_extract_all(text, '{p}') as found, regexp_split_to_array(text, '{p}') as between_, t.i as i from blobs, lateral (select unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) as i) t where regexp_matches(text, '{p}')")
    return f"""
with blobs as (select distinct doc_id, coalesce(text, '') as text, sha256(coalesce(text, '')) as blob from documents),
hits as ({' union all '.join(parts)})
select distinct doc_id, blob, rule, version,
       cast(length(array_to_string(between_[1:i], '')) + coalesce(length(array_to_string(found[1:i - 1], '')), 0) as integer) as at,
       sha256(found[i]) as secret_hash
from hits
"""


ORACLE_SQL = _oracle()
