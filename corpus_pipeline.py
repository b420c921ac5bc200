"""Corpus pipeline: documents through toxicity, near duplicates, decontamination, source mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of `docs`; the stages' results are written as Parquet in
between. All stages but the last return the columns of `documents`; the last adds `shard`.

Defined cases, as the operators' own docstrings say: null, empty and word-less texts pass every filter; very long texts are judged
whole; of repeated rows of one id and text one stays; rows without an id are never near duplicates nor surplus and lie in the first
shard; extra columns, whatever their names, pass through all stages, but that `shard` is replaced by the last; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetry.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from facetry.llm._shared import purge, scratch, shared_dir, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id stays of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or edited, go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the source schedule uses stay: with tempered weights, part of the largest sources is surplus."""
    return mixing.keep_scheduled(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number of their shard."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity models can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage writes for itself and its predecessor's result are deleted once its own is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark, keep=True)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path=path)
        if before:
            purge(spark, before)
        before = path
    return docs
