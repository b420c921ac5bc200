"""Term enumeration, spelling and similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.stemming import damerau_distance
from facetry.operators.core import Core
from facetry.session import shared_folder


def term_counts(core: Core, field: str) -> DataFrame:
    """(term, count): in how many rows each term of the field is."""
    return core.df.select(F.explode(F.array_distinct(core.tokens(field))).alias("term")).groupBy("term").agg(F.count("*").alias("count"))


def prefix_search(core: Core, field: str, prefix: str, limit: int = 10) -> DataFrame:
    """The first `limit` terms with the prefix in term order, then ordered by count."""
    first = term_counts(core, field).where(F.col("term").startswith(prefix)).orderBy("term").limit(limit)
    return first.orderBy(F.desc("count"), "term")


def field_names(core: Core) -> list[str]:
    return sorted({*core.df.columns, *core.fields})


def drilldown_values(core: Core, dim: str, path: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """Labels below a path."""
    n = len(path)
    labels = core.df.select(F.explode(core.paths(dim)).alias("p")).where(F.size("p") > n)
    if n:
        labels = labels.where(F.slice("p", 1, n) == F.array(*map(F.lit, path)))
    return labels.select(F.col("p")[n].alias("label")).distinct().orderBy("label").limit(limit)


def core_info(cores: dict[str, Core]) -> DataFrame:
    """(core, docs) of all cores."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [c.df.agg(F.count("*").alias("docs")).select(F.lit(name).alias("core"), "docs") for name, c in sorted(cores.items())])


def spelling(core: Core, field: str, words: list[str], count: int = 5, accuracy: float = 0.5, mode: str = "not_in_index", max_edits: int = 2) -> DataFrame:
    """(word, suggestion, similarity, count): terms within two edits (a swap is one) that begin alike, best first.

    Modes: 'not_in_index' suggests only for unknown words, 'more_popular' only terms of more rows, 'always' any.
    """
    if mode not in ("not_in_index", "more_popular", "always"):
        raise ValueError(f"unknown mode: {mode}")
    spark = core.df.sparkSession
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    terms = term_counts(core, field)
    own = asked.join(terms, F.col("word") == F.col("term"), "left").select("word", F.coalesce("count", F.lit(0)).alias("own"))
    if mode == "not_in_index":
        own = own.where("own = 0")
    # A swap is two plain edits: the plain distance prunes, in the JVM, before the exact one.
    first = F.substring("term", 1, 1) == F.substring("word", 1, 1)
    near = terms.join(F.broadcast(own), first & (F.col("term") != F.col("word")) & (F.levenshtein("term", "word", 2 * max_edits) >= 0))
    scored = near.withColumn("edits", damerau_distance("term", "word")).where(F.col("edits") <= max_edits)
    similarity = 1 - F.col("edits") / F.least(F.char_length("term"), F.char_length("word"))
    scored = scored.withColumn("similarity", similarity).where(F.col("similarity") >= accuracy)
    if mode == "more_popular":
        scored = scored.where("count > own")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), F.desc("count"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= count).select("word", F.col("term").alias("suggestion"), "similarity", "count", "rank")


def similar_documents(core: Core, field: str, doc_id, limit: int = 10, common_share: float = 0.1, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): rows that share a rare term with the given one, by BM25 over all its terms.

    Terms of more than ceil(common_share * rows) rows are common: they add to scores but don't make a match, unless the
    row has no rare term; then all its common terms are required.
    """
    own = core.df.where(F.col(core.id) == doc_id)
    wanted = own.select(F.explode(core.tokens(field)).alias("term")).distinct().select(F.col("term").alias("wanted"))
    tokens = core.df.select(F.col(core.id).alias("id"), core.tokens(field).alias("tok"))
    words = tokens.select("id", F.size("tok").alias("dl"), F.explode("tok").alias("term"))
    # Terms are made once: the counts of the wanted ones and, under null, of all others are kept for the statistics and the scores. One row's terms are few enough to broadcast.
    path = shared_folder(core.df.sparkSession)
    words.join(F.broadcast(wanted), F.col("term") == F.col("wanted"), "left").groupBy("id", "dl", F.col("wanted").alias("term")).agg(F.count("*").alias("tf")).write.parquet(path)
    counted = core.df.sparkSession.read.parquet(path)
    postings = counted.where("term is not null")
    lengths = counted.groupBy("id").agg(F.first("dl").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    scored = postings.join(df, "term").crossJoin(F.broadcast(stats))
    rare = F.col("df") <= F.ceil(F.col("n") * F.lit(common_share))
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    # Decimals add up to the same in any order: rows with the same terms, such as copies, tie and go by id.
    total = F.sum(weight.cast("decimal(28,18)")).cast("double")
    by = scored.groupBy("id").agg(total.alias("score"), F.max(rare.cast("int")).alias("rare"), F.count("*").alias("matched"))
    asked = df.crossJoin(F.broadcast(stats)).agg(F.max(rare.cast("int")).alias("any_rare"), F.count("*").alias("terms"))
    hits = by.crossJoin(F.broadcast(asked)).where(F.col("id") != doc_id).where((F.col("rare") == 1) | ((F.col("any_rare") == 0) & (F.col("matched") == F.col("terms"))))
    return hits.select("id", "score").orderBy(F.desc("score"), "id").limit(limit)
