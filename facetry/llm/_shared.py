"""What the operators need from the cluster: a place shared by all executors, checks of sizes, and workers that stay small."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.session import shared_folder, ship

#: A side of a join is broadcast only if it is known to need no more than this on each executor.
BROADCAST_BYTES = 32 << 20

_open: list[list[str]] = []


def shared_dir(spark: SparkSession, keep: bool = False) -> str:
    """A new folder in the place that `spark.checkpoint.dir` names. An open `scratch` deletes it unless it is to be kept."""
    path = shared_folder(spark)
    if _open and not keep:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders that were made inside; what is read from them has to be written, with `keep`, before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            purge(spark, path)


def written(df: DataFrame, keep: bool = False, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = path or shared_dir(spark, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession, path: str) -> None:
    """Delete a folder that `shared_dir` gave."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if `rows` rows of `row_bytes` fit; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def measured(df: DataFrame, row_bytes: F.Column) -> DataFrame:
    """`df` with a broadcast hint if the sum of `row_bytes` over its rows fits, for rows of no fixed size."""
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    return sized(df, 1, int(total))


def own_name(df: DataFrame, name: str) -> str:
    """`name`, or one like it that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require(df: DataFrame, *columns: str) -> None:
    """Check the columns of an operator's input, see that its code reaches the executors, and bound Arrow batches where the session hasn't."""
    spark = df.sparkSession
    ship(spark)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_arrow(df: DataFrame, run: Run, schema) -> DataFrame:
    """`df.mapInArrow`, after which the worker, which Spark keeps for other tasks, gives its free memory back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
