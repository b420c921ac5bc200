"""Makes the package importable on every executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Python workers get batches of at most so many rows and bytes; with long texts this bounds a worker's memory.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that `spark.checkpoint.dir` names, which all executors must share. Where the session names none, a local session gets one; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches where the session hasn't."""
    for name, default, value in (("maxRecordsPerBatch", 10_000, ARROW_ROWS), ("maxBytesPerBatch", None, ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or now == str(default) or default is None and not now.isdigit():
            spark.conf.set(key, str(value))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a Spark context: Spark itself copies the archive to each of them. Their batches are bounded too."""
    small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_facetry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="facetry-code-")
    archive = os.path.join(folder, "facetry_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    context._facetry_shipped = True
