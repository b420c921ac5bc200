"""Near-real-time ingest: a stream of changes that upserts a published table, batch by batch.

A trigger by time takes the place of a commit by timer and `maxFilesPerTrigger` that of a commit by count. The last sequence number of an id
wins, whatever batch it comes in: each batch is merged with the table by that number, so a batch that runs again changes
nothing. A deletion leaves no trace: an older version that comes in a later batch than the deletion is taken as new. A batch rewrites the
buckets that it touches of a `BucketedTable`, and all of a plain `Table`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from facetry.sources.documents import Table


def changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the JSON lines in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def upsert_stream(stream: DataFrame, table: Table, checkpoint: str, *, id_col: str = "id", seq_col: str = "seq", every: str | None = None) -> StreamingQuery:
    """Runs until stopped with `every` (as '10 seconds'); else takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: table.upsert(batch, id_col, seq_col)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
