"""Set operations on streams against tables, and a keyed copy kept current by a stream.

The filters hold no state: every incoming row is decided by the table alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.sets import diff_only, intersect, set_minus, upsert


def file_stream(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str, files_per_batch: int = 64
) -> DataFrame:
    """Parquet files matching a name pattern, as a stream of batches of so many files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_minus(stream: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not in the table."""
    return set_minus(stream, table, keys)


def stream_intersect(stream: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is in the table."""
    return intersect(stream, table, keys)


def stream_union(
    primary: DataFrame, secondary: DataFrame, primary_table: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """All of the primary stream, and what the secondary adds to the primary's table."""
    return primary.unionByName(stream_minus(secondary, primary_table, keys))


def stream_diff_only(stream: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows that are new or differ from the table's row with the same key."""
    return diff_only(stream, table, keys)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything that is there now and read what it wrote."""
    sink = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# A keyed copy is a log of batches, each reduced to one row per key. A batch costs what it
# holds, not what the table holds, and writing one again after a failure replaces it.

BATCH = "batch"


def start_copy(table: DataFrame, path: str, keys: Sequence[str], sequence: Sequence[str]) -> None:
    """The full copy that comes before the stream."""
    upsert(table, keys, sequence).write.mode("overwrite").parquet(f"{path}/{BATCH}=-1")


def stream_upsert(
    stream: DataFrame, path: str, keys: Sequence[str], sequence: Sequence[str], checkpoint: str,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Keep a copy current by key: every batch adds its last write per key to the log."""

    def write(rows: DataFrame, number: int) -> None:
        upsert(rows, keys, sequence).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_copy(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """The current row per key: the last write over all batches."""
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    log = spark.read.schema(stored).parquet(path)
    return upsert(log, keys, [*sequence, BATCH]).drop(BATCH)


def compact_copy(
    spark: SparkSession, path: str, target: str, schema: T.StructType, keys: Sequence[str],
    sequence: Sequence[str],
) -> None:
    """Write the current rows to a new log as its first batch."""
    start_copy(read_copy(spark, path, schema, keys, sequence), target, keys, sequence)
