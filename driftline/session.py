"""Session helpers and lineage cutting through shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Result = TypeVar("Result")


def local_session(cpus: int | str = 8, app: str = "driftline") -> SparkSession:
    """Session used by the tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local session, which has no other machine to share with, may fall back
    to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path for this application; one folder per application eases cleaning up."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/driftline/{application}/{label}-{uuid.uuid4().hex}"


def together(*steps: Callable[[], Result]) -> list[Result]:
    """Run independent Spark jobs side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [running.result() for running in [pool.submit(step) for step in steps]]


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    A parquet table keeps column pruning, pushdown and true sizes for the join
    planner, and survives the loss of any executor.
    """
    return cut_and_count(df, label)[0]


def cut_and_count(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Like ``cut_lineage``, with the number of rows, counted while they are written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


#: Tables of more bytes in memory are not broadcast, however small their files are.
BROADCAST_BYTES = 10 << 20


def bytes_of(df: DataFrame) -> Column:
    """About the bytes that a row takes in memory: a word for each column, and its text."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8 * len(df.columns))).cast("long")


def too_big_to_send(df: DataFrame, size: int | None) -> DataFrame:
    """Keep the planner from broadcasting a table of that size in memory.

    It goes by the files, and columns that repeat long values, as graph ids do, take a hundredth of
    their size there.
    """
    return df.hint("merge") if (size or 0) > BROADCAST_BYTES else df


def cut_sized(df: DataFrame, label: str) -> DataFrame:
    """Like ``cut_lineage``, for tables with graph ids."""
    return cut_sized_and_count(df, label)[0]


def cut_sized_and_count(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Like ``cut_and_count``, for tables with graph ids.

    Files that are large enough speak for themselves, and leave the choice to what joins turn out to read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(bytes_of(df)).alias("bytes")).write.parquet(path)
    table, size = spark.read.schema(df.schema).parquet(path), seen.get["bytes"] or 0
    if size > BROADCAST_BYTES:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        if files.agg(F.sum("length")).first()[0] < BROADCAST_BYTES:
            table = too_big_to_send(table, size)
    return table, seen.get["rows"]
