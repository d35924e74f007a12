"""Writers for the tables and the CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.compat import compat_columns, pivot_compat
from driftline.operators.signature import RELEASE_ORDER, ReleaseIndex, ships


def write_entities(releases: DataFrame, apis: DataFrame, junction: DataFrame, folder: str) -> None:
    """Releases by date, APIs and support facts by key; files are range-sorted."""
    releases.orderBy(*RELEASE_ORDER).write.mode("overwrite").parquet(f"{folder}/releases")
    apis.orderBy("interface_key").write.mode("overwrite").parquet(f"{folder}/apis")
    ordered = junction.orderBy("release_key", "interface_key")
    ordered.write.mode("overwrite").parquet(f"{folder}/junction")


def write_compat(signatures: DataFrame, index: ReleaseIndex, folder: str) -> None:
    """The wide table and its column model."""
    pivot_compat(signatures, index).write.mode("overwrite").parquet(f"{folder}/compat")
    compat_columns(index).orderBy("pos").write.mode("overwrite").parquet(f"{folder}/compat_columns")


def write_grid(grid: DataFrame, columns: DataFrame, folder: str) -> None:
    """The two tables that ``compat.grid_of`` gives."""
    grid.orderBy("id").write.mode("overwrite").parquet(f"{folder}/grid")
    columns.orderBy("pos").write.mode("overwrite").parquet(f"{folder}/grid_cols")


def write_metrics(metrics: DataFrame | None, counts: DataFrame | None, folder: str) -> None:
    """Metrics partitioned by type so that one type reads only its own files; either table may be missing."""
    if metrics is not None:
        ordered = metrics.orderBy("type", "browser_name", "date")
        ordered.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/browser_metrics")
    if counts is not None:
        counts.orderBy("browser_name", "release_date").write.mode("overwrite").parquet(f"{folder}/api_counts")


def export_rows(signatures: DataFrame, index: ReleaseIndex, selected: Sequence[str]) -> DataFrame:
    """``api`` and one TRUE/FALSE column per selected release, headed by its label."""
    cells = [
        F.when(ships(index, index.position[key]), "TRUE").otherwise("FALSE").alias(
            index.rows[index.position[key]].label
        )
        for key in selected
    ]
    return signatures.select(F.col("interface_key").alias("api"), *cells)


def export_name(index: ReleaseIndex, selected: Sequence[str], query: str = "") -> str:
    """A file name that depends on the columns and the query only."""
    import zlib

    labels = [index.rows[index.position[key]].label for key in selected]
    return f"export_{zlib.crc32('|'.join([*labels, query]).encode()):x}.csv"


def export_csv(
    signatures: DataFrame, index: ReleaseIndex, selected: Sequence[str], path: str, query: str = ""
) -> None:
    """Write the export: fully quoted, with a header that also carries the query if any."""
    rows = export_rows(signatures, index, selected)
    if query:
        rows = rows.withColumn("", F.lit(None).cast("string"))
        rows = rows.withColumn("Query:", F.lit(None).cast("string"))
        rows = rows.withColumn(query, F.lit(None).cast("string"))
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def read_csv_export(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in ("api", *labels)])
    return spark.read.schema(schema).option("header", True).csv(path)
