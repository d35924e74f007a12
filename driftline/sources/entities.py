"""Entity files: JSON arrays on local or remote storage, and tables written by the sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline import model

EPOCH = "1970-01-01"
SHARED_STORAGE = ("hdfs", "viewfs", "s3a", "gs", "abfss", "wasbs")


def camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def read_date(col: Column) -> Column:
    """A date from an ISO date or timestamp, or from milliseconds since 1970."""
    as_days = F.floor(F.try_to_number(col, F.lit("S99999999999999")) / 86_400_000).cast("int")
    return F.when(col.rlike("^-?[0-9]+$"), F.date_add(F.lit(EPOCH).cast("date"), as_days)).otherwise(
        F.to_date(F.substring(col, 1, 10)))


def fill_defaults(table: DataFrame) -> DataFrame:
    """Unset booleans are false, unset numbers 0 and unset dates the epoch."""
    defaults = {T.BooleanType: F.lit(False), T.LongType: F.lit(0).cast("long"),
                T.IntegerType: F.lit(0), T.DateType: F.lit(EPOCH).cast("date")}
    return table.select(*[
        F.coalesce(F.col(f.name), defaults[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in defaults else F.col(f.name)
        for f in table.schema.fields
    ])


#: What separates two records of an array: the end of one, and the first key of the next. A quote that a
#: letter follows opens a string, so these characters never lie inside one.
NEXT_RECORD = '},{"class":"'


def _records(spark: SparkSession, path: str, stored: T.StructType, splittable: bool) -> DataFrame:
    """The objects of JSON arrays, as a column ``r``.

    A splittable array is cut in front of every record by the line reader, so that one file gives as
    many tasks as it has blocks. Pieces are made arrays again: one that no cut has reached holds
    several records, or the whole file. Every file must begin and end as an array, which a count of
    its pieces' brackets tells.
    """
    reader = spark.read.option("lineSep", NEXT_RECORD) if splittable else spark.read.option("wholetext", True)
    pieces = reader.text(path).select(
        F.trim("value", F.lit(" \t\r\n")).alias("piece"), F.col("_metadata.file_path").alias("file"))
    first, last = F.startswith("piece", F.lit("[")), F.endswith("piece", F.lit("]"))
    array = F.concat(
        F.when(first, F.lit("")).otherwise(F.lit("[" + NEXT_RECORD[2:])), "piece", F.when(last, F.lit("")).otherwise(F.lit("}]")))
    broken = pieces.groupBy("file").agg(F.count_if(first).alias("begins"), F.count_if(last).alias("ends")).where(
        "begins != 1 OR ends != 1").select(F.raise_error(F.concat(F.lit("expected a JSON array: "), "file")).cast("string").alias("array"))
    every = pieces.select(array.alias("array")).union(broken)
    return every.select(F.explode(F.from_json("array", T.ArrayType(stored), {"mode": "FAILFAST"})).alias("r"))


def read_entity_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON-array file of records in camelCase as a table with defaults filled in.

    Arrays of records that hold plain values, each beginning with its class, are read in as many
    tasks as the file has blocks; others are one task for each file. Nothing runs before an action;
    a file that isn't an array then fails the job.
    """
    dates = {f.name for f in schema.fields if isinstance(f.dataType, T.DateType)}
    stored = T.StructType([
        T.StructField(camel(f.name), T.StringType() if f.name in dates else f.dataType)
        for f in schema.fields
    ])
    flat = not any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) for f in schema.fields)
    raw = _records(spark, path, stored, flat).select("r.*")
    return fill_defaults(raw.select(*[
        (read_date(F.col(camel(f.name))) if f.name in dates else F.col(camel(f.name))).alias(f.name)
        for f in schema.fields
    ]))


@dataclass(frozen=True)
class AllowList:
    """Which remote addresses may be read: scheme, host (bucket) and path prefix must all match.

    Only storage that Spark's file reader can list will do. Web servers can't be listed, so https
    addresses are refused; put such files on shared storage first. An address without a host needs
    ``""`` among the hosts.
    """

    schemes: Sequence[str] = SHARED_STORAGE
    hosts: Sequence[str] = ("localhost",)
    path_prefixes: Sequence[str] = ("/data/",)

    def check(self, uri: str) -> str:
        parts = urlparse(uri)
        safe = (
            parts.scheme in self.schemes and parts.scheme not in ("http", "https")
            and (parts.hostname or "") in self.hosts and ".." not in parts.path.split("/")
            and any(parts.path.startswith(prefix) for prefix in self.path_prefixes)
        )
        if not safe:
            raise ValueError(f"unsafe address: {uri}")
        return uri


def read_entity_remote(
    spark: SparkSession, uri: str, schema: T.StructType, allowed: AllowList = AllowList()
) -> DataFrame:
    """The same file on shared storage, once its address is checked."""
    return read_entity_json(spark, allowed.check(uri), schema)


LOCAL, REMOTE = "LOCAL", "HTTP"  # the stored names of the modes


def source_by_mode(
    spark: SparkSession, mode: str, base: str, entity: str, schema: T.StructType,
    allowed: AllowList = AllowList(),
) -> DataFrame:
    """The file ``<base>/<entity>.json``, read locally or remotely."""
    path = f"{base.rstrip('/')}/{entity}.json"
    if mode == LOCAL:
        return read_entity_json(spark, path, schema)
    if mode == REMOTE:
        return read_entity_remote(spark, path, schema, allowed)
    raise ValueError(f"unknown data source: {mode}")


def read_version_history(spark: SparkSession, path: str) -> DataFrame:
    """``{browser: {version prefix: date}}`` as rows in lookup order."""
    from driftline.sources.catalog import version_rows

    kind = "map<string, map<string, string>>"
    text = spark.read.text(path, wholetext=True)
    return version_rows(text.select(F.from_json("value", kind).alias("history")))


def load_compat_columns(spark: SparkSession, path: str) -> DataFrame:
    """The column model of a wide table, from local or shared storage."""
    scheme = urlparse(path).scheme
    if scheme not in ("", "file", *SHARED_STORAGE):
        raise ValueError(f"cannot load a column model from {scheme}")
    return spark.read.schema(model.COMPAT_COLUMNS).parquet(path)
