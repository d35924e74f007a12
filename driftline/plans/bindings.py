"""The compat data set derived from the driver tables.

Shipments stand for support facts: return flag, ship year and line status make the
release, the part makes the API.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import interface_key, release_key


# Declared, so that no read has to look into the files first.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate {time}, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate {time}",
    "events": "event_id BIGINT, ts {time}, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name].format(time="TIMESTAMP_NTZ")).parquet(f"{folder}/{name}.parquet")


def _shipments(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Distinct ``flag, system, year`` of the shipments, with the given keys.

    Plain values only: names and dates are made after the rows have been reduced.
    """
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    system = (
        F.when((flag == "R") & (status == "O"), "OSX")
        .when(flag == "R", "Android")
        .when(status == "O", "Windows")
        .when(F.pmod("l_linenumber", F.lit(2)) == 0, "OSX")
        .otherwise("Android")
    )
    lines = table(spark, folder, "lineitem")
    return lines.select(
        *keys, flag.alias("flag"), system.alias("system"), F.year("l_shipdate").alias("year")
    ).distinct()


def _release_parts() -> list[Column]:
    flag, year = F.col("flag"), F.col("year")
    month = F.when(flag == "A", 1).when(flag == "N", 4).otherwise(7)
    return [
        flag.alias("browser_name"),
        year.cast("string").alias("browser_version"),
        F.col("system").alias("os_name"),
        F.lit("10").alias("os_version"),
        F.make_date(year, month, F.lit(1)).alias("release_date"),
    ]


def releases(spark: SparkSession, folder: str) -> DataFrame:
    return _shipments(spark, folder).select(*_release_parts())


def _api_names() -> list[Column]:
    return [
        F.regexp_replace("p_brand", "#", "").alias("interface_name"),
        F.concat_ws("_", F.lower("p_type"), "p_partkey").alias("api_name"),
    ]


def apis(spark: SparkSession, folder: str) -> DataFrame:
    """All parts, shipped or not, with ``interface_key``."""
    return (
        table(spark, folder, "part").select(*_api_names())
        .withColumn("interface_key", interface_key())
    )


def junction(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (release_key, interface_key).

    Shipments shrink to one row per part and release before they meet the parts, so a
    part with most of the shipments is no hot key in the join.
    """
    shipped = _shipments(spark, folder, "l_partkey").select("l_partkey", *_release_parts())
    shipped = shipped.select(F.col("l_partkey").alias("p_partkey"), release_key().alias("release_key"))
    parts = table(spark, folder, "part").select("p_partkey", *_api_names())
    return shipped.join(parts, "p_partkey").select("release_key", interface_key().alias("interface_key"))
