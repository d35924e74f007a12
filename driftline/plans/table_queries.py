"""Tables written by the sinks and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import model
from driftline.functions import release_key
from driftline.operators import metrics
from driftline.operators.compat import grid_of
from driftline.operators.signature import ReleaseIndex, signatures
from driftline.operators.timeline import desktop_only
from driftline.plans import bindings
from driftline.plans.catalog_queries import GRID, NAME_SQL, all_signatures, wide_sql
from driftline.plans.metric_queries import COUNT_COLUMNS, COUNT_SQL, RELEASE_SQL, VALUE_COLUMNS, VALUE_SQL
from driftline.plans.registry import BOUND, joined, query
from driftline.session import fresh_path
from driftline.sources import entities, sinks
from driftline.sources.catalog import import_catalogs, with_release_date


@query(BOUND + "SELECT release_key, interface_key FROM junction")
def write_entities(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "entities")
    sinks.write_entities(
        bindings.releases(spark, folder), bindings.apis(spark, folder),
        bindings.junction(spark, folder), path)
    return spark.read.schema(model.JUNCTION).parquet(f"{path}/junction")


@query(wide_sql())
def write_compat(spark: SparkSession, folder: str) -> DataFrame:
    index, rows = all_signatures(spark, folder)
    path = fresh_path(spark, "compat")
    sinks.write_compat(rows, index, path)
    return spark.read.parquet(f"{path}/compat")


@query(GRID + "SELECT id, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY pos) AS data FROM cells GROUP BY id")
def write_grid(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "grid")
    sinks.write_grid(*grid_of(
        bindings.releases(spark, folder), bindings.apis(spark, folder), bindings.junction(spark, folder)), path)
    grid = spark.read.schema("id STRING, data ARRAY<BOOLEAN>").parquet(f"{path}/grid")
    return grid.select("id", joined("data").alias("data"))


def _written_metrics(spark: SparkSession, folder: str, *types: str) -> str:
    path = fresh_path(spark, "metrics")
    facts = bindings.apis(spark, folder), bindings.junction(spark, folder)
    rows, counts = metrics.run_all_metrics(desktop_only(bindings.releases(spark, folder)), *facts, types)
    sinks.write_metrics(rows, counts, path)
    return path


@query(VALUE_SQL + " WHERE type = 'LONE_REMOVAL'")
def write_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One metric type read from the partitioned metric table."""
    path = _written_metrics(spark, folder, *model.METRIC_TYPES, model.API_COUNT)
    rows = spark.read.schema(model.BROWSER_METRICS).parquet(f"{path}/browser_metrics")
    return metrics.metrics_of_type(rows, model.LONE_REMOVAL).select(*VALUE_COLUMNS)


@query(COUNT_SQL)
def write_api_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = _written_metrics(spark, folder, model.API_COUNT)
    return spark.read.schema(model.API_COUNTS).parquet(f"{path}/api_counts").select(*COUNT_COLUMNS)


@query(BOUND + f"""SELECT pos, {NAME_SQL} AS column_name, browser_name || ' ' || browser_version || ' '
  || os_name || ' ' || os_version AS label, release_date FROM ordered_releases""")
def load_compat_columns(spark: SparkSession, folder: str) -> DataFrame:
    index = ReleaseIndex.build(bindings.releases(spark, folder))
    path = fresh_path(spark, "columns")
    facts = bindings.apis(spark, folder), bindings.junction(spark, folder)
    sinks.write_compat(signatures(*facts, index), index, path)
    columns = entities.load_compat_columns(spark, f"{path}/compat_columns")
    return columns.select(F.col("pos").cast("long").alias("pos"), "column_name", "label", "release.release_date")


@query(BOUND + RELEASE_SQL + " FROM all_releases")
def read_entity_json(spark: SparkSession, folder: str) -> DataFrame:
    """The release dimension as one JSON array, dates in milliseconds."""
    known = bindings.releases(spark, folder)
    record = F.struct(*[
        (F.unix_date(c).cast("long") * 86_400_000 if c == "release_date" else F.col(c)).alias(entities.camel(c))
        for c in known.columns
    ])
    path = fresh_path(spark, "releases-json")
    known.agg(F.to_json(F.collect_list(record)).alias("value")).write.text(path)
    return entities.read_entity_json(spark, path, model.RELEASES)


@query(BOUND + """SELECT browser_name, browser_version AS version_prefix, release_date,
  CAST(browser_version AS BIGINT) AS rank FROM all_releases GROUP BY ALL""")
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    """Release dates by browser and version, written as one JSON object."""
    known = bindings.releases(spark, folder)
    versions = F.map_from_entries(F.array_distinct(F.collect_list(F.struct("browser_version", "release_date"))))
    per_browser = known.groupBy("browser_name").agg(versions.alias("versions"))
    whole = F.map_from_entries(F.collect_list(F.struct("browser_name", "versions")))
    path = fresh_path(spark, "history")
    per_browser.agg(F.to_json(whole).alias("value")).write.text(path)
    return entities.read_version_history(spark, path)


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Prefixes from brands, most of which also start longer versions."""
    parts = bindings.table(spark, folder, "part")
    brand = F.regexp_replace("p_brand", "^Brand#", "")
    seen = parts.groupBy(F.col("p_type").alias("browser_name"), brand.alias("brand")).agg(
        F.min("p_size").alias("least"), F.max("p_size").alias("most"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("least"))
    minor = F.concat_ws(".", "brand", "most")
    rank = F.col("brand").cast("long")
    entries = F.array(
        F.when(rank % 2 == 0, F.struct(
            F.col("brand").alias("version_prefix"), day.alias("release_date"), rank.alias("rank"))),
        F.struct(minor.alias("version_prefix"), F.date_add(day, F.lit(1000)).alias("release_date"),
                 (rank + F.lit(2**33)).alias("rank")),
    )
    kept = F.filter(entries, lambda e: e.isNotNull())
    return seen.select("browser_name", F.explode(kept).alias("e")).select("browser_name", "e.*")


@query("""WITH seen AS (
  SELECT p_type AS browser_name, replace(p_brand, 'Brand#', '') AS brand, min(p_size) AS least, max(p_size) AS most
  FROM part GROUP BY ALL),
history AS (
  SELECT browser_name, brand AS version_prefix, DATE '2000-01-01' + least AS release_date, CAST(brand AS BIGINT) AS rank
  FROM seen WHERE CAST(brand AS BIGINT) % 2 = 0
  UNION ALL SELECT browser_name, brand || '.' || most, DATE '2000-01-01' + least + 1000, CAST(brand AS BIGINT) + 8589934592
  FROM seen),
versions AS (
  SELECT p_partkey, p_type AS browser_name, replace(p_brand, 'Brand#', '') || '.' || p_size || '.' || p_partkey AS browser_version
  FROM part)
SELECT p_partkey, v.browser_name, v.browser_version, min_by(h.release_date, h.rank) AS release_date
FROM versions v LEFT JOIN history h ON h.browser_name = v.browser_name AND starts_with(v.browser_version, h.version_prefix)
GROUP BY ALL""")
def release_date(spark: SparkSession, folder: str) -> DataFrame:
    """The first prefix by rank that starts a version decides its date."""
    brand = F.regexp_replace("p_brand", "^Brand#", "")
    versions = bindings.table(spark, folder, "part").select(
        "p_partkey", F.col("p_type").alias("browser_name"),
        F.concat_ws(".", brand, "p_size", "p_partkey").alias("browser_version"))
    return with_release_date(versions, _history(spark, folder), on_unknown="null").select(
        "p_partkey", "browser_name", "browser_version", "release_date")


@query("""SELECT o_orderkey, coalesce(o_totalprice > 300000, false) AS large,
  coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, DATE '1970-01-01') AS done,
  coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_custkey END, 0) AS customer FROM orders""")
def fill_defaults(spark: SparkSession, folder: str) -> DataFrame:
    orders = bindings.table(spark, folder, "orders")
    return entities.fill_defaults(orders.select(
        "o_orderkey", F.when(F.col("o_totalprice") > 300000, True).alias("large"),
        F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("done"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("customer"),
    ))


@query(BOUND + """SELECT browser_name, browser_version, os_name, os_version, release_date,
  (SELECT count(*) FROM junction j WHERE j.release_key = r.release_key) AS n_apis
FROM all_releases r""")
def import_releases(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows and a version history imported to releases and support facts."""
    known = bindings.releases(spark, folder)
    facts = bindings.junction(spark, folder)
    keyed = known.drop("release_date").withColumn("release_key", release_key())
    catalogs = facts.join(keyed, "release_key").select(
        "browser_name", "browser_version", "os_name", "os_version",
        F.substring_index("interface_key", "#", 1).alias("interface_name"),
        F.substring_index("interface_key", "#", -1).alias("api_name"))
    history = known.select(
        "browser_name", F.col("browser_version").alias("version_prefix"), "release_date",
        F.col("browser_version").cast("long").alias("rank")).distinct()
    releases, _, support = import_catalogs(catalogs, history)
    counted = support.groupBy("release_key").agg(F.count("*").alias("n_apis"))
    return releases.withColumn("release_key", release_key()).join(counted, "release_key").drop("release_key")
