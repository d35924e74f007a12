"""Catalog import: nested ``{interface: [api]}`` maps and release dates to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import interface_key, release_key


def explode_catalogs(catalogs: DataFrame, *keys: str, column: str = "catalog") -> DataFrame:
    """``(*keys, interface_name, api_name)``, without duplicates."""
    lists = catalogs.select(*keys, F.explode(column).alias("interface_name", "api_names"))
    return lists.select(*keys, "interface_name", F.explode("api_names").alias("api_name")).distinct()


def version_rows(history: DataFrame, column: str = "history") -> DataFrame:
    """Rows of a ``{browser: {version prefix: date}}`` map with their lookup order.

    Prefixes that look like array indices come first, in numeric order, then the others
    in file order.
    """
    per_browser = history.select(F.explode(column).alias("browser_name", "versions"))
    listed = per_browser.select(
        "browser_name", F.posexplode("versions").alias("pos", "version_prefix", "release_date")
    )
    index_like = F.col("version_prefix").rlike("^(0|[1-9][0-9]{0,9})$")
    number = F.when(index_like, F.col("version_prefix").cast("long")).otherwise(
        F.lit(2**33) + F.col("pos")
    )
    return listed.select(
        "browser_name", "version_prefix", F.to_date("release_date").alias("release_date"),
        number.alias("rank"),
    )


def with_release_date(
    releases: DataFrame, history: DataFrame, on_unknown: str = "error"
) -> DataFrame:
    """Add ``release_date``: the first known prefix, by rank, that starts the version.

    Every prefix of a version is looked up by equality, so no pair of a version and an
    unrelated prefix is ever formed. ``on_unknown="error"`` fails on a browser or version
    without a date; ``"null"`` leaves the date empty for a reject table.
    """
    versions = releases.select("browser_name", "browser_version").distinct()
    prefixes = versions.select(
        "browser_name", "browser_version",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.length("browser_version")),
            lambda n: F.substr("browser_version", F.lit(1), n),
        )).alias("version_prefix"),
    )
    dated = (
        prefixes.join(history, ["browser_name", "version_prefix"])
        .groupBy("browser_name", "browser_version")
        .agg(F.min_by("release_date", "rank").alias("release_date"))
    )
    result = releases.drop("release_date").join(dated, ["browser_name", "browser_version"], "left")
    if on_unknown == "null":
        return result
    unknown = F.concat_ws(" ", F.lit("no release date for"), "browser_name", "browser_version")
    return result.withColumn(
        "release_date", F.coalesce("release_date", F.raise_error(unknown).cast("date"))
    )


def import_catalogs(
    catalogs: DataFrame, history: DataFrame, on_unknown: str = "error", releases: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Releases, APIs and support facts from one row per (release, interface, api).

    ``catalogs`` has the four release parts, ``interface_name`` and ``api_name``. ``releases`` may give
    the parts that it has, where they are known with less work.
    """
    parts = ["browser_name", "browser_version", "os_name", "os_version"]
    listed = catalogs if releases is None else releases
    releases = with_release_date(listed.select(*parts).distinct(), history, on_unknown)
    apis = catalogs.select("interface_name", "api_name").distinct()
    facts = catalogs.select(
        release_key().alias("release_key"), interface_key().alias("interface_key")
    ).distinct()
    return (
        releases.select(*parts, "release_date"),
        apis.withColumn("interface_key", interface_key()),
        facts,
    )
