"""The wide boolean table, the grid, and the views over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import api_of, extract_cols, interface_of, known_positions
from driftline.operators.division import signature_classes
from driftline.operators.ranks import ranked
from driftline.operators.signature import RELEASE_ORDER, WORD, ReleaseIndex, ships, with_release_key


def integrity_violations(releases: DataFrame, apis: DataFrame, junction: DataFrame) -> DataFrame:
    """Junction rows whose release or API does not exist; must be empty.

    ``releases`` needs ``release_key``, ``apis`` needs ``interface_key``.
    """
    no_release = junction.join(releases.select("release_key"), "release_key", "left_anti")
    no_api = junction.join(apis.select("interface_key"), "interface_key", "left_anti")
    columns = ["release_key", "interface_key"]
    return (
        no_release.select(*columns, F.lit("release").alias("missing"))
        .unionByName(no_api.select(*columns, F.lit("api").alias("missing")))
    )


def compat_columns(index: ReleaseIndex) -> DataFrame:
    """Column model of the wide table; releases with equal names share a column."""
    first = Window.partitionBy("column_name").orderBy("pos")
    release = F.struct("browser_name", "browser_version", "os_name", "os_version", "release_date")
    return (
        index.frame.withColumn("nth", F.row_number().over(first)).where("nth = 1")
        .select("pos", "column_name", "label", "release_key", release.alias("release"))
    )


def pivot_compat(signatures: DataFrame, index: ReleaseIndex) -> DataFrame:
    """One row per API, one boolean column per release in release order.

    Built from strict signatures, so the width costs projections, not shuffles. The
    release travels as metadata of its column.
    """
    positions: dict[str, list[int]] = {}
    for pos, row in enumerate(index.rows):
        positions.setdefault(row.column_name, []).append(pos)
    columns = [
        reduce(Column.__or__, [ships(index, pos) for pos in where]).alias(
            name, metadata={"label": index.rows[where[0]].label, "release": index.keys[where[0]]}
        )
        for name, where in positions.items()
    ]
    return signatures.select(
        F.col("interface_key").alias("id"),
        interface_of("interface_key").alias("interface_name"),
        api_of("interface_key").alias("api_name"),
        *columns,
    )


def column_for_release(wide: DataFrame, key: str) -> str:
    """Name of the wide column that carries this release."""
    for field in wide.schema.fields:
        if field.metadata.get("release") == key:
            return field.name
    raise KeyError(f"no column for release {key}")


def build_grid(signatures: DataFrame, index: ReleaseIndex) -> DataFrame:
    """``id`` and a boolean array with one element per release position."""
    words = F.array(*[F.col(f"w{i}") for i in range(index.n_words)])
    if not index.rows:
        return signatures.select(F.col("interface_key").alias("id"),
                                 F.array().cast("array<boolean>").alias("data"))
    data = F.transform(
        F.sequence(F.lit(0), F.lit(len(index.rows) - 1)),
        lambda p: F.getbit(F.get(words, (p / WORD).cast("int")), F.pmod(p, F.lit(WORD))) == 1,
    )
    return signatures.select(F.col("interface_key").alias("id"), data.alias("data"))


def grid_of(releases: DataFrame, apis: DataFrame, junction: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The grid and its columns (``pos, release_key``) for any number of releases.

    Releases are numbered by ranges, and each class of APIs is spread out once.
    """
    once = with_release_key(releases).select(*RELEASE_ORDER, "release_key").distinct()
    placed = ranked(once, *RELEASE_ORDER, "release_key")
    places = placed.numbered().select("release_key", "pos")
    known = signature_classes(releases, apis, junction, places)
    words = F.map_from_entries(F.transform("words", lambda w: F.struct(w["word"], w["bits"])))
    inside = lambda p: F.getbit(
        F.coalesce(F.element_at("held", F.shiftright(p, 6)), F.lit(0).cast("bigint")), F.pmod(p, F.lit(WORD)).cast("int")) == 1
    size = placed.before[-1]
    positions = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")) if size else F.array().cast("array<bigint>")
    spread = known.classes.withColumn("held", words).select("digest", F.transform(positions, inside).alias("data"))
    grid = known.signed.join(spread, "digest").select(F.col("interface_key").alias("id"), "data")
    return grid, places.select("pos", "release_key")


def grid_columns(index: ReleaseIndex) -> DataFrame:
    return index.frame.select("pos", "release_key")


def project_cols(grid: DataFrame, columns: Sequence, wanted: Sequence) -> DataFrame:
    """Grid rows reduced to the wanted columns, in that order; unknown ones are dropped."""
    return grid.withColumn("data", extract_cols("data", known_positions(columns, wanted)))


def select_releases(wide: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The wide table with the chosen releases only, always in release order."""
    chosen = {column_for_release(wide, key) for key in keys}
    kept = [f.name for f in wide.schema.fields if "release" not in f.metadata or f.name in chosen]
    return wide.select(*kept)


def filtered_and_total(table: DataFrame, predicate: Column) -> DataFrame:
    """"n of m" counts in one pass."""
    return table.agg(F.count_if(predicate).alias("filtered"), F.count("*").alias("total"))


def page(table: DataFrame, order: Sequence[str], skip: int, size: int = 40) -> DataFrame:
    """A window of rows in the given order; for many pages keep what ``ranks.ranked`` gives."""
    return ranked(table, *order).page(skip, size)


def observed_support(apis: DataFrame, junction: DataFrame) -> DataFrame:
    """Interface and API with the sorted set of releases shipping it."""
    return (
        junction.join(apis, "interface_key")
        .groupBy("interface_name", "api_name")
        .agg(F.sort_array(F.collect_set("release_key")).alias("releases"))
    )


def api_releases(junction: DataFrame, releases: DataFrame, key: str) -> DataFrame:
    """The releases that ship an API."""
    shipped = junction.where(F.col("interface_key") == key)
    return releases.join(shipped.select("release_key"), "release_key", "left_semi")


def release_apis(junction: DataFrame, apis: DataFrame, key: str) -> DataFrame:
    """The APIs a release ships."""
    shipped = junction.where(F.col("release_key") == key)
    return apis.join(shipped.select("interface_key"), "interface_key", "left_semi")


def check_expectations(expectations: DataFrame, junction: DataFrame) -> DataFrame:
    """Expected presence (``expected`` 0 or 1) against the junction, with a verdict."""
    keys = ["release_key", "interface_key"]
    found = junction.select(*keys).distinct().withColumn("hit", F.lit(1))
    return (
        expectations.join(found, keys, "left")
        .select(*keys, "expected", F.coalesce("hit", F.lit(0)).cast("long").alias("found"))
        .withColumn("ok", F.col("expected") == F.col("found"))
    )
