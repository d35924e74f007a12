"""Support metrics over time, all evaluated by one division over the junction.

A metric says which roles of releases (``timeline.ROLES``) an API must ship in, must not ship in
and must ship in one of. Register more in ``MEASURES``; all selected metrics share one pass, and
roles stay long rows until the result lists them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import model
from driftline.functions import epoch_ms, friendly_browser_version
from driftline.operators import division, timeline
from driftline.operators.signature import with_release_key
from driftline.operators.timeline import (
    ALL_PREVIOUS, BEFORE_GRACE, CURRENT_OTHERS, EARLIER, GRACE_COMPARED, GRACE_PREVIOUS, OWN, POST, consecutive_pairs,
)
from driftline.session import cut_lineage

KEYS = ["type", "browser_name", "date"]


class Measure(NamedTuple):
    """A metric by roles.

    ``release``, ``previous`` and ``compared`` are the roles that the row shows. ``any_of`` is None if
    nothing of the kind is asked. Releases in a ``spared`` role are never asked for in ``none_of``.
    ``eligible`` tells which points have a row, from the number of releases in a role.
    """

    release: str
    previous: str
    compared: str
    all_of: tuple[str, ...]
    none_of: tuple[str, ...]
    any_of: tuple[str, ...] | None = None
    spared: tuple[str, ...] = ()
    eligible: Callable[[Callable[[str], Column]], Column] | None = None
    counted: tuple[str, ...] = ()

    def sides(self) -> dict[str, tuple[str, ...]]:
        return {division.ALL: self.all_of, division.NONE: self.none_of, division.ANY: self.any_of or ()}

    def roles(self) -> set[str]:
        shown = (self.release, self.previous, self.compared, *self.spared, *self.counted)
        return {*shown, *(role for side in self.sides().values() for role in side)}


#: Shipped by this browser throughout the grace year, by no other browser in it.
browser_specific = Measure(
    OWN, GRACE_PREVIOUS, GRACE_COMPARED, all_of=(OWN, GRACE_PREVIOUS), none_of=(GRACE_COMPARED,))

#: Shipped by all others throughout the grace year, never by this browser.
lone_omission = Measure(
    OWN, ALL_PREVIOUS, GRACE_COMPARED, all_of=(GRACE_COMPARED,), none_of=(OWN, ALL_PREVIOUS))

#: Once shipped, gone before the grace year and still gone, present everywhere else; no row with
#: exactly one other browser or fewer than two old releases.
lone_removal = Measure(
    POST, EARLIER, CURRENT_OTHERS, all_of=(CURRENT_OTHERS,), none_of=(POST, OWN), any_of=(EARLIER,),
    eligible=lambda n: (n(CURRENT_OTHERS) != 1) & (n(BEFORE_GRACE) >= 2), counted=(BEFORE_GRACE,),
)

MEASURES: dict[str, Measure] = {
    model.BROWSER_SPECIFIC: browser_specific,
    model.LONE_OMISSION: lone_omission,
    model.LONE_REMOVAL: lone_removal,
}


class Measured(NamedTuple):
    """``header`` (type, browser_name, date, release, needs_some), ``roles`` (KEYS, side, release_key) and
    ``shown`` (KEYS, list, release_key, nth), the releases that a row lists."""

    header: DataFrame
    roles: DataFrame
    shown: DataFrame


def _dealt(roles: DataFrame, uses: dict[str, list[tuple[str, str]]], name: str) -> DataFrame:
    """Each role row for every (type, ``name``) that uses its role, in one pass."""
    table = F.create_map(*[
        part for role, pairs in uses.items() for part in (F.lit(role), F.array(*[
            F.struct(F.lit(kind).alias("type"), F.lit(use).alias(name)) for kind, use in pairs]))])
    return roles.withColumn("use", F.explode(table[F.col("role")])).select(
        "use.*", "browser_name", "date", "release_key", "nth")


def _uses(registry: Mapping[str, Measure], of: Callable[[Measure], dict[str, tuple[str, ...]]]) -> dict:
    uses: dict[str, list[tuple[str, str]]] = {}
    for kind, spec in registry.items():
        for use, names in of(spec).items():
            for role in names:
                uses.setdefault(role, []).append((kind, use))
    return uses


def measured(
    releases: DataFrame, types: Iterable[str], registry: Mapping[str, Measure] = MEASURES
) -> Measured:
    """Headers and roles of all metric rows of ``types``; the points are formed once."""
    chosen = {kind: registry[kind] for kind in types}
    points, roles = timeline.point_roles(
        with_release_key(releases), set().union(*[spec.roles() for spec in chosen.values()]))
    at = ["date", "browser_name"]
    sizes = {role for spec in chosen.values() if spec.eligible for role in (*spec.roles(), *spec.counted)}
    if sizes:
        counted = roles.groupBy(*at).agg(*[F.count_if(F.col("role") == role).alias(f"n_{role}") for role in sorted(sizes)])
        points = points.join(counted, at, "left")
    headers = []
    for kind, spec in chosen.items():
        own = points
        if spec.eligible:
            own = own.where(spec.eligible(lambda role: F.coalesce(f"n_{role}", F.lit(0))))
        if spec.release != OWN:
            shown = roles.where(F.col("role") == spec.release).select(*at, F.col("release_key").alias("shown"))
            own = own.join(shown, at).withColumn("release_key", F.col("shown"))
        headers.append(own.select(
            F.lit(kind).alias("type"), "browser_name", "date", F.col("release_key").alias("release"),
            F.lit(spec.any_of is not None).alias("needs_some")))
    asked = _dealt(roles, _uses(chosen, Measure.sides), "side").drop("nth")
    spared = _uses(chosen, lambda spec: {division.NONE: spec.spared})
    if spared:
        asked = asked.join(_dealt(roles, spared, "side").drop("nth"), [*KEYS, "side", "release_key"], "left_anti")
    lists = _uses(chosen, lambda spec: {"prev_releases": (spec.previous,), "compared_releases": (spec.compared,)})
    return Measured(
        cut_lineage(reduce(DataFrame.unionByName, headers), "measures"), asked, _dealt(roles, lists, "list"))


def with_lists(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Metric rows with the releases they were compared with, as arrays."""
    def listed(name: str) -> Column:
        entries = F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct("nth", "release_key"))))
        return F.transform(entries, lambda e: e["release_key"]).alias(name)

    names = ("prev_releases", "compared_releases")
    lists = shown.groupBy(*KEYS).agg(*[listed(name) for name in names])
    nothing = F.array().cast("array<string>")
    return rows.join(lists, KEYS, "left").withColumns({name: F.coalesce(name, nothing) for name in names})


def measure_points(
    releases: DataFrame, types: Iterable[str], registry: Mapping[str, Measure] = MEASURES
) -> DataFrame:
    """One wide row per metric row: its lists, and its three sides as arrays, for showing them."""
    header, roles, shown = measured(releases, types, registry)
    sides = roles.groupBy(*KEYS).agg(*[
        F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("release_key")))).alias(side)
        for side in division.SIDES])
    nothing = F.array().cast("array<string>")
    filled = {side: F.coalesce(side, nothing) for side in (division.ALL, division.NONE)}
    filled[division.ANY] = F.when(F.col("needs_some"), F.coalesce(division.ANY, nothing))
    return with_lists(header.join(sides, KEYS, "left").withColumns(filled), shown).drop("needs_some")


def listed_once(releases: DataFrame) -> DataFrame:
    """Releases by key, each once however often they are listed; the earliest date counts."""
    once = with_release_key(releases).groupBy("release_key").agg(
        F.min(F.struct("release_date", "browser_name", "browser_version", "os_name", "os_version")).alias("r"))
    return once.select("r.browser_name", "r.browser_version", "r.os_name", "r.os_version", "r.release_date")


def browser_metrics(
    releases: DataFrame, apis: DataFrame, junction: DataFrame,
    types: Iterable[str] = model.METRIC_TYPES, registry: Mapping[str, Measure] = MEASURES,
) -> DataFrame:
    """Metric rows by (type, browser_name, date), for the releases passed in."""
    known = cut_lineage(listed_once(releases), "releases")
    header, roles, shown = measured(known, types, registry)
    counted = division.counted(header.select(*KEYS, "needs_some"), roles, KEYS, known, apis, junction)
    rows = division.with_counts(header, KEYS, counted)
    return with_lists(rows, shown).select(*model.BROWSER_METRICS.fieldNames())


def _count_measures(releases: DataFrame) -> DataFrame:
    """Total, new and removed APIs of each release pair as measures."""
    curr, prev = F.array("curr_release"), F.array("prev_release")
    nothing = F.array().cast("array<string>")

    def side(kind: str, all_of: Column, none_of: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), all_of.alias("all_of"), none_of.alias("none_of"),
                        F.lit(None).cast("array<string>").alias("any_of"))

    first = F.array(side("total", curr, nothing))
    later = F.array(
        side("total", curr, nothing), side("new", curr, prev), side("removed", prev, curr)
    )
    return (
        consecutive_pairs(with_release_key(releases))
        .withColumn("side", F.explode(F.when(F.col("prev_release").isNull(), first).otherwise(later)))
        .select("side.type", "browser_name", F.col("release_date").alias("date"),
                "curr_release", "prev_release", "side.all_of", "side.none_of", "side.any_of")
    )


def _folded_counts(rows: DataFrame) -> DataFrame:
    """API count rows from their counted sides."""
    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("type") == kind, F.col("value")).otherwise(0)).alias(f"{kind}_apis")

    return rows.groupBy(
        "browser_name", F.col("date").alias("release_date"), "curr_release", "prev_release"
    ).agg(total("total"), total("new"), total("removed"))


def api_counts(releases: DataFrame, apis: DataFrame, junction: DataFrame) -> DataFrame:
    """API count rows by (browser_name, release_date); first releases add nothing."""
    known = cut_lineage(listed_once(releases), "releases")
    measures = cut_lineage(_count_measures(known), "measures")
    counted = division.counts(measures, KEYS, known, apis, junction)
    return _folded_counts(division.with_counts(measures, KEYS, counted))


def run_all_metrics(
    releases: DataFrame, apis: DataFrame, junction: DataFrame,
    types: Iterable[str] = (*model.METRIC_TYPES, model.API_COUNT),
) -> tuple[DataFrame | None, DataFrame | None]:
    """The metric table and the API count table, each only if a type asks for it.

    All types share one table of measures, one fold of the junction and one pass over both.
    """
    wanted = list(types)
    kinds = [kind for kind in wanted if kind != model.API_COUNT]
    if not wanted:
        return None, None
    known = cut_lineage(listed_once(releases), "releases")
    headers, roles, header, shown, pairs = [], [], None, None, None
    if kinds:
        header, asked, shown = measured(known, kinds)
        headers.append(header.select(*KEYS, "needs_some"))
        roles.append(asked)
    if model.API_COUNT in wanted:
        pairs = cut_lineage(_count_measures(known), "measures")
        headers.append(division.headers(pairs, KEYS))
        roles.append(division.long_roles(pairs, KEYS))
    counted = cut_lineage(division.counted(
        reduce(DataFrame.unionByName, headers), reduce(DataFrame.unionByName, roles), KEYS, known, apis, junction
    ), "metrics")
    rows = counts = None
    if kinds:
        rows = with_lists(division.with_counts(header, KEYS, counted), shown).select(*model.BROWSER_METRICS.fieldNames())
    if pairs is not None:
        counts = _folded_counts(division.with_counts(pairs, KEYS, counted))
    return rows, counts


def metrics_of_type(metrics: DataFrame, kind: str) -> DataFrame:
    return metrics.where(F.col("type") == kind)


def metric_series(metrics: DataFrame) -> DataFrame:
    """Per type and browser, the points in date order."""
    points = F.sort_array(F.collect_list(F.struct("date", "value")))
    return metrics.groupBy("type", "browser_name").agg(points.alias("points"))


def flatten_api_counts(counts: DataFrame, releases: DataFrame) -> DataFrame:
    """The published flat record of an API count row, with both releases attached."""
    dim = with_release_key(releases)

    def nested(name: str) -> DataFrame:
        parts = F.struct("browser_name", "browser_version", "os_name", "os_version", "release_date")
        return dim.select(F.col("release_key").alias(f"{name}_release"), parts.alias(name))

    joined = counts.join(nested("curr"), "curr_release").join(nested("prev"), "prev_release", "left")
    return joined.select(
        epoch_ms("release_date").alias("release_date"),
        "browser_name",
        friendly_browser_version("curr.browser_name", "curr.browser_version").alias("browser_version"),
        F.col("curr.os_name").alias("os_name"), F.col("curr.os_version").alias("os_version"),
        "total_apis", "new_apis", "removed_apis", "prev", "curr",
    )


def reject_negative(metrics: DataFrame) -> DataFrame:
    """Rows whose value is unset or negative; a valid metric table has none."""
    return metrics.where(F.col("value").isNull() | (F.col("value") < 0))
