"""Release timelines: as-of lookups, grace windows and consecutive releases.

Range conditions meet through calendar years: an interval is put in a bucket for each year it
touches, a year-long window in two at most, and equality on year, browser and operating system
leaves few rows for the range test. What a point needs to know of other releases are long rows,
one for each release and role; nobody's history is gathered.
"""

from __future__ import annotations

from collections.abc import Collection
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import is_mobile, one_year_before
from driftline.session import cut_lineage

PREFERRED_OS = "Windows"


def desktop_only(releases: DataFrame) -> DataFrame:
    return releases.where(~is_mobile())


def release_dates(releases: DataFrame) -> DataFrame:
    return releases.select(F.col("release_date").alias("date")).distinct().orderBy("date")


def latest_release_asof(releases: DataFrame) -> DataFrame:
    """For every release date and browser, the release in force.

    That is the newest one up to the date, but any release on the preferred system beats
    a newer one elsewhere. Browsers without a release so far are missing.
    Columns: ``date``, ``browser_name``, ``os_name``, ``release_key``.
    """
    by_date = Window.partitionBy("browser_name").orderBy("release_date")
    so_far = by_date.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # On one day the smallest key stands for the day, so a browser has a row a day at most.
    per_day = releases.groupBy("browser_name", "release_date").agg(
        F.min(F.when(F.col("os_name") == PREFERRED_OS, F.struct("release_key", "os_name"))).alias("own"),
        F.min(F.struct("release_key", "os_name")).alias("any"),
    )
    in_force = per_day.select(
        "browser_name",
        F.col("release_date").alias("valid_from"),
        F.lead("release_date").over(by_date).alias("valid_to"),
        F.coalesce(
            F.last("own", ignorenulls=True).over(so_far), F.last("any").over(so_far)
        ).alias("latest"),
    )
    end = releases.agg(F.max("release_date").alias("end")).scalar()
    years = F.sequence(F.year("valid_from"), F.year(F.coalesce(F.date_sub("valid_to", 1), end)))
    dates = releases.select(F.col("release_date").alias("date")).distinct().withColumn("year", F.year("date"))
    return in_force.withColumn("year", F.explode(years)).join(dates, "year").where(
        (F.col("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to")))
    ).select(
        "date", "browser_name", F.col("latest.os_name").alias("os_name"),
        F.col("latest.release_key").alias("release_key"),
    )


#: What a release may be to a point. All are of the point's own browser and system, or, for the last
#: two, of the others': the release in force; own ones of the year before the date; all own ones before
#: it; own ones older than that year, and of these the newest, and the rest; the others' releases in
#: force; the others' of that year, date included.
OWN, GRACE_PREVIOUS, ALL_PREVIOUS, BEFORE_GRACE, POST, EARLIER, CURRENT_OTHERS, GRACE_COMPARED = ROLES = (
    "own", "grace_previous", "all_previous", "before_grace", "post", "earlier", "current_others", "grace_compared")


class Points(NamedTuple):
    """``points`` (date, browser_name, os_name, release_key) and ``roles`` (date, browser_name, role, release_key, nth).

    ``nth`` and then the key give the order of a role's releases.
    """

    points: DataFrame
    roles: DataFrame


def points_of(releases: DataFrame, complete_only: bool = True) -> DataFrame:
    """The releases in force, on dates on which every browser has one (unless ``complete_only`` is off)."""
    latest = latest_release_asof(releases)
    if not complete_only:
        return latest
    browsers = releases.agg(F.count_distinct("browser_name").alias("n")).scalar()
    complete = latest.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") == browsers)
    return latest.join(complete.select("date"), "date", "left_semi")


def point_roles(
    releases: DataFrame, wanted: Collection[str] = ROLES, complete_only: bool = True
) -> Points:
    """The metric points, and the releases that stand in a wanted role to each."""
    points = cut_lineage(points_of(releases, complete_only), "points")
    own = points.select("date", "browser_name", "os_name")
    past = releases.select("browser_name", "os_name", "release_key", F.col("release_date").alias("past"))
    start, day = one_year_before("date"), F.unix_date("past")

    def role(rows: DataFrame, name: str | Column, nth: Column | None = None) -> DataFrame:
        return rows.select(
            "date", "browser_name", (F.lit(name) if isinstance(name, str) else name).alias("role"), "release_key",
            (F.lit(0) if nth is None else nth).alias("nth"),
        )

    made = []
    if OWN in wanted:
        made.append(role(points, OWN))
    if {GRACE_PREVIOUS, GRACE_COMPARED} & set(wanted):
        # A release lies in the year before dates of its own year and of the next.
        years = F.explode(F.array(F.year("past"), F.year("past") + 1))
        grace = own.withColumn("year", F.year("date")).join(
            past.withColumn("year", years), ["browser_name", "os_name", "year"]
        ).where((F.col("past") >= start) & (F.col("past") <= F.col("date")))
        if GRACE_COMPARED in wanted:
            grace = cut_lineage(grace, "grace")
            others = points.select("date", F.col("browser_name").alias("me")).join(grace, "date").where("me != browser_name")
            made.append(role(others.withColumn("browser_name", F.col("me")), GRACE_COMPARED))
        if GRACE_PREVIOUS in wanted:
            made.append(role(grace.where("past < date"), GRACE_PREVIOUS, day))
    if CURRENT_OTHERS in wanted:
        them = points.select("date", F.col("browser_name").alias("them"), "release_key")
        made.append(role(points.drop("release_key").join(them, "date").where("them != browser_name"), CURRENT_OTHERS))
    if {ALL_PREVIOUS, BEFORE_GRACE, POST, EARLIER} & set(wanted):
        history = own.join(past, ["browser_name", "os_name"]).where("past < date")
        older = history.where(F.col("past") < start)
        if ALL_PREVIOUS in wanted:
            made.append(role(history, ALL_PREVIOUS, day))
        if BEFORE_GRACE in wanted:
            made.append(role(older, BEFORE_GRACE, -day))
        if {POST, EARLIER} & set(wanted):
            newest = older.groupBy("date", "browser_name").agg(F.min(F.struct(-day, "release_key"))["release_key"].alias("post"))
            marked = older.join(newest, ["date", "browser_name"])
            name = F.when(F.col("release_key") == F.col("post"), F.lit(POST)).otherwise(F.lit(EARLIER))
            made.append(role(marked, name, -day).where(F.col("role").isin(*wanted)))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    return Points(points, cut_lineage(rows, "roles"))


def in_order(role: str) -> Column:
    """The releases of a role as an array, when roles are grouped by point."""
    listed = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("nth", "release_key"))))
    return F.transform(listed, lambda e: e["release_key"])


#: Roles that wide points have an array for.
LISTED = (GRACE_PREVIOUS, ALL_PREVIOUS, BEFORE_GRACE, CURRENT_OTHERS, GRACE_COMPARED)


def metric_points(releases: DataFrame, complete_only: bool = True) -> DataFrame:
    """One row per metric point with the releases of each role as arrays, for showing them.

    Columns: ``date``, ``browser_name``, ``os_name``, ``release_key`` and an array for each of
    ``LISTED``: ``before_grace`` newest first, the own ones oldest first, the others' by key.
    """
    found = point_roles(releases, LISTED, complete_only)
    lists = found.roles.groupBy("date", "browser_name").agg(*[in_order(role).alias(role) for role in LISTED])
    nothing = F.array().cast("array<string>")
    return found.points.join(lists, ["date", "browser_name"], "left").select(
        *found.points.columns, *[F.coalesce(role, nothing).alias(role) for role in LISTED])


def split_post_and_prev(newest_first: Column) -> tuple[Column, Column]:
    """First entry, and the rest, of a newest-first list."""
    return F.get(newest_first, F.lit(0)), F.slice(newest_first, 2, F.size(newest_first))


def preferred_os(releases: DataFrame) -> DataFrame:
    """Per browser the preferred system if it ever shipped there, else the first seen."""
    first = F.min_by("os_name", F.struct("release_date", "release_key"))
    ever = F.max(F.col("os_name") == PREFERRED_OS)
    return releases.groupBy("browser_name").agg(
        F.when(ever, F.lit(PREFERRED_OS)).otherwise(first).alias("os_name")
    )


def consecutive_pairs(releases: DataFrame) -> DataFrame:
    """Each release of a browser's preferred system with the one before it.

    Columns: ``browser_name``, ``release_date``, ``curr_release``, ``prev_release`` (null
    for the first). Two releases on one day share a key; the later pair is kept.
    """
    chosen = releases.join(preferred_os(releases), ["browser_name", "os_name"])
    order = Window.partitionBy("browser_name").orderBy("release_date", "release_key")
    same_day = Window.partitionBy("browser_name", "release_date").orderBy(F.desc("release_key"))
    pairs = chosen.select(
        "browser_name", "release_date", "release_key",
        F.lag("release_key").over(order).alias("prev_release"),
    )
    return (
        pairs.withColumn("nth", F.row_number().over(same_day)).where("nth = 1")
        .select("browser_name", "release_date",
                F.col("release_key").alias("curr_release"), "prev_release")
    )


def default_in_view(releases: DataFrame) -> DataFrame:
    """Newest release per browser over all systems, in release order."""
    order = ["release_date", "browser_name", "browser_version", "os_name", "os_version"]
    newest = F.max(F.struct(*order, "release_key")).alias("r")
    return releases.groupBy("browser_name").agg(newest).select("r.*").orderBy(*order)
