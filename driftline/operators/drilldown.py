"""The API lists behind metric points, and the searches that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import model
from driftline.functions import terse_release_id
from driftline.operators import division
from driftline.operators.metrics import KEYS, MEASURES, listed_once, measured
from driftline.operators.timeline import POST
from driftline.session import cut_lineage


def diff_view(junction: DataFrame, minuend: str, subtrahend: str) -> DataFrame:
    """APIs shipped by exactly one of two releases, in one pass over their rows.

    ``side`` is ``new`` for APIs of the minuend only and ``removed`` for the other way.
    """
    mine = F.max(F.col("release_key") == minuend)
    other = F.max(F.col("release_key") == subtrahend)
    return (
        junction.where(F.col("release_key").isin(minuend, subtrahend))
        .groupBy("interface_key").agg(mine.alias("mine"), other.alias("other"))
        .where(F.col("mine") != F.col("other"))
        .select("interface_key", F.when(F.col("mine"), "new").otherwise("removed").alias("side"))
    )


def metric_apis(
    kind: str, releases: DataFrame, apis: DataFrame, junction: DataFrame, points: DataFrame | None = None,
) -> DataFrame:
    """The APIs behind points of a metric: ``(type, browser_name, date, interface_key)``.

    ``points`` (``browser_name``, ``date``) are the ones asked for; without it, all are listed. A lone
    removal's list leaves out the metric's last condition, "still gone in the release in force", so
    it may be longer than the metric's value.
    """
    known = cut_lineage(listed_once(releases), "releases")
    spec = MEASURES[kind]
    if kind == model.LONE_REMOVAL:
        spec = spec._replace(none_of=(POST,))
    header, roles, _ = measured(known, [kind], {kind: spec})
    header = header.select(*KEYS, "needs_some")
    if points is not None:
        asked, at = points.select("browser_name", "date").distinct(), ["browser_name", "date"]
        header, roles = header.join(asked, at, "left_semi"), roles.join(asked, at, "left_semi")
    return division.matching(header, roles, KEYS, known, apis, junction)


def query_for(metrics: DataFrame) -> DataFrame:
    """View state of each metric row: releases in view and the search that lists its APIs.

    Columns added: ``shipped`` and ``not_shipped`` (terse release ids), ``counts`` (the
    alternatives for the number of shipping releases in view) and ``query``.
    """
    kind = F.col("type")
    own = F.array("release")
    prev, others = F.col("prev_releases"), F.col("compared_releases")
    nothing = F.array().cast("array<string>")
    shipped = (
        F.when(kind == model.LONE_OMISSION, others)
        .when(kind == model.BROWSER_SPECIFIC, F.concat(own, prev))
        .otherwise(others)
    )
    not_shipped = (
        F.when(kind == model.LONE_OMISSION, F.concat(own, prev))
        .when(kind == model.BROWSER_SPECIFIC, others)
        .otherwise(own)
    )
    in_view = F.concat(own, prev, others)
    counts = F.when(
        kind == model.LONE_REMOVAL, F.sequence(F.size(others) + 1, F.size(in_view))
    ).otherwise(F.array().cast("array<int>"))

    def terse(keys: Column) -> Column:
        return F.sort_array(F.transform(F.array_distinct(keys), terse_release_id))

    with_parts = metrics.select(
        "*",
        F.array_distinct(in_view).alias("in_view"),
        terse(shipped).alias("shipped"),
        terse(not_shipped).alias("not_shipped"),
        counts.alias("counts"),
    )
    alternatives = F.transform("counts", lambda n: F.concat(F.lit("count:"), n.cast("string")))
    count_text = F.when(F.size("counts") > 1, F.concat(F.lit("("), F.array_join(alternatives, " or "), F.lit(")"))
                        ).otherwise(F.array_join(alternatives, ""))
    words = F.concat(
        F.transform("shipped", lambda r: F.concat(F.lit("in:"), r)),
        F.transform("not_shipped", lambda r: F.concat(F.lit("notin:"), r)),
        F.filter(F.array(count_text), lambda t: t != ""),
    )
    return with_parts.withColumn("query", F.array_join(words, " "))
