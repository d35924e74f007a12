"""Relational division: for each measure, the APIs shipped in all of one set of
releases, in none of another and, optionally, in any of a third.

A measure has key columns of its own and asks for releases on three sides, ``all_of``,
``none_of`` and ``any_of``, as arrays or as long rows (``ROLES``). There is one plan for any
number of releases.

APIs that ship in the same releases are one class with a weight. Classes are numbered, and
each release has a bitmap over them, kept in blocks of 64 classes. A measure meets the blocks
of the releases it names, an equality join, and ANDs and ORs their words: what is formed grows
with measures and blocks of classes, never with the junction. Counts are popcounts weighted by
bit planes of the classes' weights; lists expand the classes that match. Blocks are spread
over salts, so that a release that every measure names is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.signature import WORD, bit, with_release_key
from driftline.session import cut_lineage

ALL, NONE, ANY = SIDES = ("all_of", "none_of", "any_of")
#: Position of the release that every API ships in; measures that require nothing ask for it.
EVERYWHERE = -1
SALTS = 16
SHIFT = WORD.bit_length() - 1


class Classes(NamedTuple):
    """``places`` (release_key, pos), ``classes`` (class_id, digest, words, weight), ``signed`` (interface_key, digest)."""

    places: DataFrame
    classes: DataFrame
    signed: DataFrame


def _bits(*keys: str | Column, at: str) -> tuple[list[Column], Column]:
    """Grouping keys and the aggregate that fold numbers into 64-bit words."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return [*columns, F.shiftright(at, SHIFT).alias("word")], F.bit_or(bit(F.col(at))).alias("bits")


def signature_classes(
    releases: DataFrame, apis: DataFrame, junction: DataFrame, places: DataFrame | None = None
) -> Classes:
    """The dictionary of distinct support sets, in one fold of the junction.

    Facts of releases or APIs that are not listed don't count; listed APIs that ship nowhere are a
    class too. Releases are numbered as they are written, for which any numbers will do, or by
    ``places``.
    """
    if places is None:
        named = with_release_key(releases).select("release_key").distinct()
        places = cut_lineage(named.withColumn("pos", F.monotonically_increasing_id()), "releases")
    keys, bits = _bits("interface_key", at="pos")
    words = junction.join(places, "release_key").groupBy(*keys).agg(bits).groupBy("interface_key").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    listed = apis.select("interface_key").distinct().join(words, "interface_key", "left")
    whole = F.coalesce("words", F.array().cast("array<struct<word:bigint,bits:bigint>>"))
    signed = listed.select("interface_key", whole.alias("words")).withColumn(
        "digest", F.sha2(F.to_json(F.struct("words")).cast("binary"), 256))
    # Words travel once for each class; an API only keeps its digest.
    classes = signed.groupBy("digest").agg(F.first("words").alias("words"), F.count("*").alias("weight"))
    numbered = classes.withColumn("class_id", F.monotonically_increasing_id())
    return Classes(places, cut_lineage(numbered, "classes"), signed.select("interface_key", "digest"))


def _bitmaps(classes: DataFrame) -> DataFrame:
    """``pos, block, bits``: which classes of a block ship in a release; every class ships ``EVERYWHERE``."""
    inside = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("one.bits", i) == 1)
    shipped = classes.select("class_id", F.explode("words").alias("one")).select(
        "class_id", (F.col("one.word") * WORD).alias("base"), F.explode(inside).alias("at")
    ).select("class_id", (F.col("base") + F.col("at")).alias("pos"))
    every = shipped.unionByName(classes.select("class_id", F.lit(EVERYWHERE).cast("bigint").alias("pos")))
    keys, bits = _bits("pos", at="class_id")
    return every.groupBy(*keys).agg(bits).withColumnRenamed("word", "block")


def _weights(classes: DataFrame) -> DataFrame:
    """For each block, bit planes of its classes' weights."""
    ones = F.filter(F.sequence(F.lit(0), F.lit(WORD - 2)), lambda i: F.getbit("weight", i) == 1)
    keys, bits = _bits("plane", at="class_id")
    planes = classes.select("class_id", F.explode(ones).alias("plane")).groupBy(*keys).agg(bits)
    return planes.groupBy(F.col("word").alias("block")).agg(  # at most 63 planes
        F.collect_list(F.struct("plane", "bits")).alias("planes"))


def long_roles(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, side, release_key)`` of measures whose sides are arrays of release keys."""
    return reduce(DataFrame.unionByName, [
        measures.select(*keys, F.lit(side).alias("side"), F.explode(side).alias("release_key")) for side in SIDES])


def headers(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, needs_some)``: whether one of ``any_of`` must ship."""
    return measures.select(*keys, F.col(ANY).isNotNull().alias("needs_some"))


def hits(header: DataFrame, roles: DataFrame, keys: list[str], known: Classes) -> DataFrame:
    """``(*keys, block, hit)``: the classes of a block that meet a measure, where there are any."""
    placed = roles.join(known.places, "release_key").select(*keys, "side", "pos").distinct()
    sizes = placed.groupBy(*keys).agg(F.count_if(F.col("side") == ALL).alias("n_all"))
    wanted = header.join(sizes, keys, "left").withColumn("n_all", F.coalesce("n_all", F.lit(0)))
    free = wanted.where("n_all = 0 AND NOT needs_some").select(
        *keys, F.lit(ALL).alias("side"), F.lit(EVERYWHERE).cast("bigint").alias("pos"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = placed.unionByName(free).withColumn("salt", salt)
    bitmaps = _bitmaps(known.classes).withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int"))
    side, bits = F.col("side"), F.col("bits")
    met = asked.join(bitmaps, ["pos", "salt"]).groupBy(*keys, "block").agg(
        F.count_if(side == ALL).alias("got_all"),
        *[fold(F.when(side == s, bits)).alias(s) for s, fold in ((ALL, F.bit_and), (NONE, F.bit_or), (ANY, F.bit_or))],
    )
    required = F.when(F.col("n_all") > 0, F.when(F.col("got_all") == F.col("n_all"), F.col(ALL)).otherwise(F.lit(0))
                      ).when(F.col("needs_some"), F.lit(-1)).otherwise(F.col(ALL))
    some = F.when(F.col("needs_some"), F.coalesce(ANY, F.lit(0))).otherwise(F.lit(-1))
    hit = required.bitwiseAND(some).bitwiseAND(F.bitwise_not(F.coalesce(F.col(NONE), F.lit(0).cast("bigint"))))
    return met.join(wanted, keys).select(*keys, "block", F.coalesce(hit, F.lit(0)).alias("hit")).where("hit != 0")


def matching_classes(header: DataFrame, roles: DataFrame, keys: list[str], known: Classes) -> DataFrame:
    """``(*keys, class_id)`` for every class that meets a measure."""
    inside = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("hit", i) == 1)
    found = hits(header, roles, keys, known).select(*keys, (F.col("block") * WORD).alias("base"), F.explode(inside).alias("at"))
    return found.select(*keys, (F.col("base") + F.col("at")).alias("class_id"))


def expanded(found: DataFrame, known: Classes) -> DataFrame:
    """Rows with ``class_id`` for each API of the class."""
    return found.join(known.classes.select("class_id", "digest"), "class_id").join(known.signed, "digest")


def shipped_counts(known: Classes, in_view: DataFrame) -> DataFrame:
    """``class_id, shipped``: how many of the releases in view (``release_key``) ship a class."""
    view = in_view.select("release_key").distinct().join(known.places, "release_key")
    keys, bits = _bits(at="pos")
    words = view.groupBy(*keys).agg(bits.alias("seen"))
    own = known.classes.select("class_id", F.explode("words").alias("one")).select("class_id", "one.*").join(words, "word")
    found = own.groupBy("class_id").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("seen")))).alias("shipped"))
    return known.classes.select("class_id").join(found, "class_id", "left").select(
        "class_id", F.coalesce("shipped", F.lit(0)).cast("bigint").alias("shipped"))


def matching(
    header: DataFrame, roles: DataFrame, keys: Sequence[str], releases: DataFrame, apis: DataFrame, junction: DataFrame,
) -> DataFrame:
    """Like ``matches``, for measures given as headers and long roles."""
    keys = list(keys)
    known = signature_classes(releases, apis, junction)
    found = matching_classes(header, roles, keys, known)
    return expanded(found, known).select(*keys, "interface_key")


def counted(
    header: DataFrame, roles: DataFrame, keys: Sequence[str], releases: DataFrame, apis: DataFrame, junction: DataFrame,
) -> DataFrame:
    """Like ``counts``, for measures given as headers and long roles."""
    keys = list(keys)
    known = signature_classes(releases, apis, junction)
    weighed = F.aggregate(
        "planes", F.lit(0).cast("bigint"), lambda total, p: total + F.call_function(
            "shiftleft", F.bit_count(p["bits"].bitwiseAND(F.col("hit"))).cast("bigint"), p["plane"]))
    found = hits(header, roles, keys, known).join(_weights(known.classes), "block")
    return found.groupBy(*keys).agg(F.sum(weighed).alias("value"))


def matches(
    measures: DataFrame, keys: Sequence[str], releases: DataFrame, apis: DataFrame, junction: DataFrame
) -> DataFrame:
    """``(*keys, interface_key)`` for every match.

    Facts of releases or APIs that are not listed don't count, and releases that a measure names
    without their being listed ask for nothing. A measure without any condition on releases that
    must ship lists every API but those its ``none_of`` excludes.
    """
    return matching(headers(measures, keys), long_roles(measures, keys), keys, releases, apis, junction)


def counts(
    measures: DataFrame, keys: Sequence[str], releases: DataFrame, apis: DataFrame, junction: DataFrame
) -> DataFrame:
    """``(*keys, value)`` for measures that match anything; the others are missing."""
    return counted(headers(measures, keys), long_roles(measures, keys), keys, releases, apis, junction)


def with_counts(measures: DataFrame, keys: Sequence[str], counted: DataFrame) -> DataFrame:
    """Measures with their value; no match is zero."""
    keys = list(keys)
    return measures.join(counted, keys, "left").withColumn(
        "value", F.coalesce("value", F.lit(0)).cast("long")
    )
