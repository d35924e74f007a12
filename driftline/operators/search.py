"""Catalog search: filter specs in Python, evaluated on signature classes, many at a time.

A spec is a nested tuple:

* ``()`` matches everything
* ``("keyword", text)``
* ``("in", browser[, version[, os[, os_version]]])`` ships in all matching releases
* ``("notin", …)`` ships in none of them
* ``("count", n)`` ships in exactly n of the releases in view
* ``("and", spec, …)`` and ``("or", spec, …)``

``search_many`` compiles specs to rows: alternatives that each ask for releases on two sides, for
numbers in view and for parts of names. One division answers the release sides of all of them, by
classes of APIs, and only matching classes are expanded to names. Specs that only ask for names are
answered by the names. ``compile_spec`` gives a single spec as a column on the signatures of named
releases.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import division
from driftline.operators.signature import ReleaseIndex, ships_all, ships_count, ships_none, with_release_key

PARTS = ("browser_name", "browser_version", "os_name", "os_version")


class NoReleasesMatch(ValueError):
    """A release prefix matched nothing."""


def all_of(*tests: Column) -> Column:
    """Every test holds; true if there is none."""
    return reduce(Column.__and__, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    """At least one test holds; false if there is none."""
    return reduce(Column.__or__, tests, F.lit(False))


def prefix_condition(prefixes: Sequence[str | None]) -> Column:
    """Case-insensitive prefix match on the leading parts; missing parts match all."""
    tests = [
        F.startswith(F.lower(F.col(part)), F.lit(prefix.lower()))
        for part, prefix in zip(PARTS, prefixes)
        if prefix
    ]
    return all_of(*tests)


def match_releases(releases: DataFrame, *prefixes: str | None) -> DataFrame:
    return releases.where(prefix_condition(prefixes))


def matching_keys(index: ReleaseIndex, prefixes: Sequence[str | None]) -> list[str]:
    wanted = [(part, prefix.lower()) for part, prefix in zip(PARTS, prefixes) if prefix]
    keys = [
        row.release_key for row in index.rows
        if all(row[part].lower().startswith(prefix) for part, prefix in wanted)
    ]
    if not keys:
        raise NoReleasesMatch("no releases match " + "".join(p for p in prefixes if p))
    return keys


def keyword(text: str, key: str = "interface_key") -> Column:
    return F.contains(F.lower(F.col(key)), F.lit(text.lower()))


def compile_spec(spec: tuple, index: ReleaseIndex, in_view: Iterable[str] = ()) -> Column:
    """The spec as a condition on a signature row."""
    if not spec:
        return F.lit(True)
    kind, *args = spec
    if kind == "keyword":
        return keyword(args[0])
    if kind == "in":
        return ships_all(index.mask(matching_keys(index, args)))
    if kind == "notin":
        return ships_none(index.mask(matching_keys(index, args)))
    if kind == "count":
        return ships_count(index.mask(in_view)) == int(args[0])
    parts = [compile_spec(arg, index, in_view) for arg in args]
    if kind == "and":
        return all_of(*parts)
    if kind == "or":
        return any_of(*parts)
    raise ValueError(f"unknown filter: {kind}")


def search(
    signatures: DataFrame, index: ReleaseIndex, spec: tuple, in_view: Iterable[str] = ()
) -> DataFrame:
    return signatures.where(compile_spec(spec, index, list(in_view)))


class Clause(NamedTuple):
    """What one alternative of a spec asks for; prefixes are tuples of leading release parts."""

    shipped: frozenset[tuple[str, ...]] = frozenset()
    absent: frozenset[tuple[str, ...]] = frozenset()
    counts: frozenset[int] = frozenset()
    keywords: frozenset[str] = frozenset()

    def __and__(self, other: Clause) -> Clause:
        return Clause(*[mine | others for mine, others in zip(self, other, strict=True)])

    @property
    def names_only(self) -> bool:
        return not (self.shipped or self.absent or self.counts)


def clauses(spec: tuple) -> list[Clause]:
    """The alternatives of a spec; none of them holds for an empty ``or``."""
    if not spec:
        return [Clause()]
    kind, *args = spec
    if kind == "keyword":
        return [Clause(keywords=frozenset([args[0].lower()]))]
    if kind in ("in", "notin"):
        prefix = frozenset([tuple((part or "").lower() for part in args)])
        return [Clause(shipped=prefix) if kind == "in" else Clause(absent=prefix)]
    if kind == "count":
        return [Clause(counts=frozenset([int(args[0])]))]
    parts = [clauses(arg) for arg in args]
    if kind == "and":
        return list(dict.fromkeys(reduce(Clause.__and__, chosen, Clause()) for chosen in product(*parts)))
    if kind == "or":
        return list(dict.fromkeys(clause for part in parts for clause in part))
    raise ValueError(f"unknown filter: {kind}")


def prefix_index(releases: DataFrame) -> DataFrame:
    """``prefix, release_key`` and the lower-case release parts: every leading part of the first one."""
    lowered = [F.lower(F.col(part)).alias(part) for part in PARTS]
    known = with_release_key(releases).select("release_key", *lowered).distinct()
    lengths = F.sequence(F.lit(0), F.length(PARTS[0]))
    return known.withColumn("n", F.explode(lengths)).withColumn("prefix", F.expr(f"left({PARTS[0]}, n)")).drop("n")


CLAUSE = ["search", "clause"]


def search_many(
    specs: Mapping[str, tuple], releases: DataFrame, apis: DataFrame, junction: DataFrame,
    in_view: DataFrame | None = None,
) -> DataFrame:
    """``search, interface_key``: what each of the specs finds.

    ``in_view`` (``release_key``) are the releases that ``count`` looks at. A release prefix that
    matches nothing fails the job.
    """
    spark = apis.sparkSession
    compiled = [(name, n, clause) for name, spec in specs.items() for n, clause in enumerate(clauses(spec))]
    by_name = [
        F.struct(F.lit(name).alias("search"), F.array(*[F.lit(k) for k in sorted(c.keywords)]).cast("array<string>").alias("keywords"))
        for name, _, c in compiled if c.names_only
    ]
    has_all = lambda words: F.forall(words, lambda k: F.contains(F.lower("interface_key"), k))
    found = []
    if by_name:
        met = F.filter(F.array(*by_name), lambda c: has_all(c["keywords"]))
        found.append(apis.select("interface_key").distinct().select(F.explode(met).alias("met"), "interface_key").select(
            "met.search", "interface_key"))
    asked = [(name, n, c) for name, n, c in compiled if not c.names_only]
    if asked:
        tests = spark.createDataFrame(
            [(name, n, sorted(c.keywords), sorted(c.counts)) for name, n, c in asked],
            "search string, clause int, keywords array<string>, counts array<bigint>")
        wanted = spark.createDataFrame(
            [(name, n, side, *[*prefix, "", "", "", ""][:4]) for name, n, c in asked
             for side, prefixes in ((division.ALL, c.shipped), (division.NONE, c.absent)) for prefix in sorted(prefixes)],
            "search string, clause int, side string, " + ", ".join(f"p{i} string" for i in range(4)))
        meets = (F.col("p0") == F.col("prefix"))
        for i, part in enumerate(PARTS[1:], 1):
            meets &= F.startswith(F.col(part), F.col(f"p{i}"))
        unknown = F.raise_error(F.concat(F.lit("no releases match "), F.concat_ws("", "p0", "p1", "p2", "p3")))
        roles = wanted.join(prefix_index(releases), meets, "left").select(
            *CLAUSE, "side", F.coalesce("release_key", unknown.cast("string")).alias("release_key"))
        known = division.signature_classes(releases, apis, junction)
        header = tests.select(*CLAUSE, F.lit(False).alias("needs_some"))
        classes = division.matching_classes(header, roles, CLAUSE, known).join(tests, CLAUSE)
        if any(c.counts for _, _, c in asked):
            view = in_view if in_view is not None else known.places.limit(0)
            classes = classes.join(division.shipped_counts(known, view), "class_id").where(
                F.forall("counts", lambda n: n == F.col("shipped")))
        found.append(division.expanded(classes, known).where(has_all(F.col("keywords"))).select("search", "interface_key"))
    if not found:
        return apis.select(F.lit("").alias("search"), "interface_key").limit(0)
    return reduce(DataFrame.unionByName, found).distinct()
