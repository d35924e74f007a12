"""Keyed set operations. Identity is the key; every result keeps the primary's row.

All of them are equality joins on the key, so a chain over several secondaries keeps
one hash partitioning of the primary, and the planner may broadcast a secondary it
knows to be small or split a hot key at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Decider = Callable[[Column, Column], Column]


def _as_list(frames: DataFrame | Sequence[DataFrame]) -> list[DataFrame]:
    return [frames] if isinstance(frames, DataFrame) else list(frames)


def set_minus(
    primary: DataFrame, secondary: DataFrame | Sequence[DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Rows whose key is in none of the secondaries."""
    keys = list(keys)
    return reduce(
        lambda left, right: left.join(right.select(*keys), keys, "left_anti"),
        _as_list(secondary), primary,
    )


def intersect(
    primary: DataFrame, secondary: DataFrame | Sequence[DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Rows whose key is in every secondary."""
    keys = list(keys)
    return reduce(
        lambda left, right: left.join(right.select(*keys), keys, "left_semi"),
        _as_list(secondary), primary,
    )


def filter_by_lookup(
    primary: DataFrame,
    secondary: DataFrame | Sequence[DataFrame],
    keys: Sequence[str],
    decider: Decider,
) -> DataFrame:
    """Keep rows for which ``decider(original, found)`` holds.

    ``found`` is the secondary's row with the same key, or null. Secondaries are tables,
    hence unique by key. Several secondaries cascade from left to right.
    """
    keys, columns = list(keys), primary.columns

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        found = right.select(*keys, F.struct(*[F.col(c) for c in right.columns]).alias("found__"))
        original = F.struct(*[F.col(c) for c in columns])
        return (
            left.join(found, keys, "left")
            .where(decider(original, F.col("found__")))
            .select(*columns)
        )

    return reduce(step, _as_list(secondary), primary)


def diff_only(
    primary: DataFrame, secondary: DataFrame | Sequence[DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Rows that are new, or differ in any value, against every secondary."""
    columns = primary.columns
    aligned = [frame.select(*columns) for frame in _as_list(secondary)]
    return filter_by_lookup(
        primary, aligned, keys, lambda original, found: ~original.eqNullSafe(found)
    )


def union_by_key(*sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by key in which the leftmost source's row wins."""
    if not sources:
        raise ValueError("an empty union has no schema; pass at least one table")
    keys = list(keys)
    result, seen = sources[0], sources[0].select(*keys)
    for source in sources[1:]:
        result = result.unionByName(set_minus(source, seen, keys))
        seen = seen.unionByName(source.select(*keys))
    return result


def find(table: DataFrame, key: dict[str, object]) -> DataFrame:
    """Point lookup: the row with this key, or no row."""
    return table.where(reduce(Column.__and__, [F.col(k) == v for k, v in key.items()])).limit(1)


def union_find(*sources: DataFrame, key: dict[str, object]) -> DataFrame:
    """Point lookup over a union; filters each source before the union is formed."""
    hits = [find(source, key) for source in sources]
    return union_by_key(*hits, keys=list(key))


def upsert(puts: DataFrame, keys: Sequence[str], sequence: Sequence[Column | str]) -> DataFrame:
    """Last write per key, by ``sequence`` ascending.

    A partial aggregate rather than a window: a key with most of the rows shrinks to
    one row per task before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in puts.columns if c not in keys]
    order = F.struct(*[F.col(s) if isinstance(s, str) else s for s in sequence])
    last = F.max_by(F.struct(*rest), order).alias("last__")
    return puts.groupBy(*keys).agg(last).select(*keys, "last__.*").select(*puts.columns)
