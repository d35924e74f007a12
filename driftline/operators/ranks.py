"""Positions in a global order, without a window over the whole table.

The table is sorted by ranges and written; each row keeps its range and its place in it, and a
position is that place plus the rows of all ranges before. The written table is an index as well: a
page, however deep, is read from the ranges that hold it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import cut_lineage

#: Bits of a generated id that count the rows of a range.
PLACES = 33


class Ranked(NamedTuple):
    """A sorted table, the name of its column of range and place, and the rows before each range."""

    table: DataFrame
    place: str
    before: list[int]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.table.columns if c != self.place]

    def _own(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns]

    def position(self) -> Column:
        place = F.col(self.place)
        start = F.element_at(F.lit(self.before).cast("array<bigint>"), F.shiftright(place, PLACES).cast("int") + 1)
        return start + place.bitwiseAND(F.lit((1 << PLACES) - 1))

    def numbered(self, name: str = "pos") -> DataFrame:
        """All rows with their position, from 0."""
        return self.table.select(*self._own(), self.position().alias(name))

    def page(self, skip: int, size: int, name: str | None = None) -> DataFrame:
        """Rows at positions ``skip`` to ``skip + size - 1``, in order; other ranges aren't read."""
        wanted = F.lit(False)
        for range_, (start, stop) in enumerate(zip(self.before, self.before[1:], strict=False)):
            low, high = max(skip, start) - start, min(skip + size, stop) - start
            if low < high:
                wanted |= F.col(self.place).between((range_ << PLACES) + low, (range_ << PLACES) + high - 1)
        position = [] if name is None else [self.position().alias(name)]
        return self.table.where(wanted).orderBy(self.place).select(*self._own(), *position)


def ranked(rows: DataFrame, *order: Column | str, label: str = "ranked") -> Ranked:
    """``rows`` in the given order, which should leave no ties: tied rows share a range.

    The driver holds one number for each range, of which there are as many as shuffle partitions.
    """
    place = "place"
    while place in rows.columns:
        place += "_"
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = cut_lineage(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()),
        label,
    )
    sizes = {r["range"]: r["n"] for r in table.groupBy(F.shiftright(place, PLACES).alias("range")).agg(
        F.count("*").alias("n")).collect()}
    before = [0]
    for range_ in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(range_, 0))
    return Ranked(table, place, before)
