"""Support signatures: for each API, the set of releases that ship it, as bit words.

Most questions on the catalog ask which of a handful of releases ship an API. Folding
the junction to one row of words per API answers all of them after a single shuffle,
and that shuffle moves partial words, not junction rows: neither a release nor an API
that holds most of the junction becomes a hot task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from driftline.functions import column_label, column_name, release_key

WORD = 64
# Up to this size the dimension stays in one partition, and its windows, groups and joins
# need no shuffle.
TINY = 512
RELEASE_ORDER = ("release_date", "browser_name", "browser_version", "os_name", "os_version")


def with_release_key(releases: DataFrame) -> DataFrame:
    return releases.withColumn("release_key", release_key())


@dataclass(frozen=True)
class ReleaseIndex:
    """The ordered releases that a table is to have columns for: position = bit.

    Tables, grids, exports and searches name their releases one by one, so the driver holds those
    that are passed in. Metrics, drill-downs and timelines take releases as tables, of any size.
    """

    spark: SparkSession
    rows: tuple[Row, ...]

    @classmethod
    def build(cls, releases: DataFrame) -> ReleaseIndex:
        ordered = (
            releases.select(
                "browser_name", "browser_version", "os_name", "os_version", "release_date",
                release_key().alias("release_key"), column_name().alias("column_name"),
                column_label().alias("label"),
            )
            .distinct()
            .orderBy(*RELEASE_ORDER)
        )
        return cls(releases.sparkSession, tuple(ordered.collect()))

    @cached_property
    def keys(self) -> list[str]:
        return [row.release_key for row in self.rows]

    @cached_property
    def position(self) -> dict[str, int]:
        return {key: pos for pos, key in enumerate(self.keys)}

    @property
    def n_words(self) -> int:
        return max(1, -(-len(self.rows) // WORD))

    @cached_property
    def frame(self) -> DataFrame:
        """The dimension as a local relation: ``pos``, the release parts and names."""
        names = ["pos", "browser_name", "browser_version", "os_name", "os_version",
                 "release_date", "release_key", "column_name", "label"]
        kinds = [pa.int32(), *[pa.string()] * 4, pa.date32(), *[pa.string()] * 3]
        values = [(pos, *row) for pos, row in enumerate(self.rows)]
        columns = [
            pa.array([v[i] for v in values], type=kind) for i, kind in enumerate(kinds)
        ]
        local = self.spark.createDataFrame(pa.table(columns, names=names))
        return local.coalesce(1) if len(self.rows) <= TINY else local

    def mask(self, keys: Iterable[str]) -> list[int]:
        """Bit words of a set of release keys, as signed 64-bit numbers."""
        words = [0] * self.n_words
        for key in keys:
            pos = self.position[key]
            words[pos // WORD] |= 1 << (pos % WORD)
        return [w - (1 << WORD) if w >= 1 << (WORD - 1) else w for w in words]


def bit(pos: Column) -> Column:
    return F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod(pos, F.lit(WORD)).cast("int")
    )


def _bit_in_word(pos: Column, word: int) -> Column:
    inside = (pos >= word * WORD) & (pos < (word + 1) * WORD)
    return F.when(inside, bit(pos)).otherwise(F.lit(0).cast("bigint"))


def word_columns(n_words: int) -> list[str]:
    return [f"w{i}" for i in range(n_words)]


def signatures(
    apis: DataFrame, junction: DataFrame, index: ReleaseIndex, strict: bool = False
) -> DataFrame:
    """``interface_key, w0, w1, …``: one row per API, unshipped APIs included.

    Junction rows of releases outside the index are ignored, unless ``strict``: then an
    unknown release, like an API missing from ``apis``, is an error.
    """
    names = word_columns(index.n_words)
    positions = index.frame.select("release_key", "pos")
    support = junction.join(positions, "release_key", "left" if strict else "inner")
    pos = F.col("pos")
    if strict:
        unknown = F.concat(F.lit("unknown release: "), F.col("release_key"))
        pos = F.when(pos.isNull(), F.raise_error(unknown)).otherwise(pos)
    support = support.select("interface_key", pos.alias("pos"), F.lit(False).alias("known"))
    listed = apis.select(
        "interface_key", F.lit(None).cast("int").alias("pos"), F.lit(True).alias("known")
    )
    words = [F.bit_or(_bit_in_word(F.col("pos"), i)).alias(name) for i, name in enumerate(names)]
    result = (
        listed.unionByName(support)
        .groupBy("interface_key")
        .agg(*words, F.max("known").alias("known"))
    )
    if strict:
        missing = F.raise_error(F.concat(F.lit("unknown API: "), F.col("interface_key")))
        key = F.when(~F.col("known"), missing).otherwise(F.col("interface_key"))
        return result.select(key.alias("interface_key"), *names)
    return result.where("known").select("interface_key", *names)


def ships(index: ReleaseIndex, pos: int) -> Column:
    """Whether the API ships in the release at ``pos``."""
    word = F.col(f"w{pos // WORD}")
    return F.getbit(word, F.lit(pos % WORD)) == 1


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def ships_all(mask: Sequence[int]) -> Column:
    return _all([
        F.col(f"w{i}").bitwiseAND(F.lit(m).cast("bigint")) == m for i, m in enumerate(mask) if m
    ])


def ships_none(mask: Sequence[int]) -> Column:
    return _all([
        F.col(f"w{i}").bitwiseAND(F.lit(m).cast("bigint")) == 0 for i, m in enumerate(mask) if m
    ])


def ships_count(mask: Sequence[int]) -> Column:
    counts = [
        F.bit_count(F.col(f"w{i}").bitwiseAND(F.lit(m).cast("bigint"))).cast("bigint")
        for i, m in enumerate(mask) if m
    ]
    return reduce(Column.__add__, counts, F.lit(0).cast("bigint"))
