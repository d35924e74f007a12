"""A filter of fixed size that tells which keys are surely not in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22


def maybe_needed(rows: DataFrame, key: Column, needed: DataFrame, needed_key: Column, flag: str) -> DataFrame:
    """``rows`` with a column that is false only if the key is surely not among the needed ones.

    The filter is a bitmap of ``BITS`` bits, half a megabyte, whatever the number of keys; the more
    keys there are, the more rows pass in vain. Rows with a null key pass.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    words = needed.select(bit(needed_key).alias("bit")).groupBy(F.shiftright("bit", 6).alias("filter_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("filter_bits")
    )
    with_bit = rows.withColumns({"filter_key": key, "filter_bit": bit(key)})
    joined = with_bit.join(F.broadcast(words), F.shiftright("filter_bit", 6) == F.col("filter_word"), "left")
    passes = F.coalesce(F.expr("shiftright(filter_bits, cast(filter_bit & 63 as int)) & 1") == 1, F.lit(False))
    return joined.withColumn(flag, F.col("filter_key").isNull() | passes).drop(
        "filter_key", "filter_bit", "filter_word", "filter_bits"
    )


def only_needed(rows: DataFrame, key: Column, needed: DataFrame, needed_key: Column) -> DataFrame:
    """Rows whose key may be among the needed ones, before a join shuffles them."""
    return maybe_needed(rows, key, needed, needed_key, "filter_passes").where("filter_passes").drop("filter_passes")
