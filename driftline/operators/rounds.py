"""Iterations that write every row once, under the round that will use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import bytes_of, fresh_path, too_big_to_send

DUE = "due"


class Rounds:
    """A table that grows by appending, partitioned by the round its rows are due in.

    A round reads its own rows and no others; ``jobs`` counts the writes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.jobs = spark, fresh_path(spark, label), 0
        self.schema: T.StructType | None = None
        self.bytes: dict[int | None, int] = {}

    def add(self, rows: DataFrame, due: int | None = None) -> int:
        """Write rows that are due in one round, or each in its own ``due``; the number of rows."""
        rows = rows if due is None else rows.withColumn(DUE, F.lit(due))
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(bytes_of(rows)).alias("bytes"))
        counted.write.mode("append").partitionBy(DUE).parquet(self.path)
        self.jobs += 1
        if self.schema is None:
            fields = [f for f in rows.schema.fields if f.name != DUE]
            self.schema = T.StructType([*fields, T.StructField(DUE, T.IntegerType())])
        self.bytes[due] = self.bytes.get(due, 0) + (seen.get["bytes"] or 0)
        return seen.get["rows"]

    def table(self) -> DataFrame:
        """All rows so far, with ``due``."""
        return too_big_to_send(self._read(), sum(self.bytes.values()))

    def due(self, round_: int) -> DataFrame:
        size = self.bytes.get(round_, 0) + self.bytes.get(None, 0)
        return too_big_to_send(self._read().where(F.col(DUE) == round_).drop(DUE), size)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def closure(start: DataFrame, step, keys: list[str], label: str) -> DataFrame:
    """``start`` and all that ``step`` leads to; it gets the rows that the last round found.

    Known rows are removed in every round, so that each is followed once.
    """
    rounds = Rounds(start.sparkSession, label)
    found, n = rounds.add(start.select(*keys).distinct(), 0), 0
    while found:
        ahead = step(rounds.due(n)).select(*keys).distinct()
        n += 1
        found = rounds.add(ahead.join(rounds.table().drop(DUE), keys, "left_anti"), n)
    return rounds.table().drop(DUE)
