"""Streams over the event files, drained and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline import streaming
from driftline.operators.sets import upsert
from driftline.plans.bindings import SCHEMAS, table
from driftline.plans.registry import query
from driftline.session import fresh_path

COLUMNS = ["event_id", "user_id", "event_type", "value"]
KNOWN_SQL = "(SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 85)"


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = SCHEMAS["events"].format(time="TIMESTAMP_NTZ")
    return streaming.file_stream(spark, folder, "events.parquet", schema)


def _known(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.where("event_type = 'purchase' AND value > 85").select("user_id").distinct()


def _drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    return streaming.drain(stream, fresh_path(spark, label), fresh_path(spark, f"{label}-progress"))


EVENT_SQL = "SELECT event_id, user_id, event_type, value FROM events WHERE "


@query(EVENT_SQL + "user_id NOT IN " + KNOWN_SQL)
def stream_minus(spark: SparkSession, folder: str) -> DataFrame:
    events = _stream(spark, folder).select(*COLUMNS)
    return _drained(spark, streaming.stream_minus(events, _known(spark, folder), ["user_id"]), "minus")


@query(EVENT_SQL + "user_id IN " + KNOWN_SQL)
def stream_intersect(spark: SparkSession, folder: str) -> DataFrame:
    events = _stream(spark, folder).select(*COLUMNS)
    return _drained(spark, streaming.stream_intersect(events, _known(spark, folder), ["user_id"]), "both")


@query(EVENT_SQL + "event_type = 'purchase' OR (event_type IS DISTINCT FROM 'purchase' AND user_id NOT IN " + KNOWN_SQL + ")")
def stream_union(spark: SparkSession, folder: str) -> DataFrame:
    events = _stream(spark, folder).select(*COLUMNS)
    union = streaming.stream_union(
        events.where("event_type = 'purchase'"), events.where("NOT event_type <=> 'purchase'"),
        _known(spark, folder), ["user_id"])
    return _drained(spark, union, "union")


LAST_SQL = """(SELECT user_id, event_id, event_type, value FROM events {}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query("SELECT user_id, event_id, event_type, value FROM " + LAST_SQL.format(""))
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A copy that starts from the views and follows the stream of all events."""
    keys, sequence = ["user_id"], ["ts", "event_id"]
    path = fresh_path(spark, "copy")
    events = table(spark, folder, "events")
    streaming.start_copy(events.where("event_type = 'view'"), path, keys, sequence)
    progress = fresh_path(spark, "copy-progress")
    streaming.stream_upsert(_stream(spark, folder), path, keys, sequence, progress).awaitTermination()
    copy = streaming.read_copy(spark, path, events.schema, keys, sequence)
    return copy.select("user_id", "event_id", "event_type", "value")


@query("""SELECT e.event_id, e.user_id, e.event_type, e.value FROM events e
  LEFT JOIN """ + LAST_SQL.format("WHERE event_type <> 'error'") + """ s USING (user_id)
  WHERE s.user_id IS NULL OR e.event_id <> s.event_id OR e.event_type <> s.event_type OR e.value <> s.value""")
def stream_diff_only(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where("event_type <> 'error'")
    last = upsert(events, ["user_id"], ["ts", "event_id"]).select(*COLUMNS)
    stream = _stream(spark, folder).select(*COLUMNS)
    return _drained(spark, streaming.stream_diff_only(stream, last, ["user_id"]), "diff")
