"""Table schemas. Keys are in the comments; booleans are never null."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DateType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# key: release_key = browser_version_os_osversion
RELEASES = _schema(
    ("browser_name", S), ("browser_version", S), ("os_name", S), ("os_version", S),
    ("release_date", D),
)
# key: interface_key = interface#api
APIS = _schema(("interface_name", S), ("api_name", S))
# key: both columns
JUNCTION = _schema(("release_key", S), ("interface_key", S))
# key: column_name
COMPAT_COLUMNS = _schema(("pos", I), ("column_name", S), ("label", S), ("release_key", S)).add(
    "release", RELEASES
)
# key: (browser_name, release_date)
API_COUNTS = _schema(
    ("browser_name", S), ("release_date", D), ("curr_release", S), ("prev_release", S),
    ("total_apis", L), ("new_apis", L), ("removed_apis", L),
)
# key: (type, browser_name, date)
BROWSER_METRICS = _schema(
    ("type", S), ("browser_name", S), ("date", D), ("release", S),
    ("prev_releases", T.ArrayType(S)), ("compared_releases", T.ArrayType(S)), ("value", L),
)
# key: (browser_name, version_prefix)
VERSION_HISTORY = _schema(
    ("browser_name", S), ("version_prefix", S), ("release_date", D), ("rank", L),
)

BROWSER_SPECIFIC = "BROWSER_SPECIFIC"
LONE_OMISSION = "LONE_OMISSION"
LONE_REMOVAL = "LONE_REMOVAL"
API_COUNT = "API_COUNT"
METRIC_TYPES = (BROWSER_SPECIFIC, LONE_OMISSION, LONE_REMOVAL)
