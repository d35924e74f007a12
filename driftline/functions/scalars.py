"""Column expressions: identities, names, dates and array helpers. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WebKit build prefix -> marketing version, by browser.
FRIENDLY_VERSIONS = {
    "Safari": {
        "534": "5.1", "536": "6.0", "537.43": "6.1", "537.71": "7.0", "537.73": "7.0",
        "537.75": "7.0", "537.76": "7.0", "537.77": "7.0", "537.78": "7.0", "537.85": "7.1",
        "538": "8.0", "600": "8.0", "601.1": "9.0", "601.2": "9.0", "601.3": "9.0",
        "601.4": "9.0", "601.5": "9.1", "601.6": "9.1", "601.7": "9.1", "602": "10.0",
        "603": "10.1",
    },
}
# Operating systems counted as mobile.
MOBILE_SYSTEMS = ("Android", "iPhone")

RELEASE_PARTS = ("browser_name", "browser_version", "os_name", "os_version")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def release_key(prefix: str = "") -> Column:
    return F.concat_ws("_", *[F.col(prefix + part) for part in RELEASE_PARTS])


def is_mobile(os_name: Column | str = "os_name") -> Column:
    return F.coalesce(_c(os_name).isin(*MOBILE_SYSTEMS), F.lit(False))


def interface_key(
    interface: Column | str = "interface_name", api: Column | str = "api_name"
) -> Column:
    return F.concat_ws("#", _c(interface), _c(api))


def split_interface_key(key: Column | str) -> Column:
    """``struct(interface_name, api_name)``; fails unless there are exactly two parts."""
    parts = F.split(_c(key), "#")
    bad = F.raise_error(F.concat(F.lit("malformed interface key: "), _c(key)))
    return F.when(
        F.size(parts) == 2,
        F.struct(parts[0].alias("interface_name"), parts[1].alias("api_name")),
    ).otherwise(bad)


def interface_of(key: Column | str) -> Column:
    return F.substring_index(_c(key), "#", 1)


def api_of(key: Column | str) -> Column:
    return F.regexp_replace(_c(key), "^[^#]*#", "")


def friendly_browser_version(
    browser: Column | str = "browser_name", version: Column | str = "browser_version"
) -> Column:
    """Marketing version by the shortest dotted prefix that the lookup knows."""
    browser, version = _c(browser), _c(version)
    result = version
    for name, lookup in FRIENDLY_VERSIONS.items():
        depth = max(prefix.count(".") for prefix in lookup) + 1
        table = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
        hits = [
            F.try_element_at(table, F.substring_index(version, ".", parts))
            for parts in range(1, depth + 1)
        ]
        result = F.when(browser == name, F.coalesce(*hits, version)).otherwise(result)
    return result


def _lower_first(col: Column) -> Column:
    return F.concat(F.lower(F.substring(col, 1, 1)), F.substr(col, F.lit(2)))


def column_name(prefix: str = "") -> Column:
    """Wide-table column of a release, e.g. ``safari5_1_5oSX10_7_5``."""
    browser, version, os_name, os_version = [F.col(prefix + part) for part in RELEASE_PARTS]
    joined = F.concat(_lower_first(browser), version, _lower_first(os_name), os_version)
    return F.regexp_replace(joined, "[^a-zA-Z0-9]", "_")


def column_label(prefix: str = "") -> Column:
    return F.concat_ws(" ", *[F.col(prefix + part) for part in RELEASE_PARTS])


def terse_release_id(key: Column | str) -> Column:
    """Short search form of a release key, e.g. ``bet54.1old15.0``."""
    key = _c(key)
    parts = F.split(F.lower(key), "_")
    terse = F.concat(
        F.substring(parts[0], 1, 3),
        F.substring_index(parts[1], ".", 2),
        F.substring(parts[2], 1, 3),
        F.substring_index(parts[3], ".", 2),
    )
    bad = F.raise_error(F.concat(F.lit("unexpected release key: "), key))
    return F.when(F.size(parts) == 4, terse).otherwise(bad)


def one_year_before(day: Column | str) -> Column:
    """Same day of the previous year; 29 February becomes 1 March."""
    day = _c(day)
    first = F.make_date(F.year(day) - 1, F.month(day), F.lit(1))
    return F.date_add(first, F.dayofmonth(day) - 1)


def epoch_ms(day: Column | str) -> Column:
    """Milliseconds since 1970 of a day, whatever the session's time zone."""
    return F.unix_date(_c(day).cast("date")).cast("long") * 86_400_000


def truthy(col: Column | str, kind: T.DataType) -> Column:
    """Truth of a value: null, false, zero, NaN and the empty string are false."""
    col = _c(col)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce((col != 0) & ~F.isnan(col), F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(col != 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(col != "", F.lit(False))
    return col.isNotNull()


def array_count(arr: Column | str, predicate: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(_c(arr), predicate)).cast("long")


def seq(*cols: Column | str) -> Column:
    return F.array(*[_c(col) for col in cols])


def known_positions(columns: Sequence, wanted: Sequence) -> list[int]:
    """Positions of the wanted columns; unknown ones are left out."""
    return [list(columns).index(col) for col in wanted if col in columns]


def extract_cols(data: Column | str, positions: Sequence[int]) -> Column:
    """The chosen elements of a grid row, in the order given."""
    if not positions:
        return F.slice(_c(data), 1, 0)
    return F.array(*[F.get(_c(data), F.lit(pos)) for pos in positions])


def col_index_of(columns: Column | str, wanted: Column | str) -> Column:
    """Zero-based position by value equality, -1 when absent."""
    return (F.array_position(_c(columns), _c(wanted)) - 1).cast("long")
