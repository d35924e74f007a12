"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with an oracle unless there is none."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def joined(col: Column | str) -> Column:
    """An array as one comma-separated string, for comparison across engines."""
    values = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


# The derived compat data set in SQL, matching ``bindings.py``.
BOUND = """
WITH shipped AS (
  SELECT DISTINCT l_partkey, l_returnflag AS browser_name,
    CAST(year(l_shipdate) AS VARCHAR) AS browser_version,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'OSX'
         WHEN l_returnflag = 'R' THEN 'Android'
         WHEN l_linestatus = 'O' THEN 'Windows'
         WHEN l_linenumber % 2 = 0 THEN 'OSX' ELSE 'Android' END AS os_name,
    '10' AS os_version,
    make_date(year(l_shipdate),
      CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE 7 END, 1) AS release_date
  FROM lineitem),
all_releases AS (
  SELECT DISTINCT browser_name, browser_version, os_name, os_version, release_date,
    concat_ws('_', browser_name, browser_version, os_name, os_version) AS release_key
  FROM shipped),
ordered_releases AS (
  SELECT *, row_number() OVER (ORDER BY release_date, browser_name, browser_version, os_name,
    os_version) - 1 AS pos FROM all_releases),
releases AS (SELECT * FROM all_releases WHERE os_name NOT IN ('Android', 'iPhone')),
apis AS (
  SELECT p_partkey, replace(p_brand, '#', '') AS interface_name,
    lower(p_type) || '_' || p_partkey AS api_name,
    replace(p_brand, '#', '') || '#' || lower(p_type) || '_' || p_partkey AS interface_key
  FROM part),
junction AS (
  SELECT DISTINCT concat_ws('_', browser_name, browser_version, os_name, os_version) AS release_key,
    interface_key
  FROM shipped JOIN apis ON l_partkey = p_partkey)
"""

# Release timelines, roles and metric values on top of ``BOUND``.
TIMELINE = BOUND + """,
dates AS (SELECT DISTINCT release_date AS date FROM releases),
latest AS (
  SELECT date, browser_name, os_name, release_key FROM (
    SELECT d.date, r.*, row_number() OVER (PARTITION BY d.date, r.browser_name
      ORDER BY (r.os_name = 'Windows') DESC, r.release_date DESC, r.release_key) AS nth
    FROM dates d JOIN releases r ON r.release_date <= d.date) WHERE nth = 1),
points AS (
  SELECT * FROM latest WHERE date IN (
    SELECT date FROM latest GROUP BY date
    HAVING count(*) = (SELECT count(DISTINCT browser_name) FROM releases))),
own AS (
  SELECT p.date, p.browser_name, p.release_key AS point_key, r.release_key, r.release_date,
    CAST(p.date - INTERVAL 1 YEAR AS DATE) AS start
  FROM points p JOIN releases r
    ON r.browser_name = p.browser_name AND r.os_name = p.os_name AND r.release_date <= p.date),
grace_compared AS (
  SELECT p.date, p.browser_name, o.release_key, o.release_date
  FROM points p JOIN own o ON o.date = p.date AND o.browser_name <> p.browser_name
  WHERE o.release_date >= o.start),
grace_previous AS (
  SELECT date, browser_name, release_key, release_date FROM own
  WHERE release_date < date AND release_date >= start),
all_previous AS (
  SELECT date, browser_name, release_key, release_date FROM own WHERE release_date < date),
before_grace AS (
  SELECT date, browser_name, release_key, release_date, row_number() OVER (
    PARTITION BY date, browser_name ORDER BY release_date DESC, release_key) AS nth
  FROM own WHERE release_date < start),
current_others AS (
  SELECT p.date, p.browser_name, o.release_key
  FROM points p JOIN points o ON o.date = p.date AND o.browser_name <> p.browser_name),
removal_points AS (
  SELECT date, browser_name FROM points p
  WHERE (SELECT count(*) FROM before_grace b
         WHERE b.date = p.date AND b.browser_name = p.browser_name) >= 2
    AND (SELECT count(*) FROM current_others c
         WHERE c.date = p.date AND c.browser_name = p.browser_name) <> 1),
measures AS (
  SELECT 'BROWSER_SPECIFIC' AS type, browser_name, date, release_key AS release FROM points
  UNION ALL SELECT 'LONE_OMISSION', browser_name, date, release_key FROM points
  UNION ALL SELECT 'LONE_REMOVAL', p.browser_name, p.date, b.release_key
    FROM removal_points p JOIN before_grace b
      ON b.date = p.date AND b.browser_name = p.browser_name AND b.nth = 1),
role_rows AS (
  SELECT 'BROWSER_SPECIFIC' AS type, browser_name, date, release_key, 'all' AS role FROM points
  UNION SELECT 'BROWSER_SPECIFIC', browser_name, date, release_key, 'all' FROM grace_previous
  UNION SELECT 'BROWSER_SPECIFIC', browser_name, date, release_key, 'none' FROM grace_compared
  UNION SELECT 'LONE_OMISSION', browser_name, date, release_key, 'all' FROM grace_compared
  UNION SELECT 'LONE_OMISSION', browser_name, date, release_key, 'none' FROM all_previous
  UNION SELECT 'LONE_OMISSION', browser_name, date, release_key, 'none' FROM points
  UNION SELECT 'LONE_REMOVAL', browser_name, date, release_key, 'all'
    FROM current_others JOIN removal_points USING (browser_name, date)
  UNION SELECT 'LONE_REMOVAL', browser_name, date, release_key, 'none'
    FROM points JOIN removal_points USING (browser_name, date)
  UNION SELECT 'LONE_REMOVAL', browser_name, date, release_key,
      CASE WHEN nth = 1 THEN 'none' ELSE 'any' END
    FROM before_grace JOIN removal_points USING (browser_name, date)),
needs AS (
  SELECT type, browser_name, date, count(*) FILTER (WHERE role = 'all') AS n_all,
    count(*) FILTER (WHERE role = 'any') AS n_any
  FROM role_rows GROUP BY ALL),
matches AS (
  SELECT n.type, n.browser_name, n.date, a.interface_key
  FROM needs n CROSS JOIN apis a
  LEFT JOIN (
    SELECT type, browser_name, date, interface_key,
      count(*) FILTER (WHERE role = 'all') AS got_all,
      count(*) FILTER (WHERE role = 'none') AS got_none,
      count(*) FILTER (WHERE role = 'any') AS got_any
    FROM role_rows JOIN junction USING (release_key) GROUP BY ALL) h
    ON h.type = n.type AND h.browser_name = n.browser_name AND h.date = n.date
      AND h.interface_key = a.interface_key
  WHERE coalesce(h.got_all, 0) = n.n_all AND coalesce(h.got_none, 0) = 0
    AND (n.n_any = 0 OR coalesce(h.got_any, 0) > 0)),
metric_values AS (
  SELECT m.type, m.browser_name, m.date, m.release, count(x.interface_key) AS value
  FROM measures m LEFT JOIN matches x
    ON x.type = m.type AND x.browser_name = m.browser_name AND x.date = m.date
  GROUP BY ALL)
"""

# Consecutive releases of each browser's preferred system, and their API counts.
COUNTS = BOUND + """,
chosen AS (
  SELECT r.* FROM releases r JOIN (
    SELECT browser_name, CASE WHEN bool_or(os_name = 'Windows') THEN 'Windows'
      ELSE first(os_name ORDER BY release_date, release_key) END AS os_name
    FROM releases GROUP BY browser_name) USING (browser_name, os_name)),
pairs AS (
  SELECT browser_name, release_date, release_key AS curr_release,
    lag(release_key) OVER (PARTITION BY browser_name ORDER BY release_date, release_key) AS prev_release
  FROM chosen),
api_counts AS (
  SELECT p.browser_name, p.release_date, p.curr_release, p.prev_release,
    (SELECT count(*) FROM junction j WHERE j.release_key = p.curr_release) AS total_apis,
    CASE WHEN p.prev_release IS NULL THEN 0 ELSE (
      SELECT count(*) FROM junction j WHERE j.release_key = p.curr_release AND NOT EXISTS (
        SELECT 1 FROM junction k WHERE k.release_key = p.prev_release
          AND k.interface_key = j.interface_key)) END AS new_apis,
    (SELECT count(*) FROM junction j WHERE j.release_key = p.prev_release AND NOT EXISTS (
        SELECT 1 FROM junction k WHERE k.release_key = p.curr_release
          AND k.interface_key = j.interface_key)) AS removed_apis
  FROM pairs p)
"""
