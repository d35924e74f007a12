"""Timelines, metrics and drill-downs on the derived compat data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import model
from driftline.operators import drilldown, metrics, timeline
from driftline.operators.signature import with_release_key
from driftline.plans import bindings
from driftline.plans.registry import BOUND, COUNTS, TIMELINE, joined, query


def _desktop(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.desktop_only(bindings.releases(spark, folder))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """The desktop releases, each once, with their keys."""
    return with_release_key(metrics.listed_once(_desktop(spark, folder)))


def _facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return bindings.apis(spark, folder), bindings.junction(spark, folder)


def _metric_rows(spark: SparkSession, folder: str, *types: str) -> DataFrame:
    return metrics.browser_metrics(_desktop(spark, folder), *_facts(spark, folder), types)


RELEASE_SQL = "SELECT browser_name, browser_version, os_name, os_version, release_date"


@query(BOUND + RELEASE_SQL + " FROM releases")
def desktop_only(spark: SparkSession, folder: str) -> DataFrame:
    return _desktop(spark, folder)


@query(TIMELINE + "SELECT date FROM dates ORDER BY date")
def release_dates(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.release_dates(_desktop(spark, folder))


@query(TIMELINE + "SELECT date, browser_name, os_name, release_key FROM latest")
def latest_release_asof(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.latest_release_asof(_known(spark, folder))


@query(TIMELINE + "SELECT date, browser_name, os_name, release_key FROM points")
def metric_points(spark: SparkSession, folder: str) -> DataFrame:
    points = timeline.metric_points(_known(spark, folder))
    return points.select("date", "browser_name", "os_name", "release_key")


def _point_list(spark: SparkSession, folder: str, column: str) -> DataFrame:
    points = timeline.metric_points(_known(spark, folder))
    return points.select("date", "browser_name", joined(column).alias("release_keys"))


def _list_sql(name: str, order: str) -> str:
    return TIMELINE + f"""
SELECT p.date, p.browser_name,
  coalesce(string_agg(x.release_key, ',' ORDER BY {order}), '') AS release_keys
FROM points p LEFT JOIN {name} x ON x.date = p.date AND x.browser_name = p.browser_name
GROUP BY ALL"""


@query(_list_sql("grace_compared", "x.release_key"))
def grace_compared(spark: SparkSession, folder: str) -> DataFrame:
    return _point_list(spark, folder, "grace_compared")


@query(_list_sql("grace_previous", "x.release_date, x.release_key"))
def grace_previous(spark: SparkSession, folder: str) -> DataFrame:
    return _point_list(spark, folder, "grace_previous")


@query(_list_sql("all_previous", "x.release_date, x.release_key"))
def all_previous(spark: SparkSession, folder: str) -> DataFrame:
    return _point_list(spark, folder, "all_previous")


@query(_list_sql("before_grace", "x.release_date DESC, x.release_key"))
def before_grace(spark: SparkSession, folder: str) -> DataFrame:
    return _point_list(spark, folder, "before_grace")


@query(_list_sql("current_others", "x.release_key"))
def current_others(spark: SparkSession, folder: str) -> DataFrame:
    return _point_list(spark, folder, "current_others")


@query(TIMELINE + """
SELECT date, browser_name, max(release_key) FILTER (WHERE nth = 1) AS post,
  coalesce(string_agg(release_key, ',' ORDER BY nth) FILTER (WHERE nth > 1), '') AS prev
FROM before_grace GROUP BY ALL""")
def split_post_and_prev(spark: SparkSession, folder: str) -> DataFrame:
    points = timeline.metric_points(_known(spark, folder)).where(F.size("before_grace") > 0)
    post, prev = timeline.split_post_and_prev(F.col("before_grace"))
    return points.select("date", "browser_name", post.alias("post"), joined(prev).alias("prev"))


@query(COUNTS + "SELECT browser_name, release_date, curr_release, prev_release FROM pairs")
def consecutive_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.consecutive_pairs(_known(spark, folder))


@query(COUNTS + "SELECT DISTINCT browser_name, os_name FROM chosen")
def preferred_os(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.preferred_os(_known(spark, folder))


@query(BOUND + """SELECT release_date, browser_name, browser_version, os_name, os_version, release_key
FROM all_releases QUALIFY row_number() OVER (PARTITION BY browser_name ORDER BY release_date DESC,
  browser_version DESC, os_name DESC, os_version DESC) = 1 ORDER BY 1, 2, 3, 4, 5""")
def default_in_view(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.default_in_view(with_release_key(bindings.releases(spark, folder)))


VALUE_SQL = TIMELINE + "SELECT type, browser_name, date, release, value FROM metric_values"
VALUE_COLUMNS = ["type", "browser_name", "date", "release", "value"]


@query(VALUE_SQL + " WHERE type = 'BROWSER_SPECIFIC'")
def browser_specific(spark: SparkSession, folder: str) -> DataFrame:
    return _metric_rows(spark, folder, model.BROWSER_SPECIFIC).select(*VALUE_COLUMNS)


@query(VALUE_SQL + " WHERE type = 'LONE_OMISSION'")
def lone_omission(spark: SparkSession, folder: str) -> DataFrame:
    return _metric_rows(spark, folder, model.LONE_OMISSION).select(*VALUE_COLUMNS)


@query(VALUE_SQL + " WHERE type = 'LONE_REMOVAL'")
def lone_removal(spark: SparkSession, folder: str) -> DataFrame:
    return _metric_rows(spark, folder, model.LONE_REMOVAL).select(*VALUE_COLUMNS)


@query(TIMELINE + COUNTS.removeprefix(BOUND) + """
SELECT m.type, m.browser_name, m.date, m.release, m.value,
  coalesce((SELECT string_agg(release_key, ',' ORDER BY release_key) FROM role_rows r
    WHERE r.type = m.type AND r.browser_name = m.browser_name AND r.date = m.date
      AND r.role = CASE m.type WHEN 'BROWSER_SPECIFIC' THEN 'none' ELSE 'all' END), '')
    AS compared_releases,
  coalesce(CASE m.type
    WHEN 'BROWSER_SPECIFIC' THEN (SELECT string_agg(release_key, ',' ORDER BY release_key)
      FROM grace_previous g WHERE g.browser_name = m.browser_name AND g.date = m.date)
    WHEN 'LONE_OMISSION' THEN (SELECT string_agg(release_key, ',' ORDER BY release_key)
      FROM all_previous g WHERE g.browser_name = m.browser_name AND g.date = m.date)
    ELSE (SELECT string_agg(release_key, ',' ORDER BY release_key)
      FROM before_grace g WHERE g.browser_name = m.browser_name AND g.date = m.date AND nth > 1)
    END, '') AS prev_releases
FROM metric_values m
UNION ALL
SELECT 'API_COUNT', browser_name, release_date, curr_release, total_apis,
  new_apis || ' new, ' || removed_apis || ' removed', coalesce(prev_release, '') FROM api_counts""")
def run_all_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All four metric types, in one pass."""
    rows, counts = metrics.run_all_metrics(_desktop(spark, folder), *_facts(spark, folder))
    metric_rows = rows.select(
        *VALUE_COLUMNS,
        joined(F.sort_array("compared_releases")).alias("compared_releases"),
        joined(F.sort_array("prev_releases")).alias("prev_releases"),
    )
    changes = F.concat_ws(" ", "new_apis", F.lit("new,"), "removed_apis", F.lit("removed"))
    count_rows = counts.select(
        F.lit("API_COUNT"), "browser_name", "release_date", "curr_release", "total_apis", changes,
        F.coalesce("prev_release", F.lit("")),
    )
    return metric_rows.union(count_rows)


@query(VALUE_SQL + " WHERE type = 'LONE_OMISSION'")
def metrics_of_type(spark: SparkSession, folder: str) -> DataFrame:
    rows = _metric_rows(spark, folder, *model.METRIC_TYPES)
    return metrics.metrics_of_type(rows, model.LONE_OMISSION).select(*VALUE_COLUMNS)


@query(TIMELINE + """SELECT type, browser_name,
  string_agg(CAST(date AS VARCHAR) || '=' || value, ',' ORDER BY date) AS points
FROM metric_values GROUP BY ALL""")
def metric_series(spark: SparkSession, folder: str) -> DataFrame:
    series = metrics.metric_series(_metric_rows(spark, folder, *model.METRIC_TYPES))
    text = F.transform("points", lambda p: F.concat_ws("=", p["date"], p["value"]))
    return series.select("type", "browser_name", joined(text).alias("points"))


COUNT_COLUMNS = ["browser_name", "release_date", "curr_release", "prev_release",
                 "total_apis", "new_apis", "removed_apis"]
COUNT_SQL = COUNTS + "SELECT " + ", ".join(COUNT_COLUMNS) + " FROM api_counts"


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.api_counts(_desktop(spark, folder), *_facts(spark, folder))


@query(COUNT_SQL)
def api_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder).select(*COUNT_COLUMNS)


@query(COUNT_SQL + " WHERE prev_release IS NULL")
def api_count_single(spark: SparkSession, folder: str) -> DataFrame:
    """The first release of each browser only has a total."""
    return _counts(spark, folder).where(F.col("prev_release").isNull()).select(*COUNT_COLUMNS)


@query(COUNT_SQL + " WHERE prev_release IS NOT NULL")
def api_count_pair(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder).where(F.col("prev_release").isNotNull()).select(*COUNT_COLUMNS)


@query(COUNTS + """SELECT browser_name, release_date, new_apis - removed_apis AS value
FROM api_counts WHERE new_apis < removed_apis""")
def validate_metric_value(spark: SparkSession, folder: str) -> DataFrame:
    """Net growth offered as a metric value: the rows the value check rejects."""
    growth = _counts(spark, folder).select(
        "browser_name", "release_date", (F.col("new_apis") - F.col("removed_apis")).alias("value"))
    return metrics.reject_negative(growth)


@query(COUNTS + """SELECT epoch_ms(CAST(c.release_date AS TIMESTAMP)) AS release_date, c.browser_name,
  r.browser_version, r.os_name, r.os_version, total_apis, new_apis, removed_apis,
  c.prev_release FROM api_counts c JOIN releases r ON r.release_key = c.curr_release""")
def flatten_api_counts(spark: SparkSession, folder: str) -> DataFrame:
    flat = metrics.flatten_api_counts(_counts(spark, folder), _desktop(spark, folder))
    prev = F.when(F.col("prev").isNotNull(), F.concat_ws(
        "_", "prev.browser_name", "prev.browser_version", "prev.os_name", "prev.os_version"))
    return flat.select("release_date", "browser_name", "browser_version", "os_name", "os_version",
                       "total_apis", "new_apis", "removed_apis", prev.alias("prev_release"))


@query(COUNTS + """SELECT curr_release AS minuend, j.interface_key, 'new' AS side
FROM pairs JOIN junction j ON j.release_key = curr_release
WHERE curr_release = 'A_1996_Windows_10' AND NOT EXISTS (SELECT 1 FROM junction k
  WHERE k.release_key = prev_release AND k.interface_key = j.interface_key)
UNION ALL SELECT curr_release, j.interface_key, 'removed'
FROM pairs JOIN junction j ON j.release_key = prev_release
WHERE curr_release = 'A_1996_Windows_10' AND NOT EXISTS (SELECT 1 FROM junction k
  WHERE k.release_key = curr_release AND k.interface_key = j.interface_key)""")
def diff_view(spark: SparkSession, folder: str) -> DataFrame:
    _, junction = _facts(spark, folder)
    sides = drilldown.diff_view(junction, "A_1996_Windows_10", "A_1995_Windows_10")
    return sides.select(F.lit("A_1996_Windows_10").alias("minuend"), "interface_key", "side")


def _apis_behind(spark: SparkSession, folder: str, kind: str, points: DataFrame | None = None) -> DataFrame:
    rows = drilldown.metric_apis(kind, _desktop(spark, folder), *_facts(spark, folder), points)
    return rows.select("browser_name", "date", "interface_key")


MATCH_SQL = TIMELINE + "SELECT browser_name, date, interface_key FROM matches WHERE type = "


@query(MATCH_SQL + "'LONE_OMISSION'")
def lone_omission_apis(spark: SparkSession, folder: str) -> DataFrame:
    return _apis_behind(spark, folder, model.LONE_OMISSION)


@query(MATCH_SQL + "'BROWSER_SPECIFIC'")
def browser_specific_apis(spark: SparkSession, folder: str) -> DataFrame:
    return _apis_behind(spark, folder, model.BROWSER_SPECIFIC)


REMOVAL_SQL = TIMELINE + """,
removal_roles AS (
  SELECT r.* FROM role_rows r JOIN measures m USING (type, browser_name, date)
  WHERE r.type = 'LONE_REMOVAL' AND (r.role <> 'none' OR r.release_key = m.release))
SELECT h.browser_name, h.date, h.interface_key FROM (
  SELECT browser_name, date, interface_key, count(*) FILTER (WHERE role = 'all') AS got_all,
    count(*) FILTER (WHERE role = 'none') AS got_none,
    count(*) FILTER (WHERE role = 'any') AS got_any
  FROM removal_roles JOIN junction USING (release_key) GROUP BY ALL) h
JOIN needs n ON n.type = 'LONE_REMOVAL' AND n.browser_name = h.browser_name AND n.date = h.date
WHERE got_all = n_all AND got_none = 0 AND got_any > 0"""


@query(REMOVAL_SQL)
def lone_removal_apis(spark: SparkSession, folder: str) -> DataFrame:
    return _apis_behind(spark, folder, model.LONE_REMOVAL)


def _last_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the last date that the derived releases reach."""
    points = timeline.points_of(_known(spark, folder))
    return points.join(points.agg(F.max("date").alias("date")), "date", "left_semi")


LAST_SQL = " AND date = (SELECT max(date) FROM points)"


@query(MATCH_SQL + "'LONE_OMISSION'" + LAST_SQL)
def lone_omission_apis_at(spark: SparkSession, folder: str) -> DataFrame:
    """The APIs behind chosen points only."""
    return _apis_behind(spark, folder, model.LONE_OMISSION, _last_points(spark, folder))


@query(MATCH_SQL + "'BROWSER_SPECIFIC'" + LAST_SQL)
def browser_specific_apis_at(spark: SparkSession, folder: str) -> DataFrame:
    return _apis_behind(spark, folder, model.BROWSER_SPECIFIC, _last_points(spark, folder))


@query(REMOVAL_SQL + " AND h.date = (SELECT max(date) FROM points)")
def lone_removal_apis_at(spark: SparkSession, folder: str) -> DataFrame:
    return _apis_behind(spark, folder, model.LONE_REMOVAL, _last_points(spark, folder))


TERSE_SQL = """lower(substr(split_part(k, '_', 1), 1, 3)) || split_part(k, '_', 2)
  || lower(substr(split_part(k, '_', 3), 1, 3)) || split_part(k, '_', 4)"""


@query(TIMELINE + f""",
terse AS (
  SELECT m.type, m.browser_name, m.date, r.role, {TERSE_SQL.replace("k,", "r.release_key,")} AS id
  FROM measures m JOIN role_rows r USING (type, browser_name, date)
  WHERE m.type <> 'LONE_REMOVAL' OR r.role = 'all' OR (r.role = 'none' AND r.release_key = m.release)),
sizes AS (
  SELECT m.type, m.browser_name, m.date, n.n_all, n.n_any
  FROM measures m JOIN needs n USING (type, browser_name, date))
SELECT m.type, m.browser_name, m.date,
  coalesce(string_agg(t.id, ',' ORDER BY t.id) FILTER (WHERE t.role = 'all'), '') AS shipped,
  coalesce(string_agg(t.id, ',' ORDER BY t.id) FILTER (WHERE t.role = 'none'), '') AS not_shipped,
  CASE WHEN m.type = 'LONE_REMOVAL' THEN
    array_to_string(range(s.n_all + 1, s.n_all + s.n_any + 2), ',') ELSE '' END AS counts
FROM measures m JOIN terse t USING (type, browser_name, date)
JOIN sizes s USING (type, browser_name, date) GROUP BY m.type, m.browser_name, m.date, s.n_all, s.n_any""")
def query_for(spark: SparkSession, folder: str) -> DataFrame:
    known = _known(spark, folder)
    points = metrics.measure_points(known, model.METRIC_TYPES)
    rows = drilldown.query_for(points)
    return rows.select("type", "browser_name", "date", joined("shipped").alias("shipped"),
                       joined("not_shipped").alias("not_shipped"), joined("counts").alias("counts"))


#: A metric of one's own: shipped now, but in no earlier release of the browser.
FIRST_SHIPPED = metrics.Measure(
    timeline.OWN, timeline.ALL_PREVIOUS, timeline.CURRENT_OTHERS,
    all_of=(timeline.OWN,), none_of=(timeline.ALL_PREVIOUS,), spared=(timeline.OWN,),
)


@query(TIMELINE + """
SELECT 'FIRST_SHIPPED' AS type, p.browser_name, p.date, p.release_key AS release,
  (SELECT count(*) FROM junction j WHERE j.release_key = p.release_key AND NOT EXISTS (
    SELECT 1 FROM all_previous q JOIN junction k ON k.release_key = q.release_key
    WHERE q.date = p.date AND q.browser_name = p.browser_name
      AND q.release_key <> p.release_key AND k.interface_key = j.interface_key)) AS value
FROM points p""")
def custom_metric(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.browser_metrics(
        _desktop(spark, folder), *_facts(spark, folder), ["FIRST_SHIPPED"],
        {"FIRST_SHIPPED": FIRST_SHIPPED},
    )
    return rows.select(*VALUE_COLUMNS)
