"""Keyed set operations, comparison predicates, ordering and grouping on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import division, metrics, sets
from driftline.operators.ranks import ranked
from driftline.operators.search import all_of, any_of
from driftline.operators.signature import with_release_key
from driftline.operators.timeline import desktop_only
from driftline.plans import bindings
from driftline.plans.bindings import table
from driftline.plans.registry import BOUND, TIMELINE, joined, query
from driftline.session import cut_lineage


def _buyers(spark: SparkSession, folder: str, status: str) -> DataFrame:
    orders = table(spark, folder, "orders").where(F.col("o_orderstatus") == status)
    return orders.select(F.col("o_custkey").alias("c_custkey"))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")


CUSTOMER_SQL = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey "
BUYER_SQL = "(SELECT o_custkey FROM orders WHERE o_orderstatus = '{}')"


@query(CUSTOMER_SQL + "NOT IN " + BUYER_SQL.format("F"))
def set_minus(spark: SparkSession, folder: str) -> DataFrame:
    return sets.set_minus(_customers(spark, folder), _buyers(spark, folder, "F"), ["c_custkey"])


@query(CUSTOMER_SQL + "NOT IN " + BUYER_SQL.format("F") + " AND c_custkey NOT IN " + BUYER_SQL.format("O"))
def set_minus_many(spark: SparkSession, folder: str) -> DataFrame:
    others = [_buyers(spark, folder, status) for status in ("F", "O")]
    return sets.set_minus(_customers(spark, folder), others, ["c_custkey"])


@query(CUSTOMER_SQL + "IN " + BUYER_SQL.format("P"))
def intersect(spark: SparkSession, folder: str) -> DataFrame:
    return sets.intersect(_customers(spark, folder), _buyers(spark, folder, "P"), ["c_custkey"])


@query(CUSTOMER_SQL + "IN " + BUYER_SQL.format("F") + " AND c_custkey IN " + BUYER_SQL.format("O"))
def intersect_many(spark: SparkSession, folder: str) -> DataFrame:
    others = [_buyers(spark, folder, status) for status in ("F", "O")]
    return sets.intersect(_customers(spark, folder), others, ["c_custkey"])


def _last_state(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """The newest event of each user among the given kinds, without its id."""
    events = table(spark, folder, "events").where(F.col("event_type").isin(*kinds))
    last = sets.upsert(events, ["user_id"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "value")


STATE_SQL = """(SELECT user_id, event_type, value FROM events WHERE event_type IN ({})
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query(f"""SELECT p.* FROM {STATE_SQL.format("'view', 'click', 'purchase'")} p
LEFT JOIN {STATE_SQL.format("'view', 'click'")} s USING (user_id)
WHERE s.user_id IS NULL OR p.event_type <> s.event_type OR p.value <> s.value""")
def diff_only(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose latest state changed once purchases count as well."""
    newer = _last_state(spark, folder, "view", "click", "purchase")
    return sets.diff_only(newer, _last_state(spark, folder, "view", "click"), ["user_id"])


@query(f"""SELECT p.* FROM {STATE_SQL.format("'view', 'click', 'purchase'")} p
LEFT JOIN {STATE_SQL.format("'view', 'click'")} s USING (user_id)
LEFT JOIN {STATE_SQL.format("'click'")} t USING (user_id)
WHERE (s.user_id IS NULL OR p.event_type <> s.event_type OR p.value <> s.value)
  AND (t.user_id IS NULL OR p.event_type <> t.event_type OR p.value <> t.value)""")
def diff_only_many(spark: SparkSession, folder: str) -> DataFrame:
    newer = _last_state(spark, folder, "view", "click", "purchase")
    others = [_last_state(spark, folder, "view", "click"), _last_state(spark, folder, "click")]
    return sets.diff_only(newer, others, ["user_id"])


UNION_SQL = f"""
SELECT user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS nth FROM (
    SELECT 1 AS rank, * FROM {STATE_SQL.format("'error'")}
    UNION ALL SELECT 2, * FROM {STATE_SQL.format("'purchase'")}
    UNION ALL SELECT 3, * FROM {STATE_SQL.format("'view', 'click'")})) WHERE nth = 1"""


def _union_sources(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [_last_state(spark, folder, *kinds) for kinds in (("error",), ("purchase",), ("view", "click"))]


@query(UNION_SQL)
def union_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return sets.union_by_key(*_union_sources(spark, folder), keys=["user_id"])


@query(f"SELECT * FROM ({UNION_SQL}) WHERE user_id = 7")
def union_find(spark: SparkSession, folder: str) -> DataFrame:
    return sets.union_find(*_union_sources(spark, folder), key={"user_id": 7})


@query(f"""SELECT p.* FROM {STATE_SQL.format("'view', 'click', 'purchase'")} p
LEFT JOIN {STATE_SQL.format("'error'")} s USING (user_id)
WHERE s.user_id IS NULL OR p.value > s.value""")
def filter_by_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A rule of one's own: unknown users, or those above their last error's value."""
    return sets.filter_by_lookup(
        _last_state(spark, folder, "view", "click", "purchase"), _last_state(spark, folder, "error"),
        ["user_id"], lambda mine, found: found.isNull() | (mine["value"] > found["value"]),
    )


@query("""SELECT user_id, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    last = sets.upsert(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", "event_id", "event_type", "value")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 11")
def find(spark: SparkSession, folder: str) -> DataFrame:
    return sets.find(_customers(spark, folder), {"c_custkey": 11})


@query(TIMELINE + "SELECT type, browser_name, date, value FROM metric_values")
def set_division_by_join(spark: SparkSession, folder: str) -> DataFrame:
    """Metric values by the division itself."""
    known = metrics.listed_once(desktop_only(bindings.releases(spark, folder)))
    measures = cut_lineage(metrics.measure_points(known, metrics.MEASURES), "measures")
    counted = division.counts(
        measures, metrics.KEYS, known, bindings.apis(spark, folder), bindings.junction(spark, folder))
    return division.with_counts(measures, metrics.KEYS, counted).select(*metrics.KEYS, "value")


# Predicates, ordering and grouping


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
  WHERE (l_quantity < 10 OR l_quantity >= 45) AND l_returnflag IN ('A', 'R')
    AND l_discount <= 0.05 AND l_linestatus = 'O'""")
def comparison_algebra(spark: SparkSession, folder: str) -> DataFrame:
    quantity = F.col("l_quantity")
    wanted = all_of(
        any_of(quantity < 10, quantity >= 45), F.col("l_returnflag").isin("A", "R"),
        F.col("l_discount") <= 0.05, F.col("l_linestatus") == "O", all_of(),
    )
    return table(spark, folder, "lineitem").where(wanted).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def count_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return lines.agg(F.count("*").alias("n"))


@query(BOUND + """SELECT browser_name, count(*) AS n,
  string_agg(release_key, ',' ORDER BY release_key) AS members FROM all_releases GROUP BY browser_name""")
def group_by_collect(spark: SparkSession, folder: str) -> DataFrame:
    """Rows collected per key; groups of the release dimension are small."""
    known = with_release_key(bindings.releases(spark, folder))
    grouped = known.groupBy("browser_name").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("release_key")).alias("members"))
    return grouped.select("browser_name", "n", joined("members").alias("members"))


@query("""SELECT l_returnflag, string_agg(l_linestatus || '=' || n, ',' ORDER BY l_linestatus) AS groups
  FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def nested_group_by(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per inner group, listed per outer group."""
    inner = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").count()
    listed = F.sort_array(F.collect_list(F.struct("l_linestatus", "count")))
    text = F.transform(listed, lambda g: F.concat_ws("=", g["l_linestatus"], g["count"]))
    return inner.groupBy("l_returnflag").agg(joined(text).alias("groups"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


ORDER_COLUMNS = ["c_custkey", "c_nationkey", "c_acctbal"]


def _order_sql(order: str) -> str:
    return f"""SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (ORDER BY {order}) - 1 AS pos
FROM customer ORDER BY pos"""


def _placed(spark: SparkSession, folder: str, *order: Column | str) -> DataFrame:
    return ranked(table(spark, folder, "customer").select(*ORDER_COLUMNS), *order).numbered().orderBy("pos")


@query(_order_sql("c_acctbal DESC, c_custkey"))
def order_by(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with their place in the order."""
    return _placed(spark, folder, F.desc("c_acctbal"), "c_custkey")


@query(_order_sql("c_nationkey, c_acctbal DESC, c_custkey"))
def then_by(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder, "c_nationkey", F.desc("c_acctbal"), "c_custkey")


@query(_order_sql("c_nationkey, c_acctbal, c_custkey"))
def chained_order(spark: SparkSession, folder: str) -> DataFrame:
    """Calls in a chain: the last one is the primary key."""
    calls = ["c_custkey", "c_acctbal", "c_nationkey"]
    return _placed(spark, folder, *reversed(calls))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, pos FROM (
  SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS pos,
    count(*) OVER () AS n FROM lineitem) WHERE pos >= n // 6 * 5 AND pos < n // 6 * 5 + 40""")
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """Forty rows from far down the order; only the ranges that hold them are read."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    index = ranked(lines, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return index.page(index.before[-1] // 6 * 5, 40, "pos")
