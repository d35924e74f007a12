"""Names, the wide table, the grid and catalog search on the derived compat data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline import functions as fn
from driftline.operators import compat, search
from driftline.operators.signature import ReleaseIndex, ships, signatures, with_release_key
from driftline.operators.timeline import default_in_view, desktop_only
from driftline.plans import bindings
from driftline.plans.registry import BOUND, joined, query
from driftline.session import fresh_path
from driftline.sources import sinks
from driftline.sources.catalog import explode_catalogs

# The derived releases follow a rule: three browsers, seven years, up to three systems.
SYSTEMS = {"A": ("Android", "OSX", "Windows"), "N": ("Android", "OSX", "Windows"),
           "R": ("Android", "OSX")}
YEARS = range(1995, 2002)


def all_signatures(spark: SparkSession, folder: str) -> tuple[ReleaseIndex, DataFrame]:
    """Index over all releases with strict signatures of all APIs."""
    index = ReleaseIndex.build(bindings.releases(spark, folder))
    rows = signatures(
        bindings.apis(spark, folder), bindings.junction(spark, folder), index, strict=True
    )
    return index, rows


# Names and identities


@query(BOUND + "SELECT release_key, browser_name, release_date FROM all_releases")
def release_key(spark: SparkSession, folder: str) -> DataFrame:
    known = bindings.releases(spark, folder)
    return known.select(fn.release_key().alias("release_key"), "browser_name", "release_date")


@query(BOUND + "SELECT release_key, os_name IN ('Android', 'iPhone') AS is_mobile FROM all_releases")
def is_mobile(spark: SparkSession, folder: str) -> DataFrame:
    known = bindings.releases(spark, folder)
    return known.select(fn.release_key().alias("release_key"), fn.is_mobile().alias("is_mobile"))


@query(BOUND + "SELECT interface_name, api_name, interface_key AS id FROM apis")
def interface_key(spark: SparkSession, folder: str) -> DataFrame:
    return bindings.apis(spark, folder).select(
        "interface_name", "api_name", fn.interface_key().alias("id"))


@query(BOUND + "SELECT interface_key, interface_name, api_name FROM apis")
def split_interface_key(spark: SparkSession, folder: str) -> DataFrame:
    parts = fn.split_interface_key("interface_key").alias("parts")
    return bindings.apis(spark, folder).select("interface_key", parts).select(
        "interface_key", "parts.*")


NAME_SQL = """regexp_replace(lower(substr(browser_name, 1, 1)) || substr(browser_name, 2)
  || browser_version || lower(substr(os_name, 1, 1)) || substr(os_name, 2) || os_version,
  '[^a-zA-Z0-9]', '_', 'g')"""


@query(BOUND + f"SELECT release_key, {NAME_SQL} AS column_name FROM all_releases")
def column_name(spark: SparkSession, folder: str) -> DataFrame:
    known = bindings.releases(spark, folder)
    return known.select(fn.release_key().alias("release_key"), fn.column_name().alias("column_name"))


@query(BOUND + """SELECT release_key, browser_name || ' ' || browser_version || ' ' || os_name || ' '
  || os_version AS label FROM all_releases""")
def column_label(spark: SparkSession, folder: str) -> DataFrame:
    known = bindings.releases(spark, folder)
    return known.select(fn.release_key().alias("release_key"), fn.column_label().alias("label"))


@query(BOUND + """SELECT release_key, lower(substr(browser_name, 1, 3)) || browser_version
  || lower(substr(os_name, 1, 3)) || os_version AS terse_id FROM all_releases""")
def terse_release_id(spark: SparkSession, folder: str) -> DataFrame:
    keyed = with_release_key(bindings.releases(spark, folder))
    return keyed.select("release_key", fn.terse_release_id("release_key").alias("terse_id"))


@query("""SELECT p_partkey, (CAST(530 + p_size AS VARCHAR) || '.' || CAST(p_partkey % 97 AS VARCHAR)
    || '.2') AS browser_version,
  CASE WHEN 530 + p_size = 534 THEN '5.1' WHEN 530 + p_size = 536 THEN '6.0'
    WHEN 530 + p_size = 538 THEN '8.0'
    WHEN 530 + p_size = 537 AND p_partkey % 97 = 43 THEN '6.1'
    WHEN 530 + p_size = 537 AND p_partkey % 97 IN (71, 73, 75, 76, 77, 78) THEN '7.0'
    WHEN 530 + p_size = 537 AND p_partkey % 97 = 85 THEN '7.1'
    ELSE (CAST(530 + p_size AS VARCHAR) || '.' || CAST(p_partkey % 97 AS VARCHAR) || '.2')
  END AS friendly FROM part""")
def friendly_browser_version(spark: SparkSession, folder: str) -> DataFrame:
    """Build numbers made from part sizes, read as versions of the one mapped browser."""
    build = F.concat_ws(".", F.col("p_size") + 530, F.pmod("p_partkey", F.lit(97)), F.lit(2))
    parts = bindings.table(spark, folder, "part").select("p_partkey", build.alias("browser_version"))
    return parts.select(
        "p_partkey", "browser_version",
        fn.friendly_browser_version(F.lit("Safari"), "browser_version").alias("friendly"),
    )


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders")
def epoch_ms(spark: SparkSession, folder: str) -> DataFrame:
    orders = bindings.table(spark, folder, "orders")
    return orders.select("o_orderkey", fn.epoch_ms("o_orderdate").alias("ms"))


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(make_date(
    year(o_orderdate) - 1, month(o_orderdate), 1) + (day(o_orderdate) - 1)::INTEGER AS DATE) AS year_before
  FROM orders""")
def one_year_before(spark: SparkSession, folder: str) -> DataFrame:
    days = bindings.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"))
    return days.distinct().withColumn("year_before", fn.one_year_before("day"))


@query("""SELECT l_orderkey, l_linenumber, l_discount <> 0 AS has_discount,
  l_linestatus <> '' AS has_status, l_linenumber - 1 <> 0 AS not_first FROM lineitem""")
def truthy(spark: SparkSession, folder: str) -> DataFrame:
    lines = bindings.table(spark, folder, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber",
        fn.truthy("l_discount", T.DoubleType()).alias("has_discount"),
        fn.truthy("l_linestatus", T.StringType()).alias("has_status"),
        fn.truthy(F.col("l_linenumber") - 1, T.IntegerType()).alias("not_first"),
    )


@query("""SELECT s_suppkey, n.n_name AS nation, r.r_name AS region FROM supplier
  JOIN nation n ON n_nationkey = s_nationkey JOIN region r ON r_regionkey = n_regionkey""")
def dot_access(spark: SparkSession, folder: str) -> DataFrame:
    """Paths into nested values."""
    region = bindings.table(spark, folder, "region")
    nation = bindings.table(spark, folder, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"))
    nested = nation.select("n_nationkey", F.struct("n_name", F.struct("r_name").alias("region")).alias("nation"))
    supplier = bindings.table(spark, folder, "supplier")
    return supplier.join(nested, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("nation.n_name").alias("nation"),
        F.col("nation.region.r_name").alias("region"))


@query("SELECT c_custkey, upper(c_mktsegment) || ':' || c_nationkey AS mapped FROM customer")
def map_rows(spark: SparkSession, folder: str) -> DataFrame:
    customers = bindings.table(spark, folder, "customer")
    return customers.select(
        "c_custkey", F.concat_ws(":", F.upper("c_mktsegment"), "c_nationkey").alias("mapped"))


# The wide table and the grid


def wide_sql() -> str:
    columns = []
    for browser, systems in SYSTEMS.items():
        for year in YEARS:
            for system in systems:
                key = f"{browser}_{year}_{system}_10"
                name = f"{browser.lower()}{year}{system[0].lower()}{system[1:]}10"
                columns.append(f"coalesce(bool_or(j.release_key = '{key}'), false) AS {name}")
    return BOUND + f"""SELECT a.interface_key AS id, a.interface_name, a.api_name,
  {", ".join(columns)} FROM apis a LEFT JOIN junction j USING (interface_key) GROUP BY ALL"""


@query(wide_sql())
def pivot_compat(spark: SparkSession, folder: str) -> DataFrame:
    index, rows = all_signatures(spark, folder)
    return compat.pivot_compat(rows, index)


GRID = BOUND + """,
cells AS (
  SELECT a.interface_key AS id, r.pos, r.release_key, r.os_name, j.release_key IS NOT NULL AS cell
  FROM apis a CROSS JOIN ordered_releases r LEFT JOIN junction j
    ON j.release_key = r.release_key AND j.interface_key = a.interface_key)
"""


@query(GRID + "SELECT id, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY pos) AS data FROM cells GROUP BY id")
def build_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid, _ = compat.grid_of(bindings.releases(spark, folder), bindings.apis(spark, folder), bindings.junction(spark, folder))
    return grid.select("id", joined("data").alias("data"))


@query(GRID + """SELECT id, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY pos DESC) AS data
  FROM cells WHERE os_name = 'OSX' GROUP BY id""")
def project_cols(spark: SparkSession, folder: str) -> DataFrame:
    """The releases of one system, newest first, with a column nobody knows."""
    index, rows = all_signatures(spark, folder)
    wanted = [row.release_key for row in reversed(index.rows) if row.os_name == "OSX"]
    grid = compat.project_cols(compat.build_grid(rows, index), index.keys, [*wanted, "no such release"])
    return grid.select("id", joined("data").alias("data"))


@query(GRID + """SELECT id FROM cells GROUP BY id
  HAVING bool_or(cell) FILTER (WHERE release_key = 'A_1995_Windows_10')
    AND NOT bool_or(cell) FILTER (WHERE release_key = 'N_1995_Windows_10')
    AND bool_or(cell) FILTER (WHERE release_key = 'R_1995_OSX_10')""")
def extract_cols(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose chosen cells equal a given pattern."""
    index, rows = all_signatures(spark, folder)
    where = fn.known_positions(index.keys, ["A_1995_Windows_10", "N_1995_Windows_10", "R_1995_OSX_10"])
    pattern = F.array(F.lit(True), F.lit(False), F.lit(True))
    grid = compat.build_grid(rows, index)
    return grid.where(fn.extract_cols("data", where) == pattern).select("id")


@query(GRID + "SELECT id, count(*) FILTER (WHERE cell) AS n_releases FROM cells GROUP BY id")
def array_count(spark: SparkSession, folder: str) -> DataFrame:
    index, rows = all_signatures(spark, folder)
    count = fn.array_count("data", lambda cell: fn.truthy(cell, T.BooleanType()))
    return compat.build_grid(rows, index).select("id", count.alias("n_releases"))


@query(GRID + """SELECT id, count(*) FILTER (WHERE cell) AS n_shipped FROM cells
  WHERE release_key IN ('A_2001_Windows_10', 'N_2001_Windows_10', 'R_2001_OSX_10') GROUP BY id""")
def seq(spark: SparkSession, folder: str) -> DataFrame:
    """Several expressions as one sequence, counted."""
    index, rows = all_signatures(spark, folder)
    cells = fn.seq(*[
        ships(index, index.position[key])
        for key in ("A_2001_Windows_10", "N_2001_Windows_10", "R_2001_OSX_10")
    ])
    counted = fn.array_count(cells, lambda cell: cell)
    return rows.select(F.col("interface_key").alias("id"), counted.alias("n_shipped"))


@query(BOUND + """SELECT l_orderkey, l_linenumber, coalesce((SELECT pos FROM ordered_releases r
    WHERE r.browser_name = l_returnflag AND r.browser_version = CAST(year(l_shipdate) AS VARCHAR)
      AND r.os_name = 'Windows'), -1) AS pos FROM lineitem""")
def col_index_of(spark: SparkSession, folder: str) -> DataFrame:
    """Grid position of each shipment's release on one system, -1 where there is none."""
    parts = ["browser_name", "browser_version", "os_name"]
    known = bindings.releases(spark, folder).select(
        F.struct("release_date", *parts, "os_version").alias("order"), F.struct(*parts).alias("release")).distinct()
    in_order = known.agg(F.array_sort(F.collect_list(F.struct("order", "release"))).alias("columns")).scalar()
    wanted = F.struct(
        F.col("l_returnflag").alias("browser_name"), F.year("l_shipdate").cast("string").alias("browser_version"),
        F.lit("Windows").alias("os_name"))
    columns = F.transform("columns", lambda c: c["release"])
    lines = bindings.table(spark, folder, "lineitem").withColumn("columns", in_order)
    return lines.select("l_orderkey", "l_linenumber", fn.col_index_of(columns, wanted).alias("pos"))


@query(BOUND + f"""SELECT pos, {NAME_SQL} AS column_name, browser_name || ' ' || browser_version || ' '
  || os_name || ' ' || os_version AS label, release_key FROM ordered_releases""")
def compat_columns(spark: SparkSession, folder: str) -> DataFrame:
    index = ReleaseIndex.build(bindings.releases(spark, folder))
    return compat.compat_columns(index).select(
        F.col("pos").cast("long").alias("pos"), "column_name", "label", "release_key")


@query(BOUND + """SELECT a.interface_key AS id, coalesce(bool_or(release_key = 'N_1998_OSX_10'), false) AS shipped
  FROM apis a LEFT JOIN junction j USING (interface_key) GROUP BY ALL""")
def column_for_release(spark: SparkSession, folder: str) -> DataFrame:
    index, rows = all_signatures(spark, folder)
    wide = compat.pivot_compat(rows, index)
    name = compat.column_for_release(wide, "N_1998_OSX_10")
    return wide.select("id", F.col(name).alias("shipped"))


@query(BOUND + """SELECT a.interface_key AS id, a.interface_name, a.api_name,
  coalesce(bool_or(release_key = 'A_1999_Windows_10'), false) AS a1999windows10,
  coalesce(bool_or(release_key = 'N_1999_Windows_10'), false) AS n1999windows10,
  coalesce(bool_or(release_key = 'R_2000_OSX_10'), false) AS r2000oSX10
  FROM apis a LEFT JOIN junction j USING (interface_key) GROUP BY ALL""")
def select_releases(spark: SparkSession, folder: str) -> DataFrame:
    index, rows = all_signatures(spark, folder)
    wide = compat.pivot_compat(rows, index)
    return compat.select_releases(
        wide, ["R_2000_OSX_10", "A_1999_Windows_10", "N_1999_Windows_10"])


@query(BOUND + """SELECT interface_name, api_name,
  string_agg(release_key, ',' ORDER BY release_key) AS releases
  FROM junction JOIN apis USING (interface_key) GROUP BY ALL""")
def observed_support(spark: SparkSession, folder: str) -> DataFrame:
    support = compat.observed_support(bindings.apis(spark, folder), bindings.junction(spark, folder))
    return support.select("interface_name", "api_name", joined("releases").alias("releases"))


@query(BOUND + """SELECT release_key, interface_key, 'release' AS missing FROM junction
  WHERE release_key NOT IN (SELECT release_key FROM releases)
  UNION ALL SELECT release_key, interface_key, 'api' FROM junction
  WHERE interface_key NOT IN (SELECT interface_key FROM apis WHERE interface_name <> 'Brand1')""")
def junction_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Support facts that point outside the desktop releases or the listed interfaces."""
    return compat.integrity_violations(
        with_release_key(desktop_only(bindings.releases(spark, folder))),
        bindings.apis(spark, folder).where("interface_name <> 'Brand1'"),
        bindings.junction(spark, folder),
    )


@query(BOUND + "SELECT release_key, interface_key FROM junction")
def import_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog fragments of all releases, as nested maps, imported to support facts."""
    facts = bindings.junction(spark, folder).select(
        "release_key", fn.interface_of("interface_key").alias("interface_name"),
        fn.api_of("interface_key").alias("api_name"))
    shard = F.pmod(F.xxhash64("interface_name"), F.lit(8)).alias("shard")
    named = facts.groupBy("release_key", "interface_name").agg(F.collect_set("api_name").alias("names"))
    catalogs = named.groupBy("release_key", shard).agg(
        F.map_from_entries(F.collect_list(F.struct("interface_name", "names"))).alias("catalog"))
    return explode_catalogs(catalogs, "release_key").select(
        "release_key", fn.interface_key().alias("interface_key"))


@query(BOUND + """SELECT r.browser_name, r.browser_version, r.os_name, r.os_version, r.release_date
  FROM all_releases r JOIN junction USING (release_key) WHERE interface_key = (
    SELECT min(interface_key) FROM junction)""")
def api_releases(spark: SparkSession, folder: str) -> DataFrame:
    facts = bindings.junction(spark, folder)
    first = facts.agg(F.min("interface_key").alias("key")).scalar()
    found = compat.api_releases(facts, with_release_key(bindings.releases(spark, folder)), first)
    return found.drop("release_key")


@query(BOUND + """SELECT interface_name, api_name, interface_key FROM apis
  WHERE interface_key IN (SELECT interface_key FROM junction WHERE release_key = 'R_1997_Android_10')""")
def release_apis(spark: SparkSession, folder: str) -> DataFrame:
    return compat.release_apis(
        bindings.junction(spark, folder), bindings.apis(spark, folder), "R_1997_Android_10")


@query(BOUND + """,
expected AS (
  SELECT a.interface_key, r.release_key, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS expected
  FROM apis a JOIN part p USING (p_partkey) JOIN all_releases r
    ON r.browser_name = 'A' AND r.os_name = 'Windows' AND r.browser_version = CAST(1995 + p_size % 7 AS VARCHAR))
SELECT e.release_key, e.interface_key, e.expected, CASE WHEN j.release_key IS NULL THEN 0 ELSE 1 END AS found,
  expected = CASE WHEN j.release_key IS NULL THEN 0 ELSE 1 END AS ok
FROM expected e LEFT JOIN junction j USING (release_key, interface_key)""")
def api_on_release(spark: SparkSession, folder: str) -> DataFrame:
    """Data quality: one expectation per API, checked against the support facts."""
    size = F.col("p_size")
    key = F.concat_ws("_", F.lit("A"), F.lit(1995) + F.pmod(size, F.lit(7)), F.lit("Windows"), F.lit("10"))
    expected = bindings.table(spark, folder, "part").select(
        key.alias("release_key"),
        F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("#"), F.lower("p_type"), F.lit("_"),
                 F.col("p_partkey")).alias("interface_key"),
        (1 - F.pmod(size, F.lit(2))).cast("long").alias("expected"),
    )
    return compat.check_expectations(expected, bindings.junction(spark, folder))


# Search


def _all_searched(spark: SparkSession, folder: str, specs: dict[str, tuple]) -> DataFrame:
    """Searches over all releases, with the newest release per browser in view."""
    releases = bindings.releases(spark, folder)
    view = default_in_view(with_release_key(releases))
    return search.search_many(
        specs, releases, bindings.apis(spark, folder), bindings.junction(spark, folder), view
    ).select("search", F.col("interface_key").alias("id"))


def _searched(spark: SparkSession, folder: str, spec: tuple) -> DataFrame:
    return _all_searched(spark, folder, {"": spec}).select("id")


SEARCH = BOUND + """,
support AS (
  SELECT a.interface_key AS id, j.release_key FROM apis a LEFT JOIN junction j USING (interface_key)),
in_view AS (
  SELECT release_key FROM all_releases QUALIFY row_number() OVER (PARTITION BY browser_name
    ORDER BY release_date DESC, browser_version DESC, os_name DESC) = 1),
per_api AS (
  SELECT id,
    count(*) FILTER (WHERE release_key LIKE 'A_1995_%') AS n_a1995,
    count(*) FILTER (WHERE release_key LIKE 'N_1996_Win%') AS n_n1996win,
    count(*) FILTER (WHERE release_key LIKE 'R_199%') AS n_r199,
    count(*) FILTER (WHERE release_key IN (SELECT release_key FROM in_view)) AS n_view
  FROM support GROUP BY id)
"""


@query(SEARCH + "SELECT id FROM per_api WHERE contains(lower(id), 'econ')")
def keyword(spark: SparkSession, folder: str) -> DataFrame:
    return _searched(spark, folder, ("keyword", "ECON"))


@query(BOUND + """SELECT release_key FROM all_releases
  WHERE lower(browser_name) LIKE 'n%' AND browser_version LIKE '199%' AND lower(os_name) LIKE 'o%'""")
def match_releases(spark: SparkSession, folder: str) -> DataFrame:
    keyed = with_release_key(bindings.releases(spark, folder))
    return search.match_releases(keyed, "n", "199", "o").select("release_key")


@query(SEARCH + """SELECT id FROM per_api WHERE n_a1995 = (
  SELECT count(*) FROM all_releases WHERE release_key LIKE 'A_1995_%')""")
def shipped_in(spark: SparkSession, folder: str) -> DataFrame:
    return _searched(spark, folder, ("in", "a", "1995"))


@query(SEARCH + "SELECT id FROM per_api WHERE n_r199 = 0")
def not_shipped_in(spark: SparkSession, folder: str) -> DataFrame:
    return _searched(spark, folder, ("notin", "r", "199"))


@query(SEARCH + "SELECT id FROM per_api WHERE n_view = 2")
def shipped_count(spark: SparkSession, folder: str) -> DataFrame:
    return _searched(spark, folder, ("count", 2))


@query(SEARCH + """SELECT id FROM per_api WHERE (contains(lower(id), 'brand1') AND n_n1996win = 1)
  OR (n_r199 = 0 AND (n_view = 0 OR n_view = 1))""")
def and_or_search(spark: SparkSession, folder: str) -> DataFrame:
    return _searched(spark, folder, (
        "or",
        ("and", ("keyword", "brand1"), ("in", "n", "1996", "win")),
        ("and", ("notin", "r", "199"), ("or", ("count", 0), ("count", 1))),
    ))


@query(SEARCH + "SELECT id FROM per_api")
def match_all(spark: SparkSession, folder: str) -> DataFrame:
    return _searched(spark, folder, ())


@query(SEARCH + """SELECT 'keyword' AS search, id FROM per_api WHERE contains(lower(id), 'econ')
  UNION ALL SELECT 'shipped', id FROM per_api WHERE n_a1995 = (
    SELECT count(*) FROM all_releases WHERE release_key LIKE 'A_1995_%') AND n_view = 2
  UNION ALL SELECT 'absent', id FROM per_api WHERE n_r199 = 0 OR contains(lower(id), 'brand1') AND n_n1996win = 1
  UNION ALL SELECT 'all', id FROM per_api""")
def searches(spark: SparkSession, folder: str) -> DataFrame:
    """Several searches in one pass."""
    return _all_searched(spark, folder, {
        "keyword": ("keyword", "ECON"), "shipped": ("and", ("in", "a", "1995"), ("count", 2)),
        "absent": ("or", ("notin", "R", "199"), ("and", ("keyword", "Brand1"), ("in", "n", "1996", "WIN"))), "all": (),
        "none": ("or",),
    })


@query(SEARCH + "SELECT count(*) FILTER (WHERE n_view = 2) AS filtered, count(*) AS total FROM per_api")
def filtered_and_total(spark: SparkSession, folder: str) -> DataFrame:
    found = _searched(spark, folder, ("count", 2)).withColumn("found", F.lit(True))
    every = bindings.apis(spark, folder).select(F.col("interface_key").alias("id")).join(found, "id", "left")
    return compat.filtered_and_total(every, F.col("found"))


@query(SEARCH + """SELECT id FROM per_api ORDER BY id LIMIT 40 OFFSET 80""")
def page(spark: SparkSession, folder: str) -> DataFrame:
    """The third screen of the catalog table."""
    apis = bindings.apis(spark, folder).select(F.col("interface_key").alias("id"))
    return compat.page(apis, ["id"], 80)


@query(SEARCH + """SELECT id AS api,
  CASE WHEN bool_or(release_key = 'A_2001_Windows_10') THEN 'TRUE' ELSE 'FALSE' END AS "A 2001 Windows 10",
  CASE WHEN bool_or(release_key = 'N_2001_Windows_10') THEN 'TRUE' ELSE 'FALSE' END AS "N 2001 Windows 10",
  CASE WHEN bool_or(release_key = 'R_2001_OSX_10') THEN 'TRUE' ELSE 'FALSE' END AS "R 2001 OSX 10"
FROM support GROUP BY id HAVING contains(lower(id), 'promo')""")
def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The exported rows of a search, written as CSV and read back."""
    index, rows = all_signatures(spark, folder)
    newest = {row.browser_name: row.release_key for row in index.rows}
    view = [key for key in index.keys if key in newest.values()]
    hits = search.search(rows, index, ("keyword", "promo"), view)
    path = fresh_path(spark, "export")
    sinks.export_csv(hits, index, view, path)
    return sinks.read_csv_export(spark, path, [index.rows[index.position[key]].label for key in view])


@query(BOUND + """SELECT string_agg(release_key, ',' ORDER BY release_date, browser_name) AS releases FROM (
  SELECT * FROM all_releases QUALIFY row_number() OVER (PARTITION BY browser_name
    ORDER BY release_date DESC, browser_version DESC, os_name DESC) = 1)""")
def default_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns a fresh catalog view starts with, in column order."""
    newest = default_in_view(with_release_key(bindings.releases(spark, folder)))
    ordered = F.sort_array(F.collect_list(F.struct("release_date", "browser_name", "release_key")))
    return newest.agg(joined(F.transform(ordered, lambda r: r["release_key"])).alias("releases"))
